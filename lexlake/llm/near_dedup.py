"""Near-duplicate documents by a chosen-path set similarity join.

A document's set are its distinct word shingles. Equal sets form a class and only classes go on. Independent trees
branch the classes by the values of selected minwise tokens; a node that is small enough is compared exhaustively on
signatures, a larger one branches again by tokens that its own path selects, until all are small. Before it does, its
members meet one of them, the leader: those that look like it become candidates with it, and those that look much like
it stay behind, as the leader stands for them; so a node full of near copies is done at once. Connected candidates are
then checked on full sets, so that links are exact; in groups of any size a leader stands for all copies close enough to it.

Null and blank texts have empty sets and no links. Rows with a null doc_id take part, but can't be named: a component's
id is its smallest doc_id that isn't null. Repeated rows are links of a component like any copies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, take_worker, text_of
from .graph import components


@dataclass(frozen=True)
class Settings:
    """words: of a shingle. percent: least Jaccard similarity of a link.

    trees, branches: a tree begins with two branches, of which a pair at similarity 0.8 shares one with probability 0.96.
    In the next three levels a node has 1.25 branches on average, the inverse of that similarity, and one below, so that
    nodes of less similar documents die out, although they share a passage. A branching keeps a pair with probability
    0.84 (0.8 below); being branched four times in each of eight trees loses it with 0.008, none with 1e-11. node: most
    classes that are compared exhaustively at once. loose: least share of equal signature values of a candidate, four
    standard deviations below 0.8 with 64 values. close: that of members for which a leader stands; whatever is linked
    with these has similarity 0.65 at least to the leader, by the triangle inequality, and usually more, and meets another in each tree.
    """

    words: int = 5
    percent: int = 80
    signature: int = 64
    trees: int = 8
    branches: int = 2
    node: int = 256
    loose: float = 0.6
    close: float = 0.85


#: What a text with a set has: a character that isn't ASCII white space.
NOT_BLANK = r"[^ \t-\r]"
#: Words whose keys a worker holds; bounds its memory, not results.
CACHE_WORDS = 300_000
_words: dict[bytes, int] = {}


def shingles(raw: bytes, words: int):
    """Sorted distinct 64-bit keys of a text's shingles; ASCII lower case and white space."""
    import numpy as np
    import xxhash

    tokens = raw.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    keys = []
    for w in tokens:
        k = _words.get(w)
        if k is None:
            k = _words[w] = xxhash.xxh64_intdigest(w)
        keys.append(k)
    x = np.array(keys, np.uint64)
    n = min(words, len(x))
    with np.errstate(over="ignore"):
        out = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


#: Keys of one pass, and for each signature size its permutations and two buffers: fresh temporaries would cost more than the arithmetic.
PASS = 1024
_scratch: dict[int, tuple] = {}


def signature(keys, size: int):
    """Minwise values of a set under `size` fixed permutations of 32-bit keys."""
    import numpy as np

    if size not in _scratch:
        rng = np.random.default_rng(20_001)
        odd, shift = rng.integers(0, 1 << 31, (size, 1), np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (size, 1), np.uint32)
        _scratch[size] = odd, shift, np.empty((size, PASS), np.uint32), np.empty((size, PASS), np.uint32)
    odd, shift, x, y = _scratch[size]
    high = (keys >> np.uint64(32)).astype(np.uint32)
    least = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), PASS):
        part = high[None, at : at + PASS]
        a, b = x[:, : part.shape[1]], y[:, : part.shape[1]]
        np.add(part, shift, out=a)
        for _ in range(2):
            np.right_shift(a, 15, out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, odd, out=a)
        np.right_shift(a, 16, out=b)
        np.bitwise_xor(a, b, out=a)
        np.minimum(least, a.min(1), least)
    return least.view(np.int32)


def class_key(keys) -> int | None:
    import xxhash

    return xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63) if len(keys) else None


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): the key tells rows apart that have no id or the same one."""
    return docs.select("doc_id", text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))


def shingled(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, signature) of each row; class is null for an empty set."""
    words, size = settings.words, settings.signature

    def run(batches):
        import pyarrow as pa

        take_worker("near_dedup", _words, _scratch)
        for batch in batches:
            n, classes, sigs = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                keys = shingles(text.as_py(), words)
                n.append(len(keys))
                classes.append(class_key(keys))
                sigs.append(signature(keys, size) if len(keys) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "text_key", "n_shingles", "class", "signature"])

    return keyed(docs).mapInArrow(run, f"doc_id {id_type(docs)}, text_key bigint, n_shingles bigint, class bigint, signature array<int>")


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def branch(nodes: DataFrame, settings: Settings, many) -> DataFrame:
    """Children of (node, class, signature), as many as the column says: each node's path selects the tokens by which it branches."""
    picks = F.transform(F.sequence(F.lit(1), many), lambda j: F.pmod(F.xxhash64("node", j), F.lit(settings.signature)).cast("int"))
    token = F.array_distinct(F.transform(picks, lambda p: F.xxhash64("node", p, F.get("signature", p))))
    return nodes.select(F.explode(token).alias("node"), "class")


def runs(batches, column: int):
    """Groups of rows with equal values of a column, over batches sorted by it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, value = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column(column))
        begin = 0
        for v, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
            if held and v != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = v
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield value, pa.Table.from_batches(held)


class Sets:
    """Disjoint sets of the members 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def matrix(lists, size: int):
    import numpy as np

    return np.asarray(lists.combine_chunks().flatten()).reshape(-1, size)


def compare_nodes(members: DataFrame, settings: Settings) -> DataFrame:
    """Candidate edges (a, b) of nodes of bounded size: a spanning forest of the pairs with similar signatures. members: (node, class, signature)."""
    least, size = settings.loose * settings.signature, settings.signature

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, table in runs(batches, 0):
            classes, sigs = table["class"].to_pylist(), matrix(table["signature"], size)
            sets, edges = Sets(len(classes)), []
            for i in range(len(classes) - 1):
                for j in np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(1) >= least) + i + 1:
                    if sets.join(i, int(j)):
                        edges.append((classes[i], classes[int(j)]))
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a bigint, b bigint")


def agreement(a: str, b: str) -> str:
    """Number of places in which two signatures agree."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)"


def folded(met: DataFrame) -> DataFrame:
    """Edges that connect what the edges (a, b) from members to leaders do: each member's to the first of its leaders, and that one's to the others, once for all members that met the same. A member has no more leaders than it was in nodes."""
    leaders = materialise(met.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("of")), "leaders-met")
    others = leaders.where(F.size("of") > 1).select("of").distinct().select(F.get("of", F.lit(0)).alias("a"), F.explode(F.expr("slice(of, 2, size(of))")).alias("b"))
    return leaders.select("a", F.get("of", F.lit(0)).alias("b")).union(others.distinct())


def candidates(classes: DataFrame, settings: Settings) -> DataFrame:
    """Candidate edges (a, b) of the trees. classes: (class, signature)."""
    roots = classes.select(F.explode(F.array(*(F.lit(t).cast("long") for t in range(settings.trees)))).alias("node"), "class", "signature")
    nodes, levels, found = branch(roots, settings, F.lit(settings.branches)), [], []
    while True:
        nodes = materialise(nodes, "nodes")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("class", F.lit(1)), 24)).alias("y"))
        sizes = materialise(sizes.where("size > 1"), "node-sizes")
        levels.append((nodes, sizes.where(F.col("size") <= settings.node)))
        large = sizes.where(F.col("size") > settings.node).select("node")
        if large.isEmpty():
            break
        leaders = nodes.join(large, "node").groupBy("node").agg(F.min_by("class", F.xxhash64("class", "node")).alias("class"))
        leaders = leaders.join(classes, "class").select("node", F.col("class").alias("leader"), F.col("signature").alias("leads"))
        told = nodes.join(leaders, "node").join(classes, "class").where("class != leader").withColumn("agree", F.expr(agreement("signature", "leads")))
        told = materialise(told.select("node", "class", "signature", "leader", "agree"), "told")
        found.append(told.where(F.col("agree") >= settings.loose * settings.signature).select(F.col("class").alias("a"), F.col("leader").alias("b")))
        more = F.when(F.pmod(F.xxhash64("node", F.lit("more")), F.lit(4)) == 0, 2).otherwise(1) if len(levels) <= 3 else F.lit(1)
        nodes = branch(told.where(F.col("agree") < settings.close * settings.signature), settings, more)
    # many nodes have the same members: comparing one of them is enough
    chosen = reduce(DataFrame.union, (sizes for _, sizes in levels)).groupBy("size", "x", "y").agg(F.min("node").alias("node")).select("node")
    small = reduce(DataFrame.union, (nodes for nodes, _ in levels)).join(chosen, "node").join(classes, "class").select("node", "class", "signature")
    pairs = compare_nodes(small, settings)
    return folded(reduce(DataFrame.union, found)).union(pairs) if found else pairs


def same(x, y) -> int:
    """Size of the intersection of two sorted sets."""
    import numpy as np

    small, large = (x, y) if len(x) < len(y) else (y, x)
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[place] == small).sum())


def full_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(group, class, keys) of the wanted classes, computed from one row each. wanted: (doc_id, text_key, class, group)."""
    words = settings.words

    def run(batches):
        import pyarrow as pa

        take_worker("near_dedup", _words, _scratch)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = [shingles(raw, words).tobytes() for raw in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary())], ["group", "class", "keys"])

    rows, wanted = keyed(docs), wanted.withColumnsRenamed({"doc_id": "of", "text_key": "key"})
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key"))).select("group", "class", "text")
    return rows.mapInArrow(run, "group bigint, class bigint, keys binary").dropDuplicates(["class"])


def against_leaders(sets: DataFrame, leaders: DataFrame) -> DataFrame:
    """(group, class, leader, inter, size, leader_size) of each class against its group's leader. A group's rows are spread over 16 joins of its leader."""
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(16)))
    leaders = leaders.select("group", F.col("class").alias("leader"), F.col("keys").alias("leader_keys"), F.explode(F.expr("sequence(0L, 15L)")).alias("salt"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = ([np.frombuffer(k, np.uint64) for k in batch.column(c).to_pylist()] for c in (3, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([same(a, b) for a, b in zip(x, y)], pa.int64()), pa.array([len(a) for a in x], pa.int64()), pa.array([len(b) for b in y], pa.int64())], ["group", "class", "leader", "inter", "size", "leader_size"])

    joined = salted.join(leaders, ["group", "salt"]).select("group", "class", "leader", "keys", "leader_keys")
    return joined.mapInArrow(run, "group bigint, class bigint, leader bigint, inter bigint, size bigint, leader_size bigint")


def verify_blocks(sets: DataFrame, settings: Settings, block: int) -> DataFrame:
    """True links (a, b) within groups, as spanning forests. A group of more than `block` classes is dealt in parts, and each pair of parts is compared somewhere."""
    percent = settings.percent
    sizes = sets.groupBy("group").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") * 2 / block).cast("long")
    rows = sets.join(sizes, "group").withColumn("parts", F.when(F.col("members") <= block, 1).otherwise(parts))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class", F.lit(7)), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "part", "other", "class", "keys")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, table in runs(batches, 0):
            table = table.sort_by("class")
            classes, keys = table["class"].to_pylist(), [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
            part, own = table["part"].to_pylist(), table["part"].to_pylist() == table["other"].to_pylist()
            sets_, edges = Sets(len(classes)), []
            for i in range(len(classes)):
                for j in range(i + 1, len(classes)):
                    if not own and part[i] == part[j]:
                        continue  # those are compared in their part's own cell
                    n, m = len(keys[i]), len(keys[j])
                    if 100 * min(n, m) < percent * max(n, m) or sets_.find(i) == sets_.find(j):
                        continue
                    both = same(keys[i], keys[j])
                    if 100 * both >= percent * (n + m - both):
                        sets_.join(i, j)
                        edges.append((classes[i], classes[j]))
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def links(sets: DataFrame, settings: Settings, rounds: int = 4) -> DataFrame:
    """True links (a, b) that connect what the true links within each group connect. sets: (group, class, keys).

    In a large group, all are compared with a leader. Let g be the largest similarity below the threshold t. Whoever is
    closer than t - g to the leader (in Jaccard distance, a metric) is linked with nothing that the leader isn't linked
    with, so the leader stands for it and it needs no more comparisons. The rest goes on with another leader, at last
    in blocks.
    """
    found, t = [], settings.percent
    for _ in range(rounds):
        groups = sets.groupBy("group").agg(F.count("*").alias("members"), F.min("class").alias("class")).where(F.col("members") > settings.node)
        groups = materialise(groups.select("group", "class"), "large-groups")
        if groups.isEmpty():
            break
        large = sets.join(groups.select("group"), "group")
        told = materialise(against_leaders(large, sets.join(groups, ["group", "class"])), "leaders")
        linked = F.expr(f"100 * inter >= {t} * (size + leader_size - inter)")
        close = F.col("inter") / (F.col("size") + F.col("leader_size") - F.col("inter"))
        found.append(told.where(linked & (F.col("class") != F.col("leader"))).select(F.col("class").alias("a"), F.col("leader").alias("b")))
        gaps = told.groupBy("group").agg(F.coalesce(F.max(F.when(~linked, close)), F.lit(0.0)).alias("gap"))
        done = told.join(gaps, "group").where(linked & (1 - close < t / 100 - F.col("gap") - 1e-9) | (F.col("class") == F.col("leader"))).select("class")
        sets = materialise(sets.join(done, "class", "left_anti"), "left-sets")
    found.append(verify_blocks(sets, settings, settings.node))
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def with_components(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, first) of every row: component is null for an empty set, first is the component's first (nameless, doc_id, text_key)."""
    rows = materialise(shingled(docs, settings), "shingled")
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    classes = rows.where("class is not null").groupBy("class").agg(F.min(named).alias("first"), F.min("signature").alias("signature"))
    classes = materialise(classes, "classes")
    grouped = materialise(components(candidates(classes.select("class", "signature"), settings)), "groups")
    wanted = classes.join(grouped, classes["class"] == grouped["node"]).select("first.doc_id", "first.text_key", "class", F.col("component").alias("group"))
    sets = materialise(full_sets(docs, wanted, settings), "sets")
    joined = components(links(sets, settings)).withColumnRenamed("node", "class")
    of_class = classes.select("class", "first").join(joined, "class", "left").select("class", "first", F.coalesce("component", "class").alias("component"))
    of_class = materialise(of_class, "class-components")
    least = of_class.groupBy("component").agg(F.min("first").alias("first"))
    ids = of_class.select("class", "component").join(least, "component")
    return rows.select("doc_id", "text_key", "n_shingles", "class").join(ids, "class", "left").drop("class")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: components of links at the threshold; the smallest doc_id of each is kept."""
    out = with_components(docs, settings)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each component, in all its columns: that with the smallest doc_id, null ids last, then by a hash of the text; of rows equal in both, any one. Rows with an empty set all stay."""
    found = with_components(docs, settings)
    first = found.where("component is not null").select(F.col("first.doc_id").alias("of"), F.col("first.text_key").alias("key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text_of()).alias("hash"), (F.col("text").isNull() | ~F.col("text").rlike(NOT_BLANK)).alias("blank"))
    same = rows["row.doc_id"].eqNullSafe(first["of"]) & (rows["hash"] == first["key"])
    kept = rows.where("not blank").join(first, same, "left_semi").withColumn("of", F.col("row.doc_id")).dropDuplicates(["of", "hash"])
    return kept.select("row.*").union(rows.where("blank").select("row.*"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four-word shingles, similarity 0.8."""
    return near_duplicates(documents(spark, sf_dir), Settings(words=4))
