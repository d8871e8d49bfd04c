"""Ranked lexical search over stored postings, with MaxScore in each shard.

The index holds shards of bounded bytes of text. A shard's documents are numbered by ascending id; each of its terms has
a row with its postings, its most occurrences and the length of its shortest document, which bound the term's score
whatever the corpus' statistics are. Those (documents with terms, terms in all, documents with each term) are sums over
all shards. A search reads the rows of its items' terms only. In each shard an item's terms are ordered by their bounds;
those whose bounds together don't exceed the tenth best score so far are non-essential: documents come from the
essential lists alone, in growing ranges of documents, and the non-essential lists are probed, greatest bound first,
only for documents that can still qualify. A shard gives its ten best, and these are ranked again over all shards.

Terms, weights and scores are those of `ranked`; all but the logarithm is in whole numbers. Items come in batches of
bounded size, each over the same index, so that a worker never holds more of them than that.

A null or empty text has no terms; such a document is never found, and such an item finds nothing. Rows with null or
repeated doc_id are documents of their own (nulls first). Items with the same id and text count once; with the same id
and other texts each is ranked alone. Other columns are ignored. A text of any length is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialise, text_of, type_of

#: Characters that end a term: ASCII but letters and digits. Only A-Z are lower-cased.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """most: documents ranked for an item. shard_bytes: of text in a shard. batch_terms: about as many (item, term) pairs are searched at once. first_range: documents of a shard's first range."""

    most: int = 10
    shard_bytes: int = 12 << 20
    batch_terms: int = 200_000
    first_range: int = 64
    last_range: int = 4096


def terms_in(texts):
    """(terms, number of terms of each text) of an Arrow string array without nulls."""
    import numpy as np
    import pyarrow as pa

    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    begin, end = int(offsets[0]), int(offsets[-1])
    if begin == end:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2].slice(begin, end - begin).to_pybytes().translate(LETTERS), np.uint8)
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0] - begin
    first[heads] = inside[heads]
    kept = data[inside]
    starts = np.flatnonzero(first[inside]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(kept)))), pa.py_buffer(kept))
    before = np.append(0, np.cumsum(first, dtype=np.int64))
    return found, np.diff(before[offsets - begin])


def shard_of(ids, texts):
    """(ids, lengths, terms, first posting of each term, documents, occurrences) of one shard, its documents in ascending order of ids."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    order = pc.array_sort_indices(ids, null_placement="at_start")
    ids = ids.take(order)
    found, lengths = terms_in(texts)
    place = np.empty(len(texts), np.int64)
    place[np.asarray(order)] = np.arange(len(texts))
    coded = found.dictionary_encode()
    names = coded.dictionary
    by_name = np.asarray(pc.array_sort_indices(names))
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    keys = rank[np.asarray(coded.indices)] << 32
    keys += np.repeat(place, lengths)
    keys.sort()
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    occurrences = np.diff(np.append(new, len(keys))).astype(np.int32)
    posted = keys[new]
    first = np.flatnonzero(np.diff(posted >> 32, prepend=-1))
    return ids, lengths[np.asarray(order)], names.take(pa.array(by_name)), first, (posted & 0xFFFFFFFF).astype(np.int32), occurrences


def index(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the postings of all of docs and reads them back: a row for each term of a shard, and one without a term for its documents and their lengths."""
    kind = type_of(docs, id_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
        for batch in batches:
            ends, at = np.cumsum(np.asarray(pc.binary_length(batch.column(1))), dtype=np.int64), 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + settings.shard_bytes, "right")) - at)
                ids, lengths, names, first, docs_of, occurrences = shard_of(batch.column(0).slice(at, n), batch.column(1).slice(at, n))
                bounds, many = np.append(first, len(docs_of)), len(names)
                most = np.maximum.reduceat(occurrences, first) if many else occurrences
                least = np.minimum.reduceat(lengths[docs_of], first) if many else lengths[:0]
                no_ids, no_lengths = pa.nulls(many, pa.list_(ids.type)), pa.nulls(many, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, shard)), names, pa.array(np.diff(bounds)), pa.array(most.astype(np.int64)), pa.array(least), lists(bounds, pa.array(docs_of)), lists(bounds, pa.array(occurrences)), no_ids, no_lengths], COLUMNS)
                no_term, own = pa.nulls(1, pa.int64()), np.array([0, len(ids)])
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), no_term, no_term, no_term, pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), lists(own, ids), lists(own, pa.array(lengths))], COLUMNS)
                at, shard = at + n, shard + 1

    schema = f"shard bigint, term string, df bigint, most bigint, least bigint, docs array<int>, occurrences array<int>, ids array<{kind}>, lengths array<bigint>"
    return materialise(docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).mapInArrow(run, schema), "postings")


COLUMNS = ["shard", "term", "df", "most", "least", "docs", "occurrences", "ids", "lengths"]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term): each item's terms once; item tells apart items of one id."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found, counts = terms_in(batch.column(2))
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), found], ["item", "item_id", "term"])

    named = items.select(F.xxhash64(F.col(id_col), text_of(text_col)).alias("item"), F.col(id_col).alias("item_id"), text_of(text_col).alias("text"))
    return named.mapInArrow(run, f"item bigint, item_id {type_of(items, id_col)}, term string").distinct()


@dataclass
class Postings:
    """A term's postings in a shard, and the most that it adds to a score there."""

    docs: object
    occurrences: object
    weight: int
    bound: int
    added: object = None

    def scores(self, lengths_part, at=slice(None)):
        """What the term adds to the scores of the documents of its postings `at`."""
        if self.added is None:
            tf = self.occurrences.astype("i8")
            self.added = self.weight * (1_000_000_000 * tf // (1000 * tf + 8 * lengths_part[self.docs]))
        return self.added[at]


def best_of_shard(terms: list[Postings], lengths_part, most: int, first_range: int = 64, last_range: int = 4096, seen=None):
    """(documents, scores) of the best of a shard, by descending score and ascending document. seen: a list that gets the number of postings read."""
    import numpy as np

    terms = sorted(terms, key=lambda t: t.bound)
    sums = np.append(0, np.cumsum([t.bound for t in terms]))  # of the bounds of the terms before each
    docs, scores, least, low, size = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0, first_range
    while low < len(lengths_part):
        high = min(low + size, len(lengths_part))
        size = min(2 * size, last_range)
        # documents of the first `essential` terms alone can't exceed the least score that counts
        essential = int(np.searchsorted(sums, least, "right")) - 1
        got = np.zeros(high - low, np.int64)
        for t in terms[essential:]:
            a, b = np.searchsorted(t.docs, (low, high))
            if a < b:
                got[t.docs[a:b] - low] += t.scores(lengths_part, slice(a, b))
                if seen is not None:
                    seen.append(b - a)
        found = np.flatnonzero((got > 0) & (got + sums[essential] > least))
        own = got[found]
        for k in range(essential - 1, -1, -1):
            if not len(found):
                break
            t = terms[k]
            at = np.minimum(np.searchsorted(t.docs, found + low), len(t.docs) - 1)
            hit = t.docs[at] == found + low
            own[hit] += t.scores(lengths_part, at[hit])
            if seen is not None:
                seen.append(len(found))
            still = own + sums[k] > least
            found, own = found[still], own[still]
        if len(found):
            docs, scores = np.append(docs, found + low), np.append(scores, own)
            best = np.lexsort((docs, -scores))[:most]
            docs, scores = docs[best], scores[best]
            least = int(scores[-1]) if len(scores) == most else 0
        low = high
    return docs, scores


def searched(stored: DataFrame, weighted: list, item_type: str, id_type: str, documents_count: int, terms_count: int, settings: Settings) -> DataFrame:
    """(item, item_id, doc_id, score): the best of each shard for each item of one batch. weighted: (item, item_id, term, weight) rows of the batch."""
    names = sorted({r["term"] for r in weighted})
    number = {t: k for k, t in enumerate(names)}
    weights, wanted, item_ids = {r["term"]: r["weight"] for r in weighted}, {}, {}
    for r in weighted:
        wanted.setdefault(r["item"], []).append(number[r["term"]])
        item_ids[r["item"]] = r["item_id"]
    weight_of = [weights[t] for t in names]

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = pa.schema([("item", pa.int64()), ("item_id", item_pa), ("doc_id", table.schema.field("ids").type.value_type), ("score", pa.int64())])
        own = table.filter(pc.is_null(table["term"]))
        lengths, ids = own["lengths"].combine_chunks().flatten().to_numpy(), own["ids"].combine_chunks().flatten()
        part = 100 - 90 + (90 * lengths * documents_count) // terms_count
        rows = table.filter(pc.is_valid(table["term"])).combine_chunks()
        docs, occurrences = (rows[c].combine_chunks() if rows.num_rows else None for c in ("docs", "occurrences"))
        found = {}
        for k, (term, most, least) in enumerate(zip(rows["term"].to_pylist(), rows["most"].to_pylist(), rows["least"].to_pylist())):
            w = weight_of[number[term]]
            bound = w * (1_000_000_000 * most // (1000 * most + 8 * (100 - 90 + (90 * least * documents_count) // terms_count)))
            if w > 0:
                found[number[term]] = Postings(docs[k].values.to_numpy(), occurrences[k].values.to_numpy(), w, bound)
        items, at, scores = [], [], []
        for item, terms in wanted.items():
            if here := [found[t] for t in terms if t in found]:
                d, s = best_of_shard(here, part, settings.most, settings.first_range, settings.last_range)
                items += [item] * len(d)
                at.append(d)
                scores.append(s)
        if not items:
            return out.empty_table()
        return pa.table([pa.array(items, pa.int64()), pa.array([item_ids[i] for i in items], item_pa), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], schema=out)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    item_pa = to_arrow_type(_parse_datatype_string(item_type))
    asked = stored.sparkSession.createDataFrame([(t,) for t in names], "term string")
    rows = stored.join(F.broadcast(asked), "term", "left_semi").unionByName(stored.where("term is null"))  # asked holds no more than batch_terms
    return rows.select("shard", "term", "most", "least", "docs", "occurrences", "ids", "lengths").groupBy("shard").applyInArrow(lambda table: run(table.drop_columns("shard")), f"item bigint, item_id {item_type}, doc_id {id_type}, score bigint")


def ranked(stored: DataFrame, items: DataFrame, settings: Settings = Settings(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's best documents in an index.

    Of N documents with terms, L terms in all, a document's n terms and tf of a term that df documents hold: the term's
    weight is floor(1000 ln((2N+2) / (2df+1))), the document's part m = 100 - 90 + (90 n N) div L, and its score the sum
    of weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms. Equal scores go by ascending doc_id.
    """
    spark, item_type = stored.sparkSession, type_of(items, id_col)
    id_type = stored.schema["ids"].dataType.elementType.simpleString()
    counted = lambda f: F.aggregate(F.transform("lengths", f), F.lit(0).cast("bigint"), lambda a, x: a + x)
    total = stored.where("term is null").agg(F.sum(counted(lambda x: F.when(x > 0, 1).otherwise(0).cast("bigint"))).alias("n"), F.sum(counted(lambda x: x)).alias("l")).first()  # one row
    n, length = total["n"] or 0, total["l"] or 0
    terms = item_terms(items, id_col, text_col)
    found = stored.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighted = materialise(terms.join(found, "term").select("item", "item_id", "term", weight.alias("weight")), "item-terms")
    batches = 1 + weighted.count() // settings.batch_terms
    out = None
    for k in range(batches):
        rows = weighted.where(F.pmod("item", F.lit(batches)) == k).collect()  # of bounded size
        part = searched(stored, rows, item_type, id_type, n, max(length, 1), settings)
        out = part if out is None else out.union(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.most).select("item_id", "rank", "doc_id", "score")


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked(index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERMS = r"list_transform(regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
ORACLE_SQL = f"""with d as (select row_number() over () k, doc_id, {TERMS.format("text")} t from documents where text is not null),
 s as (select count(*) n_docs, sum(len(t)) n_terms from d where len(t) > 0),
 p as (select k, term, count(*) tf from (select k, unnest(t) term from d) group by 1, 2),
 f as (select term, count(*) df from p group by 1),
 q as (select distinct item_id, unnest({TERMS.format("text")}) term from benchmark where text is not null),
 w as (select item_id, term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) w from q join f using (term), s),
 r as (select item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(t) * n_docs) // n_terms)))) score from w join p using (term) join d using (k), s group by 1, 2),
 o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from r join d using (k) where score > 0)
 select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) score from o where rank <= 10"""
