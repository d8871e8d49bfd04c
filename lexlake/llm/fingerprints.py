"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text is cut into cells, clauses of its paragraphs with what parts them, at most so many characters each. Each distinct
cell has a digest, and each digest goes to one stratum: half of them to the first, a quarter to the second and so on. A
stratum is a sketch of its own, three tables of counters in each of which the digest has one place. Two versions'
sketches subtract place by place; what they share cancels, and peeling places with a single digest recovers those that
differ. Strata are tried from the sparsest on, each about twice as full as the one before. If all can be peeled the
difference is exact.

The fingerprint is the sketch itself as a string. Where a stratum sticks, those that were peeled tell about how many digests
differ, and a larger table is made for that number, again of counters in which what both share cancels. Places with a
single digest are recovered; what lies in others is dealt again, by another hash and with twice the room for each digest,
until nothing is left, so the likeness of the query is exact but for equal digests of different cells. A retry needs
the texts' digests besides the fingerprints. With nothing but two fingerprints, `likeness` takes the estimate. The work on
one text grows with its cells, in the task that holds the text.

Null texts count as empty. Two texts without cells are alike (1). Equal texts have equal fingerprints, and so have texts of
the same set of cells. A row with a null doc_id comes last in descending order; rows with equal doc_id follow by text. The
only row of a table is its own next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, text_of

#: Most characters of a cell. Places in each of the three tables of a stratum. Strata; the last holds what is left.
CELL, PLACES, STRATA = 64, 8, 14
BETWEEN = r".,;:!?\\n"
#: Places for each digest that is expected to differ, as a power of two: of the first retry, one more each time. Most retries; what the last one leaves is compared digest by digest.
ROOM, RETRIES = 1, 8
ZERO = "named_struct('c', 0, 'k', 0L, 'x', 0L)"


def digests(text: str) -> str:
    """Distinct 32-bit digests of a text's cells."""
    cells = f"regexp_extract_all({text}, '[^{BETWEEN}]{{1,{CELL}}}[{BETWEEN}]*|[{BETWEEN}]+', 0)"
    return f"array_distinct(transform({cells}, c -> shiftrightunsigned(xxhash64(c), 32)))"


def check(digest: str) -> str:
    return f"(xxhash64({digest}) & 65535L)"


def addresses(digest: str) -> str:
    """A digest's places, counted over the three tables, as fields p0, p1, p2."""
    return ", ".join(f"'p{t}', cast((shiftrightunsigned(xxhash64({digest}), {40 + 3 * t}) & {PLACES - 1}L) + {t * PLACES} as int)" for t in range(3))


def addressed(digest_array: str) -> str:
    return f"transform({digest_array}, d -> named_struct('k', d, 'x', {check('d')}, {addresses('d')}))"


def counters(addressed_: str) -> str:
    """Three tables of PLACES counters: count c, xor of digests k, xor of their checks x. addressed_: an array of addressed digests."""
    table = lambda t: f"transform(sequence({t * PLACES}, {(t + 1) * PLACES - 1}), i -> aggregate(filter({addressed_}, d -> d.p{t} = i), {ZERO}, (a, d) -> named_struct('c', a.c + 1, 'k', a.k ^ d.k, 'x', a.x ^ d.x)))"
    return f"concat({', '.join(map(table, range(3)))})"


def sketch(digest_array: str) -> str:
    """n: number of distinct digests. strata: counters of each stratum, none where it is empty."""
    # the stratum is the number of zero bits that a digest ends with; each step parts what is left
    own, rest = f"filter(t.left, d -> s = {STRATA - 1} or (d.k & shiftleft(1L, s)) != 0)", "filter(t.left, d -> (d.k & shiftleft(1L, s)) = 0)"
    none = f"filter(array({ZERO}), u -> false)"
    parted = f"transform(array({own}), own -> named_struct('left', {rest}, 'out', concat(t.out, array(if(size(own) = 0, {none}, {counters('own')})))))[0]"
    step = f"if(size(t.left) = 0, named_struct('left', t.left, 'out', concat(t.out, array({none}))), {parted})"
    start = f"named_struct('left', {addressed('ds')}, 'out', filter(array(array({ZERO})), c -> false))"
    return f"transform(array({digest_array}), ds -> named_struct('n', size(ds), 'strata', aggregate(sequence(0, {STRATA - 1}), {start}, (t, s) -> {step}, t -> t.out)))[0]"


def as_string(sketch_: str) -> str:
    """The number of digests, then each stratum's counters, each in hexadecimal digits, empty ones as nothing."""
    counter = "if(u.c = 0, '', concat_ws('.', lower(hex(u.c)), lower(hex(u.k)), lower(hex(u.x))))"
    strata = f"transform({sketch_}.strata, s -> array_join(transform(s, u -> {counter}), ','))"
    return f"concat_ws('|', {sketch_}.n, array_join({strata}, '|'))"


def from_string(fingerprint: str) -> str:
    """The sketch that a fingerprint spells."""
    number = lambda k: f"cast(conv(split(u, '[.]')[{k}], 16, 10) as bigint)"
    counter = f"if(u = '', {ZERO}, named_struct('c', cast({number(0)} as int), 'k', {number(1)}, 'x', {number(2)}))"
    strata = f"transform(slice(split({fingerprint}, '[|]'), 2, {STRATA}), s -> if(s = '', array(), transform(split(s, ','), u -> {counter})))"
    return f"named_struct('n', cast(split({fingerprint}, '[|]')[0] as int), 'strata', {strata})"


def subtracted(a: str, b: str) -> str:
    """Differences of two strata's counters; a stratum without counters is one of zeros."""
    minus = "named_struct('c', coalesce(u.c, 0) - coalesce(v.c, 0), 'k', coalesce(u.k, 0L) ^ coalesce(v.k, 0L), 'x', coalesce(u.x, 0L) ^ coalesce(v.x, 0L))"
    return f"zip_with({a}, {b}, (u, v) -> {minus})"


def peeled(cells: str, rounds: int = 7) -> str:
    """Signed digests that a difference holds (c: 1 only in the first, -1 only in the second), null if peeling gets stuck."""
    pure = f"transform(array_distinct(filter(s.cells, u -> abs(u.c) = 1 and {check('u.k')} = u.x)), u -> named_struct('c', u.c, 'k', u.k, 'x', u.x, {addresses('u.k')}))"
    # a round without pure places is the last
    fewer = "transform(s.cells, (u, i) -> aggregate(filter(pure, p -> p.p0 = i or p.p1 = i or p.p2 = i), u, (a, p) -> named_struct('c', a.c - p.c, 'k', a.k ^ p.k, 'x', a.x ^ p.x)))"
    found = "concat(s.found, transform(pure, p -> named_struct('c', p.c, 'k', p.k, 'x', p.x)))"
    step = f"if(s.done, s, transform(array({pure}), pure -> if(size(pure) = 0, named_struct('cells', s.cells, 'found', s.found, 'done', true), named_struct('cells', {fewer}, 'found', {found}, 'done', false)))[0])"
    start = f"named_struct('cells', {cells}, 'found', filter({cells}, u -> false), 'done', false)"
    return f"aggregate(sequence(1, {rounds}), {start}, (s, r) -> {step}, s -> if(exists(s.cells, u -> u.c != 0 or u.k != 0L or u.x != 0L), null, s.found))"


def strata_difference(a: str, b: str) -> str:
    """found: digests recovered from two sketches; at: the stratum that can't be peeled, below which nothing is known, or -1 if found are all that differ."""
    of_stratum = f"transform(array({subtracted(f'{a}.strata[i]', f'{b}.strata[i]')}), cells -> if(exists(cells, u -> u.c != 0 or u.k != 0L), array_size({peeled('cells')}), 0))[0]"
    # the size of what can't be peeled is null
    step = f"if(t.at >= 0, t, transform(array({of_stratum}), m -> if(m is null, named_struct('at', i, 'found', t.found), named_struct('at', -1, 'found', t.found + m)))[0])"
    return f"aggregate(sequence({STRATA - 1}, 0, -1), named_struct('at', -1, 'found', 0), (t, i) -> {step})"


def differing(a: str, b: str, known: str) -> str:
    """How many digests of two sketches differ, between what their sizes allow: exactly if known.at is -1, else about."""
    about = f"if({known}.at < 0, {known}.found, cast({known}.found * shiftleft(1L, {known}.at + 1) as int))"
    return f"greatest(abs({a}.n - {b}.n), least({a}.n + {b}.n, {about}))"


def alike(a: str, b: str, differ: str) -> str:
    """Shared over all digests, 0 to 1, from their numbers and the number that differ."""
    both = f"({a}.n + {b}.n)"
    return f"if({both} = 0, 1D, transform(array({differ}), d -> cast({both} - d as double) / ({both} + d))[0])"


def likeness(a: str, b: str) -> str:
    """Likeness of two sketches by themselves: exact if all strata can be peeled, else an estimate."""
    return alike(a, b, f"transform(array({strata_difference(a, b)}), known -> {differing(a, b, 'known')})[0]")


def likeness_retried(a: str, b: str, digests_a: str, digests_b: str) -> str:
    """Likeness of two sketches; where a stratum can't be peeled, from larger ones that are made of their digests."""
    retried = f"if(known.at < 0, known.found, {remaining(digests_a, digests_b, differing(a, b, 'known'))})"
    return alike(a, b, f"transform(array({strata_difference(a, b)}), known -> {retried})[0]")


def signed(a: str, b: str) -> str:
    """Digests of two arrays as one array of numbers, each twice the digest, and one more for the second's."""
    return f"concat(transform({a}, d -> shiftleft(d, 1)), transform({b}, d -> shiftleft(d, 1) | 1L))"


def attempts(signed_: str, places: str, salt: str) -> str:
    """A sketch of so many places of the difference that signed digests make, but for empty places: each with its digests e, their count c and xor k, and whether it is `empty` or `pure` after what both have cancelled.

    Digests lie in the order of their places, so that each place is a slice of them and a sketch takes as many steps as there are digests.
    """
    hashed = f"array_sort(transform({signed_}, e -> shiftleft(shiftrightunsigned(xxhash64(shiftrightunsigned(e, 1), {salt}), 34), 33) | e))"
    place = lambda e: f"shiftright(shiftrightunsigned({e}, 33) * ({places}), 30)"
    starts = f"filter(sequence(1, size(es)), i -> if(i = 1, true, {place('es[i - 1]')} <> {place('es[i - 2]')}))"
    slices = f"transform(array({starts}), ss -> transform(ss, (s, j) -> transform(slice(es, s, if(j + 1 < size(ss), ss[j + 1], size(es) + 1) - s), e -> e & {(1 << 33) - 1}L)))[0]"
    counter = "named_struct('c', 0, 'k', 0L, 'x', 0L)"
    more = "named_struct('c', u.c + if((e & 1L) = 0L, 1, -1), 'k', u.k ^ shiftrightunsigned(e, 1), 'x', u.x ^ xxhash64(shiftrightunsigned(e, 1)))"
    seen = "named_struct('e', z, 'c', u.c, 'k', u.k, 'empty', u.c = 0 and u.k = 0L and u.x = 0L, 'pure', abs(u.c) = 1 and xxhash64(u.k) = u.x)"
    counted = f"transform({slices}, z -> aggregate(z, {counter}, (u, e) -> {more}, u -> {seen}))"
    return f"transform(array({hashed}), es -> {counted})[0]"


def difference(a: str, b: str, places: int) -> str:
    """Digests (c, k) that differ between two digest arrays, from one table of so many places alone; null if a place holds more than one of them."""
    found = "transform(filter(zs, z -> z.pure), z -> named_struct('c', z.c, 'k', z.k))"
    return f"transform(array({attempts(signed(a, b), f'{places}L', '0')}), zs -> if(exists(zs, z -> not z.empty and not z.pure), null, {found}))[0]"


def remaining(a: str, b: str, expected: str) -> str:
    """How many digests differ between two digest arrays, of which about `expected` do: what a table can't tell is dealt again by another hash to a larger one, each time."""
    places = f"greatest(1L, shiftleft(cast(if(r = 0, {expected}, size(t.e)) as bigint), r + {ROOM}))"
    stuck = "flatten(transform(filter(zs, z -> not z.empty and not z.pure), z -> z.e))"
    found = "aggregate(zs, t.n, (n, z) -> n + if(z.pure, 1, 0))"
    again = f"transform(array({places}), places -> transform(array({attempts('t.e', 'places', 'r')}), zs -> named_struct('e', {stuck}, 'n', {found}))[0])[0]"
    step = f"if(size(t.e) = 0, t, {again})"
    side = lambda k: f"transform(filter(t.e, e -> (e & 1L) = {k}L), e -> shiftrightunsigned(e, 1))"
    rest = f"t.n + if(size(t.e) = 0, 0, size(array_except({side(0)}, {side(1)})) + size(array_except({side(1)}, {side(0)})))"
    return f"aggregate(sequence(0, {RETRIES - 1}), named_struct('e', {signed(a, b)}, 'n', 0), (t, r) -> {step}, t -> {rest})"


def ranges(docs: DataFrame) -> DataFrame:
    """docs with `part`: ranges of doc_id of about equal size, as many as there are shuffle partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    bounds = (docs.agg(F.percentile_approx("doc_id", F.lit(shares), F.lit(10 * parts))).first()[0] if shares else None) or []
    bounds = sorted(set(bounds))
    if not bounds:
        return docs.withColumn("part", F.lit(0))
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    less = lambda b: b < F.col("doc_id")
    coarse = F.size(F.filter(F.array(*(F.lit(x[0]) for x in fine)), less))  # groups of bounds that begin below the id
    within = F.size(F.filter(F.get(F.array(*(F.array(*map(F.lit, x)) for x in fine)), coarse - 1), less))
    return docs.withColumn("part", F.when(F.col("doc_id").isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + within))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next row in descending doc_id, after the last the first. One shuffle of the texts, by ranges of doc_id."""
    rows = ranges(docs.select("doc_id", text_of().alias("text")))
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("part")).collect()  # a row for each range
    if not heads:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    follows = [(a["part"], b["doc_id"]) for a, b in zip(heads, [*heads[1:], heads[0]])]
    pairs = F.array(*(F.struct(F.lit(p).cast("int").alias("part"), F.lit(h).cast("bigint").alias("head")) for p, h in follows))
    follow = docs.sparkSession.range(1).select(F.inline(pairs))
    first = F.min("text").alias("head_text")
    texts = rows.where(F.col("doc_id").isin([h for _, h in follows if h is not None])).groupBy(F.col("doc_id").alias("head")).agg(first)
    if any(h is None for _, h in follows):
        texts = texts.union(rows.where("doc_id is null").groupBy(F.col("doc_id").alias("head")).agg(first))
    follow = follow.join(texts, follow["head"].eqNullSafe(texts["head"])).select("part", "head_text")
    lead = F.lead("text").over(Window.partitionBy("part").orderBy(F.desc("doc_id"), "text"))
    return rows.withColumn("lead", lead).join(follow, "part").select("doc_id", "text", F.coalesce("lead", "head_text").alias("next_text"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like the fingerprints are of it, of that and of the next document."""
    rows = with_next(documents(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    texts = (("own", "text"), ("new", "edited"), ("next", "next_text"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(F.expr(digests(c)).alias(f"{a}_digests") for a, c in texts))
    rows = rows.select("*", *(F.expr(sketch(f"{a}_digests")).alias(a) for a, _ in texts))
    near = lambda other: F.expr(likeness_retried("own", other, "own_digests", f"{other}_digests"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(as_string("own")).alias("fingerprint"), F.expr(as_string("new")).alias("edited_fingerprint"),
        near("new").alias("near_edited"), near("next").alias("near_next"),
    )
