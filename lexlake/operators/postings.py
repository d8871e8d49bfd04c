"""Search over stored postings with positions: blocks, segments, conjunctions, phrases, ranks and fragments.

The postings are one row for each term and block, in folders by the term's hash, sorted by term and block, so that a query
reads its own terms' pages only: the keys of the block's records that hold the term, their lengths and the term's spots in
them. A spot is a whole number, the field's number above 27 bits of the position; an array of more words than that has no
room in a row. A block is some thousand records in the order in which they were read (cut where a batch of them ends);
beside the postings each row has a head: its least and greatest key and its number of records. The heads tell in which
blocks all terms of a conjunction occur, and how far a capped search must read. Phrases are decided by spots, without
texts. Each record also has a spot under the empty term, so that the postings alone hold what there is, and how long it is.

Tasks group a batch of records by term before anything is shuffled: what moves is four bytes a word and a row for each term
of a block, not a row for each word.

Records that are added later make segments of their own; a record of a newer segment takes the place of an older one of
the same key, and one without a length there is a deletion. `merge` makes one segment of all. Which segments count is
read from the greatest version of a small log: a reader sees all of an addition or nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions import english
from lexlake.sources.tables import exists

from .paging import capped
from .search import Query, parse_query, tokens

#: Under which each record has one hit.
EVERY = ""
#: Bits of a position in a spot, and most fields.
POSITION_BITS, FIELDS = 27, 16
#: A segment's rows.
STORED = "term string, block bigint, first bigint, last bigint, n bigint, keys array<bigint>, lengths array<int>, spots array<array<int>>"
#: Words whose lexeme a worker remembers.
REMEMBERED = 1 << 20
#: Blocks that a capped search looks at first; then four times as many, and so on.
FIRST_BLOCKS = 64


@dataclass(frozen=True)
class Layout:
    """buckets: folders by the term's hash. block: records of a block, a power of two of at most 2^33. analyser: "simple" (words as they are) or "english" (stems, no stop words)."""

    buckets: int = 32
    block: int = 4096
    analyser: str = "simple"

    def lexeme(self, word: str) -> str | None:
        return english.lexeme(word) if self.analyser == "english" else word


def bucket(term, layout: Layout) -> Column:
    return (F.crc32(F.col(term)) % layout.buckets).cast("int")


_lexemes: dict[str, str | None] = {}


def lexemes(words: list[str]) -> list[str | None]:
    """The English lexemes of distinct words, None for those that have none. A worker stems a word once, as long as it remembers it."""
    if len(_lexemes) > REMEMBERED:
        _lexemes.clear()
    for w in words:
        if w not in _lexemes:
            _lexemes[w] = w if w == EVERY else english.lexeme(w)
    return [_lexemes[w] for w in words]


def grouped(batch: pa.RecordBatch, analyser: str) -> pa.RecordBatch:
    """A batch (block, key, a list of words for each field) as rows of STORED."""
    n, fields = batch.num_rows, batch.columns[2:]
    block, key = batch.column(0).to_numpy(), batch.column(1)
    sizes = [f.value_lengths().to_numpy(zero_copy_only=False) for f in fields]
    row = np.concatenate([np.arange(n), *(np.repeat(np.arange(n), s) for s in sizes)])
    place = lambda s: np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + 1
    spot = np.concatenate([np.zeros(n, np.int64), *((k << POSITION_BITS) + place(s) for k, s in enumerate(sizes))]).astype(np.int32)
    words = pa.chunked_array([pa.array([EVERY] * n, pa.string()), *(f.flatten().cast(pa.string()) for f in fields)]).combine_chunks().dictionary_encode()
    code, terms = words.indices.to_numpy().astype(np.int64), words.dictionary
    if analyser == "english":
        found = pa.array(lexemes(terms.to_pylist()), pa.string()).dictionary_encode()
        code, terms = found.indices.fill_null(-1).to_numpy().astype(np.int64)[code], found.dictionary
        has = code >= 0
        row, spot, code = row[has], spot[has], code[has]
    order = np.argsort(code * n + row, kind="stable")  # fields and positions are in order within a record
    row, spot, code = row[order], spot[order], code[order]
    starts = lambda *by: np.concatenate([[0], np.flatnonzero(np.any([b[1:] != b[:-1] for b in by], axis=0)) + 1, [len(by[0])]])
    ofs = starts(code, row)  # of each term's records
    row, code = row[ofs[:-1]], code[ofs[:-1]]
    at = starts(code, block[row])
    ends = lambda f, none: f.reduceat(key.fill_null(none).to_numpy()[row], at[:-1])
    lengths = sum(sizes, np.zeros(n, np.int64)).astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
    most = np.iinfo(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            terms.take(pa.array(code[at[:-1]])), pa.array(block[row[at[:-1]]]), pa.array(ends(np.minimum, most.max)), pa.array(ends(np.maximum, most.min)), pa.array(np.diff(at)),
            listed(key.take(pa.array(row))), listed(pa.array(lengths[row])), listed(pa.ListArray.from_arrays(pa.array(ofs, pa.int32()), pa.array(spot))),
        ],
        ["term", "block", "first", "last", "n", "keys", "lengths", "spots"],
    )


def hits(rows: DataFrame, key: str, fields: list[str], layout: Layout) -> DataFrame:
    """STORED rows of every word of the fields, whose numbers are their places in the list, under the analyser's terms; positions begin at 1. A null field has no words."""
    if len(fields) > FIELDS:
        raise ValueError(f"more than {FIELDS} fields")
    block = F.expr(f"monotonically_increasing_id() div {layout.block}").alias("block")
    words = rows.select(block, F.col(key).cast("bigint").alias("key"), *(F.coalesce(tokens(f), F.array().cast("array<string>")).alias(f"_{k}") for k, f in enumerate(fields)))
    analyser = layout.analyser
    return words.mapInArrow(lambda batches: (grouped(b, analyser) for b in batches if b.num_rows), STORED)


def each_record(stored: DataFrame) -> DataFrame:
    """(segment, block, term, key, length, spots) of each record of STORED rows."""
    return stored.select("segment", "block", "term", F.inline(F.arrays_zip("keys", "lengths", "spots")).alias("key", "length", "spots"))


_opened: dict[tuple, DataFrame] = {}


@dataclass(frozen=True)
class Index:
    """Stored segments, oldest first."""

    spark: SparkSession
    path: str
    layout: Layout
    version: int
    segments: tuple[int, ...]

    def stored(self, part: str, terms: list[str] | None) -> DataFrame:
        where = (self.spark.sparkContext.applicationId, self.path, part, self.version)
        if where not in _opened:  # segments never change, so what a version lists needs listing once
            _opened[where] = self.spark.read.parquet(f"{self.path}/{part}").where(F.col("segment").isin(list(self.segments)))
        rows = _opened[where]
        if terms is None:
            return rows
        buckets = sorted({zlib.crc32(t.encode()) % self.layout.buckets for t in terms})
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def rows(self, terms: list[str] | None = None) -> DataFrame:
        """(segment, block, term, key, length, spots) of some terms, or all: a scan of these terms' folders and pages."""
        return each_record(self.stored("data", terms))

    def heads(self, terms: list[str] | None = None) -> DataFrame:
        """(segment, term, block, first, last, n) of some terms, or all; a block that a batch cut has several rows."""
        return self.stored("heads", terms)

    def live(self, found: DataFrame) -> DataFrame:
        """Hits (segment, key, ...) without those that a newer segment's record has replaced, and without deletions."""
        if len(self.segments) > 1:
            newer = self.rows([EVERY]).where(F.col("segment") > self.segments[0]).select(F.col("segment").alias("_by"), F.col("key").alias("_key"))
            latest = newer.groupBy("_key").agg(F.max("_by").alias("_by"))
            found = found.join(latest, (F.col("key") == F.col("_key")) & (F.col("segment") < F.col("_by")), "left_anti")
        return found.where("length is not null")

    def records(self) -> DataFrame:
        """(key, length) of every record."""
        return self.live(self.rows([EVERY])).select("key", "length")


def open_index(spark: SparkSession, path: str, layout: Layout = Layout()) -> Index:
    """The index at a path as its last version has it; without segments where there is none."""
    if not exists(spark, f"{path}/versions"):
        return Index(spark, path, layout, 0, ())
    last = spark.read.schema("version bigint, segments array<bigint>").parquet(f"{path}/versions").orderBy(F.desc("version")).first()
    return Index(spark, path, layout, last["version"], tuple(last["segments"]))


def committed(index: Index, segments: tuple[int, ...]) -> Index:
    """Makes these the index's segments: one more row of the log, which is all that readers look at first."""
    row = index.spark.createDataFrame([(index.version + 1, list(segments))], "version bigint, segments array<bigint>")
    row.coalesce(1).write.mode("append").parquet(f"{index.path}/versions")
    return Index(index.spark, index.path, index.layout, index.version + 1, segments)


def written(index: Index, found: DataFrame) -> int:
    """Stores STORED rows and their heads as a new segment, which nothing reads yet; its number."""
    segment = index.version + 1
    put = lambda rows, part: rows.withColumn("bucket", bucket("term", index.layout)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block", "first").write.mode("overwrite").option("parquet.block.size", str(16 << 20)).partitionBy("bucket").parquet(f"{index.path}/{part}/segment={segment}")
    put(found, "data")
    put(index.spark.read.schema(STORED).parquet(f"{index.path}/data/segment={segment}").select("term", "block", "first", "last", "n"), "heads")
    return segment


def add(index: Index, rows: DataFrame, key: str, fields: list[str], deleted: DataFrame | None = None) -> Index:
    """The index with more records; those of a key that it has are replaced. deleted: rows whose keys go."""
    found = hits(rows, key, fields, index.layout)
    if deleted is not None:
        block, k = F.expr(f"-1 - monotonically_increasing_id() div {index.layout.block}").alias("block"), F.col(key).cast("bigint")
        gone = deleted.select(F.lit(EVERY).alias("term"), block, k.alias("first"), k.alias("last"), F.lit(1).cast("bigint").alias("n"), F.array(k).alias("keys"), F.array(F.lit(None).cast("int")).alias("lengths"), F.array(F.array(F.lit(0))).alias("spots"))
        found = found.unionByName(gone)
    return committed(index, (*index.segments, written(index, found)))


def merge(index: Index) -> Index:
    """One segment of all live records, in blocks by ascending key. The old segments' files stay for readers that opened them."""
    if not index.segments:
        return index
    place = F.expr(f"monotonically_increasing_id() div {index.layout.block}")
    placed = index.records().select("key").distinct().repartitionByRange("key").sortWithinPartitions("key").select(F.col("key").alias("_own"), place.alias("block"))
    found = index.live(index.rows()).select("term", "key", "length", "spots")
    blocks = found.join(placed, F.col("key") == F.col("_own")).groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("key", "length", "spots"))).alias("own"))
    own = blocks.select("term", "block", F.get("own.key", F.lit(0)).alias("first"), F.element_at("own.key", -1).alias("last"), F.size("own").cast("bigint").alias("n"), F.col("own.key").alias("keys"), F.col("own.length").alias("lengths"), F.col("own.spots").alias("spots"))
    return committed(index, (written(index, own),))


# --- queries


def analysed_query(text: str, layout: Layout) -> Query:
    """The query's terms as the index has them. A word that has none asks for nothing; in a phrase it may be anything."""
    query = parse_query(text)
    for a in query.alternatives:
        for part in ("must", "not"):
            a[part] = [t for t in map(layout.lexeme, a[part]) if t]
        a["phrases"] = [[(k, t) for k, t in enumerate(map(layout.lexeme, p)) if t] for p in a["phrases"]]
        a["phrases"] = [p for p in a["phrases"] if p]
    query.alternatives = [a for a in query.alternatives if a["must"] or a["phrases"]]
    return query


def needed(alternative: dict) -> list[str]:
    return [*alternative["must"], *(t for p in alternative["phrases"] for _, t in p)]


def asked_terms(query: Query) -> list[str]:
    """Terms that count for ranks, without the excluded ones."""
    return sorted({t for a in query.alternatives for t in needed(a)})


def all_terms(query: Query) -> list[str]:
    return sorted({*asked_terms(query), *(t for a in query.alternatives for t in a["not"])})


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def has_all(terms: Column, wanted: list[str]) -> Column:
    return F.size(F.array_intersect(terms, F.array(*map(F.lit, wanted)))) == len(set(wanted))


def of_term(found: Column | str, term: str) -> Column:
    return F.filter(found, lambda h: h["term"] == term)


def spots_of(found: Column | str, term: str) -> Column:
    return F.flatten(F.transform(of_term(found, term), lambda h: h["spots"]))


def phrase(found: Column, words: list[tuple[int, str]]) -> Column:
    """Whether (term, spots) hold the words (place, term) in a row within a field."""
    begins = lambda place, term: F.transform(spots_of(found, term), lambda x: x - place)
    common = begins(*words[0])
    for w in words[1:]:
        common = F.array_intersect(common, begins(*w))
    return F.size(common) > 0


def satisfied(query: Query, found: Column) -> Column:
    terms = F.transform(found, lambda h: h["term"])
    each = []
    for a in query.alternatives:
        one = has_all(terms, a["must"]) if a["must"] else F.lit(True)
        for p in a["phrases"]:
            one = one & phrase(found, p)
        each.append(one & ~F.arrays_overlap(terms, F.array(*map(F.lit, a["not"]))) if a["not"] else one)
    return any_of(each)


def candidates(index: Index, query: Query) -> DataFrame:
    """(segment, block, first) of blocks in which an alternative's terms all occur, from the heads alone."""
    each = index.heads(asked_terms(query)).groupBy("segment", "block").agg(F.collect_set("term").alias("terms"), F.min("first").alias("first"))
    return each.where(any_of(has_all(F.col("terms"), needed(a)) for a in query.alternatives)).drop("terms")


def matches(index: Index, text: str, below=None) -> DataFrame:
    """(key, length, hits array<struct<term, field, position>>) of records that match a query; hits are of its terms alone, in order of field and position. below: only keys less than that."""
    query = analysed_query(text, index.layout)
    if not query.alternatives or not index.segments:
        return index.spark.createDataFrame([], "key bigint, length int, hits array<struct<term:string,field:int,position:int>>")
    rows, blocks = index.stored("data", all_terms(query)), candidates(index, query)
    if below is not None:
        rows, blocks = rows.where(F.col("first") < F.lit(below)), blocks.where(F.col("first") < F.lit(below))
    own = each_record(rows.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi"))
    if below is not None:
        own = own.where(F.col("key") < F.lit(below))
    records = index.live(own).groupBy("key").agg(F.first("length").alias("length"), F.collect_list(F.struct("term", "spots")).alias("_found")).where(satisfied(query, F.col("_found")))
    placed = F.flatten(F.transform("_found", lambda f: F.transform(f["spots"], lambda x: F.struct(x.alias("spot"), f["term"].alias("term")))))
    shaped = F.transform(F.sort_array(placed), lambda h: F.struct(h["term"].alias("term"), F.shiftright(h["spot"], POSITION_BITS).alias("field"), h["spot"].bitwiseAND((1 << POSITION_BITS) - 1).alias("position")))
    return records.select("key", "length", shaped.alias("hits"))


def first_matches(index: Index, text: str, cap: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """The `cap` matches of the least keys, with `saturated`: whether there are more.

    Blocks are read in the order of their first keys until cap + 1 matches lie below the next block's: a common word costs
    a few blocks, not all its postings.
    """
    query, most, below = analysed_query(text, index.layout), first_blocks, None
    if query.alternatives and index.segments:
        while True:
            ahead = candidates(index, query).orderBy("first").offset(most).limit(1).collect()
            below = ahead[0]["first"] if ahead else None
            if below is None or matches(index, text, below).limit(cap + 1).count() > cap:
                break
            most *= 4
    return capped(matches(index, text, below), [F.asc("key")], cap)


def share_rank(query: Query) -> Column:
    """Hits of the asked terms for each thousand words, in whole numbers."""
    own = F.size(F.filter("hits", lambda h: h["term"].isin(asked_terms(query)))).cast("bigint")
    return F.expr("1L") * F.floor(own * 1000 / F.greatest(F.col("length"), F.lit(1))).cast("bigint")


def term_counts(index: Index, terms: list[str]) -> DataFrame:
    """(term, df): live records that hold each term. With one segment, from the heads."""
    if len(index.segments) == 1:
        return index.heads(terms).groupBy("term").agg(F.sum("n").alias("df"))
    return index.live(index.rows(terms)).groupBy("term").agg(F.count_distinct("key").alias("df"))


def bm25(index: Index, found: DataFrame, text: str, weights: list[int]) -> DataFrame:
    """found with `score`: field-weighted BM25 in whole numbers.

    Of N records with L words in all, a record's length l, a term's df and its hits weighted by field, tf: idf is
    floor(1000 ln((2N + 2) / (2 df + 1))), saturation (2200000 tf) div (1000 tf + 300 + (900 l N) div L).
    """
    terms = asked_terms(analysed_query(text, index.layout))
    if not terms or not index.segments:
        return found.withColumn("score", F.lit(0).cast("bigint"))
    total = index.records().agg(F.count("*").alias("_n"), F.greatest(F.sum(F.col("length").cast("bigint")), F.lit(1)).alias("_l"))
    df = term_counts(index, terms).groupBy().agg(*(F.max(F.when(F.col("term") == t, F.col("df"))).alias(f"_df{k}") for k, t in enumerate(terms)))
    rows = found.join(F.broadcast(total), F.lit(True)).join(F.broadcast(df), F.lit(True))  # one row each
    weight = F.array(*map(F.lit, weights))
    score = F.lit(0).cast("bigint")
    for k, t in enumerate(terms):
        rows = rows.withColumn(f"_tf{k}", F.aggregate(of_term("hits", t), F.lit(0).cast("bigint"), lambda s, h: s + F.get(weight, h["field"])))
        idf = F.floor(1000 * F.log((2 * F.col("_n") + 2).cast("double") / (2 * F.col(f"_df{k}") + 1).cast("double"))).cast("bigint")
        part = F.expr(f"(2200000 * _tf{k}) div (1000 * _tf{k} + 300 + (900 * cast(length as bigint) * _n) div _l)")
        score = score + F.coalesce(F.when(F.col(f"_tf{k}") > 0, idf * part), F.lit(0).cast("bigint"))
    return rows.withColumn("score", score).drop("_n", "_l", *(f"_{c}{k}" for c in ("df", "tf") for k in range(len(terms))))


def best_window(found: Column | str, terms: list[str], most: int = 25) -> Column:
    """struct<many, begin, end> of the window of at most so many words that holds the most distinct terms, of these the shortest, then the first; null without hits.

    One pass over the hits of one field in the order of their positions: at each of them, the terms' last positions tell the best window that ends there.
    """
    found = F.col(found) if isinstance(found, str) else found
    none = F.array(*(F.lit(None).cast("int") for _ in terms))
    start = F.struct(none.alias("last"), F.lit(None).cast("struct<many:int,short:int,begin:int>").alias("best"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda x, k: F.when(F.element_at(F.array(*map(F.lit, terms)), k + 1) == hit["term"], hit["position"]).otherwise(x))
        near = F.filter(last, lambda x: x > hit["position"] - most)
        begin = F.array_min(near)
        here = F.struct(F.size(near).alias("many"), (begin - hit["position"]).alias("short"), (-begin).alias("begin"))
        return F.struct(last.alias("last"), F.greatest(state["best"], here).alias("best"))

    best = F.aggregate(found, start, step, lambda s: s["best"])
    return F.when(best.isNotNull(), F.struct(best["many"].alias("many"), (-best["begin"]).alias("begin"), (-best["begin"] - best["short"]).alias("end")))


def fragments(index: Index, found: DataFrame, text: str, texts: DataFrame, key: str, fields: list[str], most: int = 25, least: int = 15, marks: tuple[str, str] = ("⟦H⟧", "⟦/H⟧")) -> DataFrame:
    """(key, field, snippet): the best window of each found record, of the first field that has any hit, with hits marked.

    Windows shorter than `least` words are widened. Words are the analyser's; what stands between them is not kept. found should
    be a page: its texts are read here.
    """
    terms = asked_terms(analysed_query(text, index.layout))
    rows = found.select("key", "hits").withColumn("field", F.array_min(F.transform("hits", lambda h: h["field"])))
    rows = rows.withColumn("own", F.filter("hits", lambda h: (h["field"] == F.col("field")) & h["term"].isin(terms))).withColumn("w", best_window("own", terms, most))
    rows = rows.withColumn("_at", F.greatest(F.lit(1), F.least(F.col("w.begin"), F.col("w.end") - least + 1)))
    rows = rows.withColumn("_n", F.greatest(F.col("w.end") - F.col("_at") + 1, F.lit(least)))
    spots = F.filter(F.transform("own", lambda h: h["position"]), lambda p: (p >= F.col("_at")) & (p < F.col("_at") + F.col("_n")))
    rows = rows.select("key", "field", "_at", "_n", spots.alias("_spots"))
    # windows and texts meet; texts are cut to words only then, and only the field that is shown
    shown = rows.join(texts.select(F.col(key).alias("_own"), F.array(*(F.col(f) for f in fields)).alias("_texts")), F.col("key") == F.col("_own"))
    words = F.slice(tokens(F.get("_texts", F.col("field"))), F.col("_at"), F.col("_n"))
    marked = F.transform(words, lambda x, i: F.when(F.array_contains("_spots", i + F.col("_at")), F.concat(F.lit(marks[0]), x, F.lit(marks[1]))).otherwise(x))
    return shown.select("key", "field", F.array_join(marked, " ").alias("snippet"))


def build(spark: SparkSession, rows: DataFrame, key: str, fields: list[str], path: str, layout: Layout = Layout()) -> Index:
    """An index of rows at a path that has none."""
    return add(open_index(spark, path, layout), rows, key, fields)
