"""Fuzzy line deduplication in DataFrame operations only.

Lines are normalised (lower case, everything but letters and digits to single blanks). Equal normalised lines are one
line. The features of a line are the pairs of its consecutive long words, as short ones are common everywhere, and of a
line that is short or has few long words those of all its words, too; edges count as words. The features with the smallest hashes are the line's sketch.
Every two places of a sketch make a block.
In each block, lines in order of length are first candidates with the one before them and with the block's first. What
that leaves unconnected within a block is then compared exactly: every two of its lines of different groups whose lengths
allow it, tile by tile, so that no task holds more than two tiles of a block. Two lines are near if their lengths allow the edit similarity, and either the
shortest edit of words has it, or that of characters has it and the one of words leaves three fifths of them.
Near candidates are linked, and of each connected group the occurrence with the smallest (doc_id, text, line number) stays.

SimHash blocks were tried first: one word in twelve changes about eight of 64 bits, and no blocks that tolerate this
tell other lines apart, so nine of ten near lines were missed. Two lines meet here if their sketches share two features;
which do is a matter of chance, and near copies are missed the more often, the more words their edits touch.

Lines without letters or digits always stay. Null texts have no lines. Rows with a null doc_id stay as they are and take
no part. A document is a doc_id and a text: rows that repeat both are one, rows that repeat only the id are several.
Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialise, text_of
from .graph import components


@dataclass(frozen=True)
class Settings:
    """places: of a sketch. long_word: least bytes of a long word. short_line: most words of a short line. similarity: least edit similarity."""

    places: int = 6
    long_word: int = 5
    short_line: int = 12
    similarity: float = 0.8

    def most(self, a: str, b: str) -> str:
        """The largest edit distance of lines of these lengths."""
        return f"cast(floor(greatest({a}, {b}) * {1 - self.similarity:.9f} + 1e-9) as int)"


#: Lines of a tile of a block, few enough for its pairs to be a small part of a task's; the least lines of a block that has pairs beyond the first candidates.
TILE, CROWD = 128, 4
#: What parts a line's words (fixed value).
BETWEEN_WORDS = "[^\\\\p{L}\\\\p{N}]+"


def sketch(words: str, settings: Settings) -> str:
    """The smallest 32-bit hashes of a line's distinct features, in ascending order. Its long words are a column."""
    pairs = lambda ws: f"zip_with(concat(array(''), {ws}), concat({ws}, array('')), (a, b) -> hash(a, b))"
    features = f"if(size({words}) <= {settings.short_line} or 4 * size(long_words) < size({words}), concat({pairs(words)}, {pairs('long_words')}), {pairs('long_words')})"
    return f"slice(sort_array(array_distinct({features})), 1, {settings.places})"


def lines_of(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_key, line_no, line, n, sketch, norm) of each line; line is the hash of its normalised text, n its length, 0 for a line without content."""
    rows = docs.where("doc_id is not null").select("doc_id", text_of().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "text_key", "line_no", F.expr(f"array_remove(split(lower(raw), '{BETWEEN_WORDS}'), '')").alias("words"))
    rows = rows.select("*", F.array_join("words", " ").alias("norm"), F.filter("words", lambda w: F.octet_length(w) >= settings.long_word).alias("long_words"))
    return rows.select("doc_id", "text_key", "line_no", F.xxhash64("norm").alias("line"), F.length("norm").alias("n"), F.expr(sketch("words", settings)).alias("sketch"), "norm")


def blocks_of(sketches: DataFrame, settings: Settings) -> DataFrame:
    """(block, line, n, place, line_1, n_1, line_2, n_2) of the lines in blocks of two or more: their place by length from 1, the line before and the block's first. sketches: distinct (line, n, sketch)."""
    at = lambda k: F.get("sketch", F.lit(k))
    blocks = [F.when(at(j).isNotNull(), F.xxhash64(at(i), at(j))) for j in range(1, settings.places) for i in range(j)]
    rows = sketches.select(F.explode(F.array_distinct(F.array(*blocks))).alias("block"), "line", "n").where("block is not null")
    in_block = Window.partitionBy("block").orderBy("n", "line")
    near = (("place", F.row_number()), ("line_1", F.lag("line")), ("n_1", F.lag("n")), ("line_2", F.first("line")), ("n_2", F.first("n")), ("more", F.lead("line")))
    met = rows.select("block", "line", "n", *(f.over(in_block).alias(c) for c, f in near))
    return met.where("line_1 is not null or more is not null").drop("more")


def candidate_pairs(blocks: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b), a < b, of lines that are neighbours in some block and whose lengths allow the edit similarity."""
    pairs = blocks.where("line_1 is not null").select("line", "n", F.expr("stack(2, line_1, n_1, line_2, n_2) as (other, m)")).where(f"line != other and abs(n - m) <= {settings.most('n', 'm')}")
    return pairs.select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b")).distinct()


def links_left(blocks: DataFrame, groups: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): groups, or lines without one, that near lines of a block link. Every two lines of a block are compared whose groups differ and whose lengths allow it, once for all their blocks; a block of one group has nothing to add."""
    own = groups.select(F.col("node").alias("line"), F.col("component").alias("g"))
    rows = blocks.select("block", "line", "n", "place").join(own, "line", "left").withColumn("g", F.coalesce("g", "line"))
    unsettled = rows.groupBy("block").agg(F.count("*").alias("many"), F.min("g").alias("g_1"), F.max("g").alias("g_2")).where(f"many >= {CROWD} and g_1 < g_2")
    rows = rows.join(unsettled.select("block"), "block", "left_semi").withColumn("tile", F.expr(f"(place - 1) div {TILE}"))
    own = rows.groupBy("line").agg(F.collect_set("block").alias("blocks"))
    texts = texts.withColumn("words", F.expr("transform(array_distinct(split(codes, '')), c -> ascii(c))"))
    rows = materialise(rows.join(own, "line").join(texts, "line"), "line-crowds")
    tiles = rows.groupBy("block", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    ij = tiles.select("block", F.col("tile").alias("i"), F.col("hi").alias("n")).join(tiles.select("block", F.col("tile").alias("j"), F.col("lo").alias("m")), "block").where(f"i <= j and m - n <= {settings.most('n', 'm')}").select("block", "i", "j")
    many = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is kept: few bytes are much work here
    a, b = (rows.select("block", F.col("tile").alias(t), *(F.col(c).alias(f"{c}_{x}") for c in ("place", "g", "n", "blocks", "words", "codes", "norm"))).join(ij, ["block", t]).repartition(many, "block", "i", "j") for x, t in (("a", "i"), ("b", "j")))
    words = "greatest(length(codes_a), length(codes_b))"
    by_words = lambda most: f"levenshtein(codes_a, codes_b, {most}) >= 0"
    # a distinct word that the other line lacks is an edit; counting those takes far less than the edits themselves
    may = f"greatest(size(words_a), size(words_b)) - size(array_intersect(words_a, words_b)) <= {words} * 2 div 5"
    near = f"{may} and {by_words(f'cast({words} * 2 div 5 as int)')} and ({by_words(settings.most('length(codes_a)', 'length(codes_b)'))} or levenshtein(norm_a, norm_b, {settings.most('n_a', 'n_b')}) >= 0)"
    same = " and ".join(f"a.{c} = b.{c}" for c in ("block", "i", "j"))
    once = "a.block = array_min(array_intersect(blocks_a, blocks_b))"  # two lines share up to all blocks of their sketches
    met = a.alias("a").join(b.alias("b"), F.expr(f"{same} and place_a < place_b and g_a != g_b and abs(n_a - n_b) <= {settings.most('n_a', 'n_b')} and {once} and {near}"))
    return met.select(F.least("g_a", "g_b").alias("a"), F.greatest("g_a", "g_b").alias("b")).distinct()


def word_codes(norm: str) -> str:
    """A string with one character for each word, a hash of it, so that levenshtein() of two such strings counts words."""
    return f"decode(unhex(array_join(transform(split({norm}, ' '), w -> hex(pmod(hash(w), 51200) + 4096)), '')), 'UTF-16BE')"


def judged(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, near): pairs that are near by edits of words, and those that may still be by edits of characters. texts: distinct (line, norm, codes)."""
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("line").alias(x), F.col("codes").alias(f"c{x}")), x)
    pairs = pairs.withColumn("words", F.expr("greatest(length(ca), length(cb))"))
    near = f"levenshtein(ca, cb, {settings.most('words', 'words')}) >= 0"
    rows = pairs.select("a", "b", "ca", "cb", "words", F.expr(near).alias("near"))
    return rows.where("near or levenshtein(ca, cb, cast(words * 2 div 5 as int)) >= 0").select("a", "b", "near")


def near_by_characters(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("line").alias(x), F.col("norm").alias(f"t{x}")), x)
    return pairs.where(F.expr(f"levenshtein(ta, tb, {settings.most('length(ta)', 'length(tb)')}) >= 0")).select("a", "b")


def near_groups(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """(node, component) of the lines that near pairs connect. Edits of words are cheap to count and come first; what they have connected needs no count of characters."""
    rows = materialise(judged(pairs, texts, settings), "line-judged")
    by_words = rows.where("near").select("a", "b")
    groups = materialise(components(by_words), "line-components")
    rest = rows.where("not near").select("a", "b")
    for x in "ab":
        own = groups.select(F.col("node").alias(x), F.col("component").alias(f"g{x}"))
        rest = rest.join(own, x, "left").withColumn(f"g{x}", F.coalesce(f"g{x}", x))
    more = materialise(near_by_characters(rest.where("ga != gb").select("a", "b"), texts, settings), "line-links")
    return groups if more.isEmpty() else components(by_words.union(more))


def dropped_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_key, dropped array<int>): numbers from 0 of the lines that go, for documents that lose any; text_key is xxhash64 of the text."""
    lines = materialise(lines_of(docs, settings), "lines").where("n > 0")
    place = F.struct("doc_id", "text_key", "line_no")
    distinct = lines.groupBy("line").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.min_by("sketch", "n").alias("sketch"), F.count("*").alias("many"))
    distinct = materialise(distinct, "distinct-lines")
    blocks = materialise(blocks_of(distinct.select("line", "n", "sketch"), settings), "line-blocks")
    pairs = materialise(candidate_pairs(blocks, settings), "line-pairs")
    wanted = blocks.select("line").distinct()
    # one occurrence of each line that meets another in a block
    texts = lines.join(distinct.select("line", "first").join(wanted, "line", "left_semi"), "line").where(place == F.col("first"))
    texts = materialise(texts.select("line", "norm", F.expr(word_codes("norm")).alias("codes")).dropDuplicates(["line"]), "line-texts")
    groups = materialise(near_groups(pairs, texts, settings), "line-near")
    more = materialise(links_left(blocks, groups, texts, settings), "line-rest")
    if not more.isEmpty():
        groups = components(more.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    groups = groups.select(F.col("node").alias("line"), F.col("component").alias("grp"))
    merged = materialise(distinct.select("line", "first").join(groups, "line"), "line-groups")
    keep = merged.groupBy("grp").agg(F.min("first").alias("keep"))
    moved = merged.join(keep, "grp").select("line", "keep")
    # a line that occurs once and is in no group can't go
    keeps = distinct.join(moved, "line", "left").where("many > 1 or keep is not null").select("line", F.coalesce("keep", "first").alias("keep"))
    gone = lines.select("line", "doc_id", "text_key", "line_no").join(keeps, "line").where(place != F.col("keep"))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def with_dropped(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(row struct, dropped): the documents' columns as one struct, so that none can clash, and their line numbers."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("of"), F.xxhash64(text_of()).alias("key"))
    gone = gone.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "dropped")
    return rows.join(gone, ["of", "key"], "left").select("row", "dropped")


def drop_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without their dropped lines, with n_chars set anew, and without documents of which nothing but blank lines is left."""
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    out = with_dropped(docs, gone).withColumn("left", F.when(F.col("dropped").isNotNull(), left))
    out = out.where("dropped is null or left rlike '\\\\S'")
    new = {"text": F.coalesce("left", "row.text"), "n_chars": F.coalesce(F.length("left").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def deduplicate_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return drop_lines(docs, materialise(dropped_lines(docs, settings), "dropped-lines"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines and the numbers of those that go."""
    docs = documents(spark, sf_dir).select("doc_id", text_of().alias("text"))
    gone = materialise(dropped_lines(docs), "dropped-lines")
    counts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(F.split("text", "\n")).alias("n_lines"), F.length("text").alias("n_chars"))
    out = counts.join(gone, ["doc_id", "text_key"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", "n_chars", F.size("dropped").alias("n_dropped"), "dropped")
