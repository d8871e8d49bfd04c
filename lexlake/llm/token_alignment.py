"""Alignment of two tokenizers' tokens by byte-owner arrays, and counts of the id pairs that they link.

A is a byte-level BPE, B a SentencePiece model that puts a blank before a text; both encode a text's own characters, with
a blank in front. np.repeat gives each byte the index of the token that owns it, for A and for B. Where either owner
changes a new overlap begins; where both change at once, a new group. A group's A tokens are linked with all its B
tokens. Documents come in blocks of bounded bytes; a block stores each document's distinct pairs as numbers into the
block's own sorted list of pairs, with how many documents of the block hold each. Spark sums these over blocks (partial
sums, one row for a pair and block), takes the highest of each A id, and joins the sums back to the blocks' lists;
a block's documents meet its list once more. No task holds more than a block, and no pair's rows outnumber the blocks.

Texts that are null or empty, or whose tokens' bytes of A or of B aren't the blank and the text, have no tokens. Rows
with null or repeated doc_id count as a document each; doc_id may have any type. A text of any length is aligned
whole, and a group of any size is counted by its distinct ids. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WHOLE, WordEncoder
from .common import documents, materialise, text_of, type_of

SPACE = "▁"
#: Links of a group above which its ids are counted before they are paired; pairs of a stored row, and rows that are sent at once.
LARGE_GROUP, LIST_ROW, LIST_ROWS = 1 << 16, 4096, 64
#: Words of one call of the SentencePiece library; its queue of merges is longer the more there are.
CALL = 50


@dataclass(frozen=True)
class Settings:
    """block_bytes: of text that is counted at once. align_bytes: of text that is aligned at once, which takes some 40 times that of memory."""

    block_bytes: int = 16 << 20
    align_bytes: int = 2 << 20


class LedByteEncoder(WordEncoder):
    """Byte-level ids of texts that begin with the blank put before them; special tokens' strings are plain text."""

    uncut = WHOLE.removeprefix("^[ \\n]|") + "|" + SPACE

    def __init__(self, path: str):
        super().__init__(path, literal=True)

    def clear(self) -> None:
        super().clear()
        self.words[""], self.starts[1], self.counts[1] = 1, 1, 0  # what is left of each text's first cut


class LedPieceEncoder(LedByteEncoder):
    """SentencePiece ids of the same texts. No piece holds a newline, nor a blank but at its begin or in a run of blanks, so isolated blanks and newlines cut these as well."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.vocab_size())]
        if any("\n" in p or SPACE in p[1:] and set(p) != {SPACE} for p in names):
            self.uncut = "(?s)."
        self.newline = self.pieces.piece_to_id("<0x0A>")
        self.clear()

    def whole(self, text: str):
        import numpy as np

        if text[:1] == " ":
            return np.array(self.pieces.encode(text[1:]), "<u4")
        return np.array(self.pieces.encode("\n" + text)[2:], "<u4")  # without the blank and the newline before it

    def ids_of(self, words: list[str]) -> tuple:
        import numpy as np

        joined = ["\n" + "\n".join(words[k : k + CALL]) for k in range(0, len(words), CALL)]
        ids = np.array([x for y in self.pieces.encode(joined, num_threads=1) for x in (*y[2:], self.newline)], "<u4")
        ends = np.flatnonzero(ids == self.newline)
        if len(ends) == len(words):
            return ids[ids != self.newline], np.diff(ends, prepend=-1) - 1
        parts = [self.whole(w) for w in words]
        return np.concatenate(parts), np.array([len(x) for x in parts])


class Aligner:
    """Both encoders, the bytes of their tokens and how ids are written."""

    def __init__(self, a_path: str, b_path: str):
        import numpy as np
        import pyarrow as pa

        self.a, self.b = LedByteEncoder(a_path), LedPieceEncoder(b_path)
        with open(a_path, encoding="utf-8") as f:
            described = json.load(f)
        entries = described["model"]["vocab"] | {x["content"]: x["id"] for x in described["added_tokens"]}
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)}
        a_bytes = [b""] * (1 + max(entries.values()))
        for entry, k in entries.items():
            a_bytes[k] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        model = self.b.pieces
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(map(model.id_to_piece, range(model.vocab_size())))]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.lengths = [np.array([len(x) for x in y]) for y in (a_bytes, b_bytes)]
        self.many = len(a_bytes), len(b_bytes)
        #: Decimal ids with what may follow them: id * 2 (or * 3, after those of A) + place of the mark.
        self.written = pa.array([f"{k}{m}" for n, marks in zip(self.many, (",|", (",", ";", ""))) for k in range(n) for m in marks], pa.large_string())

    def tokens(self, led) -> list:
        """[(ids, counts)] of A and of B over an Arrow array of led texts."""
        import numpy as np

        out = []
        for encoder in (self.a, self.b):
            parts = [(ids, counts) for _, _, ids, counts in encoder.slices(led)]
            out.append((np.concatenate([x for x, _ in parts]).astype(np.int64), np.concatenate([x for _, x in parts])))
        return out

    def exact(self, led, ids, counts, side: int):
        """Which texts the tokens' bytes are equal to."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        want = np.asarray(pc.binary_length(led)).astype(np.int64)
        ends = np.append(0, np.cumsum(self.lengths[side][ids]))[np.append(0, np.cumsum(counts))]
        same = np.diff(ends) == want
        if not same.any():
            return same
        kept = same if not same.all() else slice(None)
        texts = led.filter(pa.array(same)) if not same.all() else led
        joined = self.bytes[side].take(pa.array(ids[np.repeat(same, counts)] if not same.all() else ids))
        have = np.frombuffer(joined.buffers()[2], np.uint8)
        begin, width = (np.frombuffer(texts.buffers()[1], np.int32)[texts.offset], int(want[kept].sum()))
        wrong = np.flatnonzero(np.frombuffer(texts.buffers()[2], np.uint8)[begin : begin + width] != have[:width])
        if len(wrong):
            places = np.flatnonzero(same)
            same[places[np.unique(np.searchsorted(np.cumsum(want[kept]), wrong, "right"))]] = False
        return same


def groups_of(a_lengths, b_lengths) -> tuple:
    """(group of each A token, of each B token, number of overlaps before each byte's end) from the tokens' lengths in bytes over the same bytes."""
    import numpy as np

    owner_a, owner_b = (np.repeat(np.arange(len(x), dtype=np.int32), x) for x in (a_lengths, b_lengths))
    new_a, new_b = (np.diff(x, prepend=np.int32(-1)) != 0 for x in (owner_a, owner_b))
    group = np.cumsum(new_a & new_b, dtype=np.int32) - 1
    return group[new_a], group[new_b], np.append(0, np.cumsum(new_a | new_b))


def linked(a_ids, b_ids, a_group, b_group, doc_of_group, n_b: int) -> tuple:
    """(document << 40 | a * n_b + b, links) of each document's distinct pairs, in order."""
    import numpy as np

    many = len(doc_of_group)
    n_of_a, n_of_b = np.bincount(a_group, minlength=many), np.bincount(b_group, minlength=many)
    large = n_of_a * n_of_b > LARGE_GROUP
    plain = ~large[a_group]
    repeats = n_of_b[a_group[plain]]
    first = (np.cumsum(n_of_b) - n_of_b)[a_group[plain]]
    b_at = np.arange(int(repeats.sum())) - np.repeat(np.cumsum(repeats) - repeats - first, repeats)
    keys = np.repeat((doc_of_group[a_group[plain]] << 40) + a_ids[plain] * n_b, repeats) + b_ids[b_at]
    keys.sort()
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    found, links = keys[new], np.diff(np.append(new, len(keys)))
    if not large.any():
        return found, links
    parts = [(found, links)]
    for g in np.flatnonzero(large):
        (a, in_a), (b, in_b) = (np.unique(ids[slice(*np.searchsorted(groups, (g, g + 1)))], return_counts=True) for ids, groups in ((a_ids, a_group), (b_ids, b_group)))
        parts.append((((doc_of_group[g] << 40) + a[:, None] * n_b + b).ravel(), (in_a[:, None] * in_b).ravel()))
    keys, links = (np.concatenate(x) for x in zip(*parts))
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, links)
    return found, total


def digests(aligner: Aligner, a_ids, b_ids, a_group, b_group, first_of_doc) -> list[str]:
    """sha256 of each document's groups as text. first_of_doc: the first group of each document, and the number of groups."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    many = int(first_of_doc[-1])
    n_of_a, n_of_b = np.bincount(a_group, minlength=many), np.bincount(b_group, minlength=many)
    ends_a, ends_b = np.cumsum(n_of_a), np.cumsum(n_of_b)
    mark_a, mark_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    mark_a[ends_a - 1] = mark_b[ends_b - 1] = 1
    mark_b[ends_b[first_of_doc[1:] - 1] - 1] = 2
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    out[np.arange(len(a_ids)) + (ends_b - n_of_b)[a_group]] = 2 * a_ids + mark_a
    out[np.arange(len(b_ids)) + ends_a[b_group]] = 2 * aligner.many[0] + 3 * b_ids + mark_b
    texts = aligner.written.take(pa.array(out))
    data, offsets = memoryview(texts.buffers()[2]), np.frombuffer(texts.buffers()[1], np.int64)
    bounds = offsets[np.append(0, (ends_a + ends_b)[first_of_doc[1:] - 1])].tolist()
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]


def aligned(aligner: Aligner, texts) -> tuple:
    """(columns by name, key and number of each document's distinct pairs) of an Arrow array of texts without nulls."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    columns = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")} | {"groups_sha256": np.full(len(texts), "", object)}
    some = np.flatnonzero(np.asarray(pc.binary_length(texts)) > 0)
    nothing = columns, np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(some):
        return nothing
    led = pc.binary_join_element_wise(pa.scalar(""), texts.take(pa.array(some)), " ")
    (a_ids, a_counts), (b_ids, b_counts) = aligner.tokens(led)
    fit = aligner.exact(led, a_ids, a_counts, 0) & aligner.exact(led, b_ids, b_counts, 1)
    if not fit.any():
        return nothing
    if not fit.all():
        a_ids, b_ids = a_ids[np.repeat(fit, a_counts)], b_ids[np.repeat(fit, b_counts)]
        a_counts, b_counts, some = a_counts[fit], b_counts[fit], some[fit]
    a_lengths = aligner.lengths[0][a_ids]
    a_group, b_group, overlaps = groups_of(a_lengths, aligner.lengths[1][b_ids])
    many = int(a_group[-1]) + 1
    first_a = np.cumsum(a_counts) - a_counts
    first_of_doc = np.append(a_group[first_a], many).astype(np.int64)
    doc_of_group = np.repeat(some.astype(np.int64), np.diff(first_of_doc))
    n_links = np.append(0, np.cumsum(np.bincount(a_group, minlength=many).astype(np.int64) * np.bincount(b_group, minlength=many)))
    bytes_before = np.append(0, np.cumsum(a_lengths))[np.append(first_a, len(a_ids))]
    found = {"n_a": a_counts, "n_b": b_counts, "n_groups": np.diff(first_of_doc), "n_overlaps": np.diff(overlaps[bytes_before]), "n_links": np.diff(n_links[first_of_doc]), "groups_sha256": digests(aligner, a_ids, b_ids, a_group, b_group, first_of_doc)}
    for name, values in found.items():
        columns[name][some] = values
    return columns, *linked(a_ids, b_ids, a_group, b_group, doc_of_group, aligner.many[1])


def cut(texts, most: int):
    """(first row, number of rows) of slices of at most so many bytes, or one text."""
    import numpy as np
    import pyarrow.compute as pc

    ends, at = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64), 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")) - at)
        yield at, n
        at += n


def smallest(values, most: int):
    """Whole numbers from 0 to most in as few bytes as they need: a block's pairs are what fills a worker's memory."""
    import numpy as np

    return values.astype(np.min_scalar_type(most))


def aligned_by_parts(aligner: Aligner, texts, most: int) -> tuple:
    """(columns by name, number of pairs of each document, pairs and links of each part) of ever so many bytes, aligned in parts."""
    import numpy as np

    facts, counts, pairs, links = [], [], [], []
    for at, n in cut(texts, most):
        found, keys, many = aligned(aligner, texts.slice(at, n))
        facts.append(found)
        counts.append(np.bincount(keys >> 40, minlength=n))
        pairs.append(smallest(keys & ((1 << 40) - 1), aligner.many[0] * aligner.many[1]))
        links.append(smallest(many, many.max(initial=0)))
    return {c: np.concatenate([f[c] for f in facts]) for c in facts[0]}, np.concatenate(counts), pairs, links


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner; workers are reused, and so are its caches."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


FACTS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")
STORED = ["block", "doc_id", *FACTS, "groups_sha256", "places", "links", "pairs", "held"]


def blocks(docs: DataFrame, a_path: str, b_path: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores and reads back the alignment: a row for each document (facts, places of its pairs in the block's list and their links), and the block's list in rows of pairs with the number of documents that hold each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, block = aligner_of(a_path, b_path), TaskContext.get().partitionId() << 32
        lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
        for batch in batches:
            for at, n in cut(batch.column(1), settings.block_bytes):
                facts, counts, parts, links = aligned_by_parts(aligner, batch.column(1).slice(at, n), settings.align_bytes)
                pairs = np.concatenate(parts)
                pairs.sort()
                pairs = pairs[np.diff(pairs, prepend=pairs[:1] + 1) != 0]
                held = np.zeros(len(pairs), np.int64)
                null = lambda m, kind: pa.nulls(m, kind)
                longs = pa.list_(pa.int64())
                for first, k in cut(batch.column(1).slice(at, n), settings.align_bytes):  # as the parts were cut
                    own, bounds = slice(first, first + k), np.append(0, np.cumsum(counts[first : first + k]))
                    places = np.searchsorted(pairs, parts[0]).astype(np.int32)
                    held += np.bincount(places, minlength=len(pairs))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), batch.column(0).slice(at + first, k), *(pa.array(facts[c][own]) for c in FACTS), pa.array(facts["groups_sha256"][own], pa.string()), lists(bounds, places), lists(bounds, links[0].astype(np.int64)), null(k, longs), null(k, longs)], STORED)
                    del parts[0], links[0]
                for first in range(0, len(pairs), LIST_ROWS * LIST_ROW):
                    some = slice(first, first + LIST_ROWS * LIST_ROW)
                    many = len(pairs[some])
                    rows = np.append(np.arange(0, many, LIST_ROW), many)
                    m = len(rows) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), null(m, batch.column(0).type), *(null(m, pa.int64()) for _ in FACTS), null(m, pa.string()), null(m, pa.list_(pa.int32())), null(m, longs), lists(rows, pairs[some].astype(np.int64)), lists(rows, held[some])], STORED)
                block += 1

    facts = ", ".join(f"{c} bigint" for c in FACTS)
    schema = f"block bigint, doc_id {type_of(docs, id_col)}, {facts}, groups_sha256 string, places array<int>, links array<bigint>, pairs array<bigint>, held array<bigint>"
    return materialise(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema), "aligned")


def pair_counts(stored: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): documents that hold each id pair linked, pair = a * n_b + b, and whether that is its A id's highest."""
    each = stored.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("count"))
    highest = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("count").alias("highest"))
    return counts.join(highest, F.expr(f"pair div {n_b}") == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, groups_sha256) of each document."""
    import sentencepiece

    stored = blocks(docs, a_path, b_path, settings, id_col, text_col)
    counts = materialise(pair_counts(stored, sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()), "pair-counts")
    asked = stored.where("pairs is not null").select(F.col("block").alias("asked_by"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").select("asked_by", "pair", "count", "best")
    rows = stored.where("pairs is null").drop("pairs", "held")

    def run(table, found):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(found["pair"].to_numpy())
        count, best = found["count"].to_numpy()[order], found["best"].to_numpy()[order].astype(np.int64)
        places, links = (table[c].combine_chunks() for c in ("places", "links"))
        ends = np.append(0, np.cumsum(np.asarray(places.value_lengths())))
        at, n = np.asarray(places.flatten()), np.asarray(links.flatten())
        sums = lambda x: pa.array(np.diff(np.append(0, np.cumsum(n * x[at]))[ends]) if len(at) else np.zeros(len(table), np.int64))
        return pa.table([*(table[c] for c in ("doc_id", *FACTS)), sums(best), sums(count), table["groups_sha256"]], names=["doc_id", *FACTS, "n_best", "count_sum", "groups_sha256"])

    facts = ", ".join(f"{c} bigint" for c in (*FACTS, "n_best", "count_sum"))
    return rows.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(run, f"doc_id {type_of(docs, id_col)}, {facts}, groups_sha256 string")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by the byte-level BPE, aligned with the pieces."""
    import public_tokenizers

    out = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
