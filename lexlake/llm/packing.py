"""Packing without cross-document sequences: each document's ids are cut into pieces of binary lengths, and equal lengths share a bucket.

A document of n ids gives n div `longest` pieces of the greatest length and one piece for each binary digit of the rest,
longest first. A piece is a sequence of its own: it needs no padding and no mask, and a batch is drawn from one bucket.
A task writes its pieces sorted by length into one file of small row groups, so a bucket is a run of row groups that a
filter on `length` finds by their statistics: nothing is shuffled, and the number of files doesn't grow with the buckets.
A sequence's id names its file and row.

A null or empty text is the end id alone. Rows with null or repeated doc_id are packed each; doc_id may have any type.
A text of any length is encoded whole; an empty table gives no pieces. Other columns of docs are not stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .common import documents, new_path, text_of, type_of
from .token_output import TokenFileFormat


@dataclass(frozen=True)
class Settings:
    """longest: a power of two, ids of the longest sequence. layout: of the files."""

    longest: int = 2048
    layout: TokenFileFormat = TokenFileFormat(row_group_bytes=4 << 20)

    def __post_init__(self):
        if self.longest < 1 or self.longest & (self.longest - 1):
            raise ValueError("longest must be a power of two")


def binary_pieces(counts, longest: int):
    """(document, length) of each piece of documents with so many ids each, in the order of their ids."""
    import numpy as np

    many = np.arange(len(counts))
    digits = longest >> np.arange(1, longest.bit_length())
    rest, digit = np.nonzero((counts[:, None] & digits) != 0)
    of = np.concatenate([np.repeat(many, counts // longest), rest])
    lengths = np.concatenate([np.full(int((counts // longest).sum()), longest, np.int64), digits[digit].astype(np.int64)])
    order = np.argsort(of, kind="stable")
    return of[order], lengths[order]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids array<int>) of each piece."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(tokenizer_path)
        for batch in batches:
            for at, n, ids, counts in enc.slices(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                of, lengths = binary_pieces(counts, settings.longest)
                ends = np.cumsum(lengths)
                start = ends - lengths - (np.cumsum(counts) - counts)[of]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("<i4")), pa.array(ids.view("<i4")))
                own = batch.column(0).slice(at, n).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([own, pa.array(start), pa.array(lengths), pa.array(counts[of]), lists], ["doc_id", "start", "length", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {type_of(docs, id_col)}, start bigint, length bigint, doc_tokens bigint, ids array<int>")


def write_sequences(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, settings: Settings = Settings()) -> None:
    """Writes the pieces of docs; within each file the buckets follow one another, longest first."""
    rows = pieces(docs, tokenizer_path, end_id, settings).sortWithinPartitions(F.desc("length"))
    rows.write.options(**settings.layout.options()).parquet(path)


def read_sequences(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """The stored pieces with sequence_id and offset; of one bucket only if length is given."""
    stored = spark.read.parquet(path)
    stored = stored if length is None else stored.where(F.col("length") == length)
    number = lambda k: F.regexp_extract("_metadata.file_name", r"part-(\d+)-.*-c(\d+)", k).cast("bigint")
    sequence = F.shiftleft(number(1), 40) + F.shiftleft(number(2), 32) + F.col("_metadata.row_index")
    return stored.select(*stored.columns, sequence.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def digested(sequences: DataFrame) -> DataFrame:
    """sequences with ids_crc32, the unsigned crc32 of the ids as little-endian 32-bit integers, instead of the ids."""
    kept = [c for c in sequences.columns if c != "ids"]

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(0)
            data = memoryview(np.ascontiguousarray(np.asarray(lists.flatten()), "<i4")).cast("B")
            ends = 4 * np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)
            crcs = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(crcs, pa.int64())], [*kept, "ids_crc32"])

    fields = ", ".join(f"`{c}` {type_of(sequences, c)}" for c in kept)
    return sequences.select("ids", *kept).mapInArrow(run, f"{fields}, ids_crc32 bigint")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in binary pieces of at most 2,048 ids, read back from the files."""
    import public_tokenizers

    path = new_path(spark, "sequences")
    write_sequences(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digested(read_sequences(spark, path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
