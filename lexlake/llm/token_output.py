"""Token ids as Parquet list columns, with controlled row groups and page indexes, and their selective reads.

Rows with a null text are encoded as empty; rows with null or repeated doc_id are kept (nulls first, then by text);
an empty table gives files without rows. Columns other than the id and the text are not stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoder, with_end
from .common import documents, materialise, new_path, text_of


@dataclass(frozen=True)
class TokenFileFormat:
    """How the writer lays out files. encoding: "dictionary" (few distinct ids) or "delta" (DELTA_BINARY_PACKED, writer version 2)."""

    encoding: str = "dictionary"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2_000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.compression,
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.enable.dictionary": str(self.encoding == "dictionary").lower(),
            "parquet.writer.version": "v1" if self.encoding == "dictionary" else "v2",
            "parquet.column.index.access": "true",
        }


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of every text, end_id appended."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(tokenizer_path)
        for batch in batches:
            for at, n, ids, counts in enc.slices(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype("<i4")), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(counts), lists], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, layout: TokenFileFormat = TokenFileFormat(), end_id: int | None = 0) -> None:
    """Writes the ids in ascending doc_id order: ranges of doc_id over files, sorted in each."""
    rows = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encode(rows, tokenizer_path, end_id).write.options(**layout.options()).parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Reads only the columns asked for: metadata reads never touch the pages of ids."""
    return spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").parquet(path).select(*columns)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, place, start, n_tokens, ids_crc32) of each stored row, from the files alone.

    start is the number of ids before the row: within a file a running sum, over files a sum of their totals,
    which are one row for each file.
    """

    def digest(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        last, place = None, 0
        for batch in batches:
            files, lists = batch.column(0).to_pylist(), batch.column(2)
            flat = np.asarray(lists.flatten()).astype("<u4", copy=False)
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
            places = []
            for f in files:
                place, last = (place + 1 if f == last else 0), f
                places.append(place)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(files), pa.array(places, pa.int64()), pa.array((ends - begins).astype("<i8")), pa.array(crcs, pa.int64())], ["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    block = F.concat_ws("|", F.lpad(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), 12, "0"), "_metadata.file_name", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    stored = spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").parquet(path).select(block.alias("file"), "doc_id", "ids")
    rows = materialise(stored.mapInArrow(digest, "doc_id bigint, file string, place bigint, n_tokens bigint, ids_crc32 bigint"), "token-index")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # one row for each block of a file
    offsets = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("offset"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(offsets, "file").select("doc_id", "file", "place", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the token file format, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
