"""Token counts of flat, unindexed token files: a vectorised scan for end-of-document ids, stitched over blocks.

A token file is nothing but little-endian ids, documents one behind another, each closed by the end id. Files of one
corpus may be cut anywhere, also inside a document. Ids behind the last end id make a last, open document. An empty
file, or a corpus without files, gives no rows. A file whose length is no multiple of the id's width is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoder, with_end
from .common import documents, materialise, new_path, text_of

#: Ids that one block of the scan has: 8 MB of 16-bit ids.
BLOCK_IDS = 4 << 20
#: Bytes after which a task begins another file.
FILE_BYTES = 128 << 20
END_ID = 50_256


def open_folder(uri: str):
    """(file system, path) of a folder in whatever store its URI names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_flat_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Writes flat token files and returns (doc_id, file, place, n_ids_in_file): which document stands where in their order.

    Each attempt of a task writes names of its own and only rows of finished attempts name files, so a repeated or
    abandoned attempt leaves at most a file that nothing refers to. No length of any document is kept.
    """

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, literal=True)
        store, folder = open_folder(path)
        store.create_dir(folder, recursive=True)
        task, part, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        out, name, size, place, ids, places = None, "", 0, 0, [], []

        def closed():
            out.close()
            width = np.dtype(dtype).itemsize
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.string()), pa.array(places, pa.int64()), pa.array([size // width] * len(ids), pa.int64())], ["doc_id", "file", "place", "n_ids"])

        for batch in batches:
            for at, n, tokens, counts in enc.slices(batch.column(1)):
                if out is None:
                    name = f"{task:08d}-{part:06d}-{attempt}.bin"
                    out, size, place, ids, places = store.open_output_stream(f"{folder}/{name}"), 0, 0, [], []
                data = with_end(tokens, counts, end_id)[0].astype(dtype).tobytes()
                out.write(data)
                size += len(data)
                ids += batch.column(0).slice(at, n).to_pylist()
                places += range(place, place + n)
                place += n
                if size >= FILE_BYTES:
                    yield closed()
                    out, part = None, part + 1
        if out is not None:
            yield closed()

    rows = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id bigint, file string, place bigint, n_ids bigint")
    return materialise(rows, "token-file-order")


def scan_blocks(files: DataFrame, path: str, end_id: int = END_ID, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, n_ids, n_ends, ends array<int>): where each block of each file has end ids. files: (file, n_ids)."""
    blocks = files.select("file", F.explode(F.expr(f"sequence(0L, (n_ids - 1) div {block_ids}L)")).alias("block"), "n_ids").where("n_ids > 0")
    blocks = blocks.select("file", "block", F.least(F.lit(block_ids), F.col("n_ids") - F.col("block") * block_ids).cast("long").alias("n_ids"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        store, folder = open_folder(path)
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for file, block, n in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{folder}/{file}") as f:
                    ids = np.frombuffer(f.read_at(n * width, block * block_ids * width), dtype)
                if len(ids) != n:
                    raise ValueError(f"{file} is shorter than stated")
                ends = np.flatnonzero(ids == end_id).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends], pa.list_(pa.int32()))], ["file", "block", "n_ids", "n_ends", "ends"])

    return blocks.repartition(F.col("file"), F.col("block")).mapInArrow(run, "file string, block bigint, n_ids bigint, n_ends bigint, ends array<int>")


def document_lengths(blocks: DataFrame) -> DataFrame:
    """(ordinal, start, n_tokens, file, place) of each document from scanned blocks, in the order of files and blocks.

    The scan over block totals gives each block its first global position, its documents before it and the last end
    before it; n_tokens excludes the end id. place counts the ends of the file before the document's own end.
    """
    totals = blocks.select("file", "block", "n_ids", "n_ends", F.try_element_at("ends", F.lit(-1)).cast("long").alias("last_end"))
    per_file = totals.groupBy("file").agg(F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("docs"))
    # within a file, then over files: a row for each block, then for each file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = totals.select("file", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("b_ids"), F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("b_docs"), "last_end", "n_ids")
    in_file = in_file.withColumn("b_end", F.max(F.col("b_ids") + F.col("last_end")).over(before))
    ends = in_file.groupBy("file").agg(F.max(F.col("b_ids") + F.col("last_end")).alias("file_end"))
    over = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = per_file.select("file", "ids", "docs").join(ends, "file")
    files = files.select("file", "ids", "docs", "file_end", F.coalesce(F.sum("ids").over(over), F.lit(0)).alias("f_ids"), F.coalesce(F.sum("docs").over(over), F.lit(0)).alias("f_docs"))
    files = files.withColumn("f_end", F.max(F.col("f_ids") + F.col("file_end")).over(over))
    carry = in_file.select("file", "block", "b_ids", "b_docs", "b_end").join(files.drop("ids", "docs", "file_end"), "file")
    rows = blocks.join(carry, ["file", "block"]).select(
        "file", (F.col("f_docs") + F.col("b_docs")).alias("first"), "b_docs", (F.col("f_ids") + F.col("b_ids")).alias("at"),
        F.coalesce(F.col("f_ids") + F.col("b_end"), F.col("f_end"), F.lit(-1)).alias("carried"), "ends",
    )
    docs = rows.select("file", "first", "b_docs", "at", "carried", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") > 0, F.col("at") + F.try_element_at("ends", F.when(F.col("k") > 0, F.col("k")))).otherwise(F.col("carried")) + 1
    closed = docs.select((F.col("first") + F.col("k")).alias("ordinal"), begin.alias("start"), (F.col("at") + F.col("end") - begin).alias("n_tokens"), "file", (F.col("b_docs") + F.col("k")).alias("place"), F.lit(True).alias("closed"))
    end = F.coalesce(F.max(F.col("f_ids") + F.col("file_end")), F.lit(-1))
    rest = files.agg(F.max(F.col("f_docs") + F.col("docs")).alias("ordinal"), (end + 1).alias("start"), (F.max(F.col("f_ids") + F.col("ids")) - end - 1).alias("n_tokens"))
    rest = rest.select("*", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("place"), F.lit(False).alias("closed"))
    return closed.unionByName(rest.where("n_tokens > 0"))


def count_tokens(files: DataFrame, path: str, end_id: int = END_ID, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    return document_lengths(materialise(scan_blocks(files, path, end_id, dtype, block_ids), "token-blocks"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat files of 16-bit ids."""
    import public_tokenizers

    path = new_path(spark, "flat-tokens")
    order = write_flat_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    files = order.groupBy("file").agg(F.max("n_ids").alias("n_ids"))
    counts = count_tokens(files, path)
    return order.select("doc_id", "file", "place").join(counts, ["file", "place"]).select("doc_id", "ordinal", "start", "n_tokens")
