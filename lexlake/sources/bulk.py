"""Bulk extracts: CSV members of archives, tab-delimited tables, nested registries, and a content-addressed store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def opened(uri: str):
    """A file of whatever store its URI names, to be read by its parts."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
    return store.open_input_file(path)


def zip_csv(spark: SparkSession, path: str, suffixes: tuple[str, ...], columns: list[str], split: int = 10_000) -> DataFrame:
    """Rows of each archive's first member with one of the suffixes, by its header: unknown columns are left out, missing ones null.

    Archives without such a member have no rows. Archives are read from their paths, so they may be of any size; each is one
    task's, and its rows leave in batches of `split`.
    """
    schema = StructType([StructField("archive", StringType()), *(StructField(c, StringType()) for c in columns)])
    files = spark.read.format("binaryFile").load(path).select("path").repartition("path")

    def run(frames: Iterator):
        import csv
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            for name in frame["path"]:
                with opened(name) as file, zipfile.ZipFile(file) as archive:
                    member = next((m for s in suffixes for m in archive.namelist() if m.endswith(s)), None)
                    if member is None:
                        continue
                    with archive.open(member) as raw:
                        rows = []
                        for row in csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline="")):
                            rows.append([name, *(row.get(c) for c in columns)])
                            if len(rows) == split:
                                yield pd.DataFrame(rows, columns=schema.names)
                                rows = []
                        yield pd.DataFrame(rows, columns=schema.names)

    return files.mapInPandas(run, schema)


def first_session(rows: DataFrame, column: str) -> str | None:
    """The session that an archive's first row names; None for an empty one."""
    first = rows.select(column).limit(1).collect()
    return first[0][0] if first else None


def with_bodies(rows: DataFrame, members: DataFrame, file_column: str) -> DataFrame:
    """rows with the content of the archive's member that they name, null where there is none."""
    files = members.select(F.col("archive").alias("_archive"), F.col("name").alias("_name"), "content")
    base = F.regexp_extract(F.col(file_column), r"([^/]*)$", 1)
    return rows.join(files, (rows["archive"] == files["_archive"]) & (base == files["_name"]), "left").drop("_archive", "_name")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of each archive's members, by base name: to be joined with rows that name them."""

    def run(frames: Iterator):
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            for archive_name, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for m in archive.namelist():
                        if not m.endswith("/"):
                            yield pd.DataFrame({"archive": [archive_name], "name": [m.rsplit("/", 1)[-1]], "content": [archive.read(m)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def tab_table(spark: SparkSession, path: str, columns: list[str], whole: tuple[str, ...] = ()) -> DataFrame:
    """A tab-delimited table without a header, values maybe in backticks. Short lines are left out, NULL is null; of `whole` columns, what isn't a number is 0."""
    parts = F.split(F.col("value"), "\t")

    def value(k: int, name: str):
        x = F.regexp_replace(F.get(parts, k), "^`(.*)`$", "$1")
        x = F.when(x != "NULL", x)
        return (F.coalesce(x.try_cast("long"), F.lit(0)) if name in whole else x).alias(name)

    lines = spark.read.text(path).where(F.size(parts) >= len(columns))
    return lines.select(*(value(k, c) for k, c in enumerate(columns)))


def registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Jurisdictions and their sessions out of one nested JSON file."""
    schema = "jurisdictions array<struct<code:string,name:string,classification:string,sessions:array<struct<identifier:string,name:string,start:string,end:string,active:boolean>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("jurisdictions").alias("j"))
    sessions = rows.select("j.code", F.explode("j.sessions").alias("s")).select("code", "s.*")
    return {"jurisdictions": rows.select("j.code", "j.name", "j.classification"), "sessions": sessions}


def bulk_urls(spark: SparkSession, path: str) -> DataFrame:
    """(code, session, url) out of a map from codes to lists of dumps."""
    rows = spark.read.schema("dumps map<string,array<struct<session:string,url:string>>>").json(path, multiLine=True)
    return rows.select(F.explode("dumps").alias("code", "list")).select("code", F.explode("list").alias("d")).select("code", "d.*")


def api_pages(spark: SparkSession, path: str) -> DataFrame:
    """Results of landed API pages, one row each."""
    schema = "results array<struct<id:string,identifier:string,title:string,classification:array<string>,session:string,latest_action_date:string,actions:array<struct<description:string,date:string,classification:array<string>>>,sponsorships:array<struct<name:string,classification:string,`primary`:boolean>>>>, pagination struct<max_page:int>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")


def store_blobs(blobs: DataFrame, path: str, column: str = "content") -> DataFrame:
    """Stores each distinct content once under its sha256, in folders by the first two digits; returns (key, shard) of each row."""
    keyed = blobs.withColumn("key", F.sha2(column, 256)).withColumn("shard", F.substring("key", 1, 2))
    try:
        known = blobs.sparkSession.read.parquet(path).select("key")
        new = keyed.join(known, "key", "left_anti")
    except AnalysisException:  # the store does not exist yet
        new = keyed
    new.select("key", F.col(column).alias("content"), "shard").dropDuplicates(["key"]).write.mode("append").partitionBy("shard").parquet(path)
    return keyed.drop(column)


def blob(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The content of a key; reads its own folder only."""
    return spark.read.parquet(path).where((F.col("shard") == key[:2]) & (F.col("key") == key)).select("key", "content")
