"""Helpers that several of the subpackage's operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir. In local mode, where both are one machine, a new temporary folder if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/lexlake/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    The written table is as lazy results need it, so it stays until whoever owns the folder clears it. The shuffle files
    that the writing took go at its end.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_caches: dict[str, tuple[dict, ...]] = {}


def take_worker(owner: str, *caches: dict) -> None:
    """Called where an operator's task begins in Python. Workers go from one operator to the next, so what others left in theirs is dropped: a worker holds the caches of one operator."""
    for other in [x for x in _caches if x != owner]:
        for cache in _caches.pop(other):
            cache.clear()
    _caches[owner] = caches


def text_of(column="text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def type_of(df: DataFrame, column: str) -> str:
    """A column's type as a schema string has it."""
    return df.schema[column].dataType.simpleString()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
