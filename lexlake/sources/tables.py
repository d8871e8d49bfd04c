"""Tables by role: the engine's entities, bound to the benchmark tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jurisdictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("jurisdiction_id"), F.col("n_name").alias("code"), F.col("n_regionkey").alias("region_id"))


def bills(spark: SparkSession, d: str, of_customer: bool = True) -> DataFrame:
    """id, jurisdiction_id, chamber, status_code, day, year, priority, cents. The middle two are facts of the customer and cost a join; of_customer=False leaves them and it out."""
    rows, day, own = table(spark, d, "orders"), F.col("o_orderdate").cast("date"), []
    if of_customer:
        c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        rows = rows.join(c, rows["o_custkey"] == c["c_custkey"])
        own = [F.col("c_nationkey").alias("jurisdiction_id"), F.col("c_mktsegment").alias("chamber")]
    return rows.select(
        F.col("o_orderkey").alias("id"), *own, F.col("o_orderstatus").alias("status_code"),
        day.alias("day"), F.year(day).cast("long").alias("year"), F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


def actions(spark: SparkSession, d: str) -> DataFrame:
    """bill_id, day, place, part_id, sponsor_id, kind, quantity. Not unique by (bill_id, place)."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("bill_id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("sponsor_id"),
        F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


def subjects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("subject"))
    a = actions(spark, d).select("bill_id", "part_id")
    return a.join(p, a["part_id"] == p["p_partkey"]).select("bill_id", "subject")


def sponsors(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("home_id"))
    a = actions(spark, d).select("bill_id", "sponsor_id", "place")
    return a.join(s, a["sponsor_id"] == s["s_suppkey"]).select("bill_id", "name", "home_id", (F.col("place") == 1).alias("primary"))


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """seq, changed_at, entity_id, kind, value, detail."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("changed_at"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"), "value", F.col("props").alias("detail"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


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
