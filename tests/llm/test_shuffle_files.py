"""What stored tables leave on disk."""

from pathlib import Path

from lexlake.llm import common


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, so that those of all steps of a query lay on disk at once."""
    conf = spark.sparkContext.getConf()
    top = Path(conf.get("spark.local.dir", None) or spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getParent())
    files = lambda: {p for p in top.rglob("shuffle_*.data")}
    before = files()
    out = common.materialise(spark.range(20_000).selectExpr("id % 7000 as k", "uuid() as v").groupBy("k").agg({"v": "max"}), "grouped")
    assert out.count() == 7000
    assert not {p for p in files() - before if p.stat().st_size > 10_000}
    assert spark.conf.get(common.CLEANUP) == "false"
