"""Sessions found or made, loads that are published whole, and drains that survive a restart."""

import pytest
from pyspark.sql import functions as F

from lexlake.operators import sessions
from lexlake.sources import sinks
from lexlake.streaming import changes


def test_sessions_resolved_and_again(rows):
    known = rows("place string, session_id bigint, identifier string, class string, active boolean, start string", ("a", 1, "2023-2024", "regular", False, "2023-01-01"), ("a", 2, "2025-2026", "regular", True, "2025-01-01"), ("a", 3, "2025 special", "special", True, None), ("b", 4, "88th", "regular", True, None), ("b", 5, "88(1)", "regular", False, None)).withColumn("start", F.col("start").cast("date"))
    wanted = rows("place string, slug string", ("a", "2025-2026"), ("a", "2026rs"), ("a", "2025 special"), ("a", None), ("a", "2031"), ("a", "2031rs"), ("a", "2031 special"), ("b", "88R"), ("c", "x1"), ("c", None), ("a", "2026rs"))
    got = {(r["place"], r["slug"]): (r["path"], r["session_id"], r["identifier"]) for r in sessions.resolved(wanted, known).collect()}
    assert got[("a", "2025-2026")][:2] == ("exact", 2) and got[("a", "2026rs")][:2] == ("fuzzy", 2) and got[("a", "2025 special")][:2] == ("exact", 3)
    assert got[("a", None)] == ("active", 2, "2025-2026") and got[("c", None)] == (None, None, None)
    assert got[("a", "2031")][0] == "new" and got[("a", "2031rs")] == ("fuzzy", *got[("a", "2031")][1:]) and got[("a", "2031 special")][0] == "new"
    assert got[("c", "x1")][0] == "new" and len(got) == 10
    made = sessions.resolved(wanted, known).where("path = 'new'").select("place", "session_id", "identifier", F.when(F.col("identifier").contains("special"), "special").otherwise("regular").alias("class"), F.lit(False).alias("active"), F.lit(None).cast("date").alias("start"))
    again = {(r["place"], r["slug"]): (r["path"], r["session_id"]) for r in sessions.resolved(wanted, known.unionByName(made)).collect()}
    assert {k: v[1] for k, v in again.items()} == {k: v[1] for k, v in got.items()} and all(v[0] != "new" for v in again.values())


def test_loads_are_whole(spark, rows, tmp_path):
    path = f"file://{tmp_path}/loads"
    parents, children = rows("id int", (1,), (2,)), rows("parent int", (1,), (1,), (2,))
    broken = children.withColumn("parent", F.when(F.col("parent") == 2, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("parent")))
    with pytest.raises(Exception, match="killed"):
        sinks.write_load({"parent": parents, "child": broken}, path, "one", ["parent"])
    assert sinks.published(spark, path) == [] and sinks.read_loads(spark, path, "parent").count() == 0
    assert sinks.write_load({"parent": parents, "child": children}, path, "one", ["parent"])
    assert not sinks.write_load({"parent": parents, "child": children}, path, "one", ["parent"])
    sinks.stage_table(parents, path, "parent", "two")  # and then killed
    assert sinks.read_loads(spark, path, "parent").count() == 2 and sinks.read_loads(spark, path, "child").count() == 3
    assert sinks.write_load({"parent": parents, "child": children}, path, "two", ["parent"]) and sinks.read_loads(spark, path, "child").count() == 6


def drain(spark, tmp_path, out, **settings):
    stream = spark.readStream.schema("subscription string, seq bigint, bytes bigint, kind string").parquet(str(tmp_path / "in"))
    query = changes.drained(stream, **settings).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / out)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / out)).select("subscription", "outcome", "first_seq", "last_seq", "n", "number").collect()), key=str)


def test_drain_restarts(spark, rows, tmp_path):
    schema, settings = "subscription string, seq bigint, bytes bigint, kind string", {"wanted": "kind <> 'no'", "most": 4, "most_bytes": 100}
    rows(schema, *(("s", n, 10, "no" if n == 3 else "yes") for n in range(1, 8)), ("t", 1, 60, "yes"), ("t", 2, 60, "yes"), ("t", 3, 500, "yes"), ("t", 4, None, "yes"), ("u", 5, 1, "no")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first = drain(spark, tmp_path, "out", **settings)
    assert first == sorted([("s", "delivered", 1, 5, 4, 0), ("s", "delivered", 6, 7, 2, 1), ("t", "delivered", 1, 1, 1, 0), ("t", "delivered", 2, 2, 1, 1), ("t", "too large", 3, 3, 1, None), ("t", "delivered", 4, 4, 1, 2)], key=str)
    rows(schema, ("s", 7, 10, "yes"), ("s", 9, 10, "yes"), ("u", 4, 1, "yes"), ("u", 6, 1, "yes")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    second = drain(spark, tmp_path, "out", **settings)
    assert sorted(set(second) - set(first), key=str) == sorted([("s", "late", 7, 7, 1, None), ("s", "delivered", 9, 9, 1, 2), ("u", "late", 4, 4, 1, None), ("u", "delivered", 6, 6, 1, 0)], key=str)


def test_drain_holds_what_is_pending(spark, rows, tmp_path):
    schema = "subscription string, seq bigint, bytes bigint, kind string"
    rows(schema, *(("s", n, 1, "yes") for n in range(1, 7))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert drain(spark, tmp_path, "out", most=4, hold_seconds=3600) == [("s", "delivered", 1, 4, 4, 0)]
    rows(schema, *(("s", n, 1, "yes") for n in range(7, 10))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert drain(spark, tmp_path, "out", most=4, hold_seconds=3600) == [("s", "delivered", 1, 4, 4, 0), ("s", "delivered", 5, 8, 4, 1)]
