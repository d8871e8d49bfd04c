"""Keyed state and clock windows over arriving files."""

from pyspark.sql import functions as F

from lexlake.streaming import changes


def files(spark, tmp_path, schema, *batches):
    for n, batch in enumerate(batches):
        spark.createDataFrame(list(batch), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_windowed_requests(spark, tmp_path):
    stream = files(spark, tmp_path, "k string, at string", [("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:59")], [("a", "2024-01-01 00:00:30"), ("b", "2024-01-01 00:01:00")])
    got = run(changes.windowed_requests(stream.withColumn("at", F.col("at").cast("timestamp")), "k", "at", 2), tmp_path, "windows", "complete")
    assert sorted((r["k"], r["n"], r["refused"]) for r in got) == [("a", 3, 1), ("b", 1, 0)]


def test_delivery_states(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    stream = files(spark, tmp_path, "k string, at string, kind string", [("a", at(0), "soft"), ("a", at(1), "soft"), ("b", at(0), "gone"), ("c", at(2), "hard")], [("a", at(2), "ok"), ("c", at(3), "hard"), ("c", at(4), "hard")])
    got = run(changes.delivery_states(stream.withColumn("at", F.col("at").cast("timestamp")), "k", "at", "kind"), tmp_path, "states", "update")
    last = {}
    for r in got:
        last.setdefault(r["k"], []).append((r["failures"], r["class"], r["active"]))
    assert (0, "ok", True) in last["a"] and (2, "soft", True) in last["a"] and last["b"] == [(1, "gone", False)] and (3, "hard", False) in last["c"]


def test_runs_of_failures():
    def after(*steps):
        state = (0, "ok", None, True)
        for kind, hour in steps:
            state = changes.failure_step(state, kind, hour * 3600.0)
        return state

    # a run counts one class, the clock goes on through all of them
    assert after(("soft", 0), ("hard", 1), ("soft", 2)) == (1, "soft", 0.0, True)
    assert after(("soft", 0), ("hard", 71), ("soft", 72))[3] is False
    assert after(("hard", 0), ("soft", 1), ("hard", 2), ("hard", 3))[3] is True
    # a skip stops the clock, and so does a success
    assert after(("soft", 0), ("skipped", 1), ("soft", 80)) == (1, "soft", 80 * 3600.0, True)
    assert after(("soft", 0), ("ok", 1), ("soft", 80))[3] is True
    # an endless run of skips ends a subscription, an interrupted one doesn't
    skips = [("skipped", k / 30) for k in range(changes.SKIPS)]
    assert after(*skips[:-1])[3] is True and after(*skips)[3] is False
    assert after(*skips[:-1], ("soft", 72), skips[-1])[3] is True
