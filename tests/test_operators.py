"""Invariants: caps, cursors, upserts, search, sources and streams."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexlake.operators import feed, filters, joins, paging, records, schedule, search
from lexlake.operators import text as TX
from lexlake.sources import bulk, sinks
from lexlake.streaming import changes


@pytest.mark.parametrize("n, saturated", [(4, False), (5, False), (6, True)])
def test_cap_boundary(spark, n, saturated):
    got = paging.capped(spark.range(n), [F.asc("id")], 5).collect()
    assert len(got) == min(n, 5) and {r["saturated"] for r in got} == {saturated}


def test_page_limits(spark):
    with pytest.raises(ValueError):
        paging.page(spark.range(1), [F.asc("id")], 1000, 1000, most=1000)
    assert [r["id"] for r in paging.page(spark.range(120), [F.asc("id")], 3, 50).collect()] == list(range(100, 120))
    assert paging.envelope([], 1, 50, 0)["pagination"]["total_pages"] == 0


def log(rows, n=40):
    t = dt.datetime(2024, 1, 1)
    return rows(changes.LOG_SCHEMA, *((k, t + dt.timedelta(seconds=10 * k), k % 3, feed.KINDS[k % 7], 1.0, "{}") for k in range(1, n + 1)))


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_feed_neither_skips_nor_repeats(rows, size):
    df, seen, cursor = log(rows, 30).cache(), [], 0
    while True:
        page = [r["seq"] for r in feed.page(df, cursor, size, "2024-01-01 00:08:00").collect()]
        seen += page[:size]
        if len(page) <= size:
            break
        cursor = page[size - 1]
    assert seen == list(range(1, 25))  # the others are younger than the lag


def test_upsert_twice_is_once(rows):
    old, new = rows("id int, checksum string", (1, "a"), (2, "b")), rows("id int, checksum string", (2, "c"), (3, "d"))
    assert {(r["id"], r["outcome"]) for r in joins.changes(new, old, "id", "checksum").collect()} == {(2, "updated"), (3, "created")}
    once = joins.upsert(new, old, "id")
    assert sorted(map(tuple, joins.upsert(new, once, "id").collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert {r["outcome"] for r in joins.changes(new, once, "id", "checksum").collect()} == {"unchanged"}


def test_evidence_ignores_order_and_sees_changes(rows):
    bill = rows("id int, title string", (1, "é"))
    a, b, c = (rows("bill_id int, aid int", *x) for x in ([(1, 2), (1, 1)], [(1, 1), (1, 2)], [(1, 1), (1, 3)]))
    ids = [records.evidence(bill, "id", ["title"], {"actions": (x, "aid")}).first()["snapshot"] for x in (a, b, c)]
    assert ids[0] == ids[1] != ids[2]


def test_filters_change_results(rows):
    df = rows("id int, note string", (1, "x"), (2, None), (3, "y"))
    assert {r["id"] for r in df.where(filters.not_in_or_null("note", ["x"])).collect()} == {2, 3}
    assert {r["id"] for r in df.where(filters.distinct_from("note", "x")).collect()} == {2, 3}
    assert filters.emptiness(df.where("id > 9"), df) == "no_match" and filters.emptiness(df.where("id > 9"), df.where("id > 9")) == "not_collected" and filters.emptiness(df, df) is None


def test_search(rows):
    df = rows("id int, text string", (1, "the new tax law"), (2, "tax new"), (3, "income taxes"), (4, None))
    found = lambda q, **k: sorted(r["id"] for r in search.search(df, "text", q, 10, **k).collect())
    assert found("tax") == [1, 2] and found('"new tax"') == [1] and found("tax -law") == [2] and found("law or income") == [1, 3] and found("") == []


def test_pairs_by_prefix_are_all_pairs(rows):
    words = ["blue widget", "blue widgets", "red widget", "green gadget", "greens gadget", "blue"]
    df = rows("id int, text string", *enumerate(words)).cache()
    got = {(r["a"], r["b"]) for r in search.similar_pairs(df, "id", "text", 300_000).collect()}
    t = [set(df.where(F.col("id") == k).select(search.trigrams("text")).first()[0]) for k in range(len(words))]
    assert got == {(a, b) for a in range(len(t)) for b in range(a + 1, len(t)) if len(t[a] & t[b]) * 1_000_000 // len(t[a] | t[b]) > 300_000}


def test_html(rows):
    page = "<html><head><title>T</title></head><body><p>A &amp; b</p><script>x='</p>'</script><div>c</div></body></html>"
    assert rows("h string", (page,), (None,)).select(TX.html_text("h").alias("t")).collect() == [("A & b\nc",), (None,)]


def test_diff(rows):
    got = records.diffs(rows("k int, n int, text string", (1, 1, "a\nb"), (1, 2, "a\n--c"), (2, 1, None)), "k", "n", "text").collect()
    assert len(got) == 1 and [x["type"] for x in got[0]["lines"]] == ["meta", "meta", "meta", "context", "remove", "add"]


def test_queue(rows):
    t = dt.datetime(2024, 1, 1)
    jobs = rows("id int, kind string, state string, run_after timestamp_ntz, attempts int, last_error string", (1, "a", "queued", t, 0, None), (2, "b", "queued", t, 4, None), (3, "a", "queued", t + dt.timedelta(days=1), 0, None))
    assert [r["id"] for r in schedule.claim(jobs, "2024-01-01 00:00:00", most=5).collect()] == [1, 2]
    after = {r["id"]: r for r in schedule.after_attempt(jobs, rows("id int, ok boolean, error string", (1, False, "x"), (2, False, "y")), "2024-01-01 00:00:00").collect()}
    assert after[1]["state"] == "queued" and after[1]["run_after"] == t + dt.timedelta(seconds=60) and after[2]["state"] == "dead" and after[3]["attempts"] == 0


def test_sources(spark, rows, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("X/1/X_1_bills.csv", "﻿id,title,odd\n1,\"a, b\",z\n2,,z\n")
        z.writestr("X/1/note.txt", "n")
    got = bulk.zip_csv(spark, str(tmp_path / "a.zip"), ("_bills.csv",), ["id", "title", "chamber"]).select("id", "title", "chamber").collect()
    assert [tuple(r) for r in got] == [("1", "a, b", None), ("2", "", None)]
    assert bulk.zip_csv(spark, str(tmp_path / "a.zip"), ("_votes.csv",), ["id"]).count() == 0
    assert {r["name"] for r in bulk.zip_members(spark, str(tmp_path / "a.zip")).collect()} == {"X_1_bills.csv", "note.txt"}
    (tmp_path / "t.dat").write_text("`a`\tNULL\t7\nshort\nb\tx\tbad\n")
    assert [tuple(r) for r in bulk.tab_table(spark, str(tmp_path / "t.dat"), ["p", "q", "n"], ("n",)).collect()] == [("a", None, 7), ("b", "x", 0)]
    (tmp_path / "r.json").write_text(json.dumps({"jurisdictions": [{"code": "X", "name": "n", "classification": "state", "sessions": [{"identifier": "1", "active": True}]}]}))
    assert bulk.registry(spark, str(tmp_path / "r.json"))["sessions"].first()["identifier"] == "1"
    store = str(tmp_path / "store")
    for _ in range(2):
        keys = bulk.store_blobs(rows("id int, content binary", (1, b"x"), (2, b"x"), (3, b"y")), store).collect()
    assert spark.read.parquet(store).count() == 2 and bulk.blob(spark, store, keys[0]["key"]).count() == 1


def test_delivery_body_is_halved(rows):
    big = "z" * 20_000
    df = rows("subscription int, events array<struct<seq:bigint,text:string>>", (1, [(k, big) for k in range(100)]), (2, [(5, "a")]), (3, [(9, "z" * 600_000)]))
    got = {r["subscription"]: r for r in sinks.delivery_bodies(df, b"k").collect()}
    assert len(json.loads(got[1]["body"])["events"]) == 25 and len(json.loads(got[2]["body"])["events"]) == 1 and got[3]["body"] is None


def test_streams(spark, rows, tmp_path):
    log(rows, 12).write.parquet(str(tmp_path / "log"))
    stream = changes.read_log(spark, str(tmp_path / "log"))
    q = changes.deliver(stream, changes.idempotent_sink(str(tmp_path / "out")), str(tmp_path / "c1"), once=True)
    q.awaitTermination(120)
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1, 13))
    q = changes.upsert_stream(stream, str(tmp_path / "snap"), "entity_id", str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "snap/version=0")).collect()) == [10, 11, 12]
    buckets = changes.token_buckets(stream, "entity_id", "changed_at", 0.01, 2.0)
    q = buckets.writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count_if(allowed) from buckets").first()[0] == 6


def test_failure_states():
    state = (0, "ok", None, True)
    for kind, now in (("hard", 0), ("soft", 1), ("hard", 2), ("hard", 3)):
        state = changes.failure_step(state, kind, now)
    assert state[3] and not changes.failure_step(state, "hard", 4)[3] and not changes.failure_step((1, "soft", 0, True), "soft", 72 * 3600)[3]
    assert not changes.failure_step((0, "ok", None, True), "gone", 0)[3] and changes.failure_step(state, "ok", 9) == (0, "ok", None, True)
