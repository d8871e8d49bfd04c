"""Operators behind the read, ingest and subscription queries, on a few rows."""

import pytest
from pyspark.sql import functions as F

from lexlake.functions import strings as S
from lexlake.operators import detail, filters, ingest, search, sessions, subscriptions, validation


def test_merge_twice_changes_nothing(rows):
    sent = rows("id bigint, v string, seq int", (1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "x", 1)).withColumn("checksum", F.sha2("v", 256))
    stored = rows("id bigint, checksum string").select("id", "checksum")
    first = ingest.merged(sent, stored, ["id"], "checksum", F.col("seq"))
    assert {(r["id"], r["v"], r["outcome"]) for r in first.collect()} == {(1, "b", "created"), (2, "c", "created")}
    again = ingest.merged(sent, first, ["id"], "checksum", F.col("seq"))
    assert {r["outcome"] for r in again.collect()} == {"unchanged"}
    changed = ingest.merged(sent.withColumn("checksum", F.sha2(F.concat("v", F.lit("!")), 256)), first, ["id"], "checksum", F.col("seq"))
    assert {r["outcome"] for r in changed.collect()} == {"updated"}


def test_pull_stops_at_a_quiet_page(rows):
    df = rows("page int, outcome string", (1, "updated"), (1, "unchanged"), (2, "unchanged"), (3, "created"))
    assert sorted(r["page"] for r in ingest.until_unchanged(df, "page", "outcome").collect()) == [1, 1, 2]
    assert ingest.until_unchanged(df.where("page <> 2"), "page", "outcome").count() == 3
    assert ingest.until_unchanged(df.where("page > 5"), "page", "outcome").count() == 0


def test_events_and_watermark(rows):
    df = rows("id int, a string, b string, new boolean", (1, "x", None, False), (2, "x", "y", False), (3, "q", "q", True))
    got = ingest.field_events(df, "id", {"a": F.lit("x"), "b": F.lit(None)}, {"a": F.col("a"), "b": F.col("b")}, F.col("new"))
    assert sorted((r["id"], r["kind"]) for r in got.collect()) == [(2, "b_changed"), (3, "created")]
    runs = rows("pipeline string, state string, started_at int", ("a", "success", 3), ("a", "failed", 9), ("b", "success", 8))
    assert ingest.sync_watermark(runs, "a").collect() == [("a", 3)]


def test_versions_ties_and_texts(rows):
    v = rows("k int, day date, n int, o int, value string", (1, None, 5, 1, "a"), (1, None, 5, 2, "b"), (2, None, 1, 1, "c"), (2, None, 2, 2, "d"))
    assert sorted(tuple(r) for r in ingest.latest_version(v, "k", "day", "n", "o", "value").collect()) == [(1, "a"), (2, "d")]
    docs, texts = rows("id int, checksum string", (1, None), (2, "x"), (3, "z")), rows("id int, checksum string", (1, "n"), (2, "x"))
    once = ingest.texts_onto(docs, texts, "id", "checksum")
    assert sorted((r["id"], r["checksum"], r["written"]) for r in once.collect()) == [(1, "n", True), (2, "x", False), (3, "z", False)]
    assert not any(r["written"] for r in ingest.texts_onto(once.select("id", "checksum"), texts, "id", "checksum").collect())


def test_sessions(rows):
    known = rows("place int, slug string, session_id int, active boolean", (1, "a", 10, False), (1, "b", 11, True), (2, "c", 20, False))
    sent = rows("id int, place int, slug string", (1, 1, "a"), (2, 1, "zz"), (3, 2, "zz"))
    got = {r["id"]: (r["session_id"], r["warning"]) for r in ingest.session_or_active(sent, "slug", "place", known).collect()}
    assert got == {1: (10, None), 2: (11, "active_session_assumed"), 3: (None, "no_session")}
    s = rows("k int, start date, end date, active boolean", (1, None, None, True)).select("k", "start", "end", "active")
    out = sessions.with_dates(s, rows("k int, start date, end date"), ["k"], "2020-01-01").first()
    assert out["did"] == "unknown" and out["active"] is True


def test_records_and_evidence(rows):
    asked, have = rows("k string", ("a",), ("b",), ("c",)), rows("k string, id int", ("a", 1), *(("b", k) for k in range(30)))
    got = {r["k"]: r for r in detail.record_or_candidates(asked, have, "k", "id", 20).collect()}
    assert (got["a"]["outcome"], got["a"]["row_id"], got["c"]["outcome"]) == ("found", 1, "not_found") and got["b"]["candidates"] == list(range(20))
    kids = rows("id int, o int", *((1, k) for k in range(5)), (2, 0))
    packet = {r["id"]: r for r in detail.evidence_packet(rows("id int", (1,), (2,), (3,)), "id", {"actions": (kids, ["o"], ["o"])}, {"actions": 4}).collect()}
    assert [len(packet[k]["actions"] or ()) for k in (1, 2, 3)] == [4, 1, 0]
    assert [(packet[k]["actions_count"], packet[k]["actions_truncated"]) for k in (1, 2, 3)] == [(5, True), (1, False), (0, False)]


def test_subscriptions(rows):
    assert subscriptions.valid_subscription(" Bill ", "7", "B,a", ["a", "b"]) == ("bill", "7", ["a", "b"])
    assert subscriptions.valid_subscription("all", "", None, ["b", "a"]) == ("all", None, ["a", "b"])
    for bad in (("x", "1", None), ("bill", "hb 1", None), ("bill", None, None), ("all", "t", None), ("all", None, "zz")):
        with pytest.raises(ValueError):
            subscriptions.valid_subscription(*bad, ["a"])
    probes = rows("k string, at timestamp_ntz, ok boolean").select("k", "at", "ok")
    assert subscriptions.alarms(probes.withColumn("at", F.col("at").cast("timestamp")), "k").count() == 0
    down = rows("k string, h int, ok boolean", *(("a", h, h not in range(2, 12)) for h in range(14)), ("b", 0, False), ("b", 1, True))
    down = down.withColumn("at", F.timestamp_seconds(F.col("h") * 3600))
    got = [(r["k"], r["h"], r["alarm"]) for r in subscriptions.alarms(down, "k").withColumn("h", F.unix_timestamp("at") / 3600).orderBy("k", "at").collect()]
    assert got == [("a", 3, "down"), ("a", 9, "still_down"), ("a", 12, "up")]


def test_validation(rows):
    bills, kids = rows("id int, title string", (1, "t"), (2, " "), (3, None)), rows("b int", (1,), (2,))
    legs = validation.structural_leg(bills, "id", ["title"], kids, "b")
    assert {r["id"]: r["missing"] for r in legs.collect()} == {1: "", 2: "title", 3: "title,children"}
    noted = validation.recorded(bills, "id", {"s": legs, "late": legs.where("id = 1"), "kw": legs.where("id < 0")})
    assert noted.where("outcome = 'unverifiable'").count() == 5
    assert {r["id"]: r["verdict"] for r in validation.verdicts(noted, "id", ["s"]).collect()} == {1: "pass", 2: "unverifiable", 3: "unverifiable"}


def test_search_parts(rows):
    df = rows("h string", ("a ⟦H⟧b⟦/H⟧ c",), ("⟦H⟧x⟦/H⟧⟦H⟧y⟦/H⟧",), ("plain",), (None,))
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(search.segments("h")).collect()]
    assert got == [[("a ", False), ("b", True), (" c", False)], [("x", True), ("y", True)], [("plain", False)], None]
    some, none = rows("id int", (1,)), rows("id int")
    assert [r["tier"] for r in search.tiered([("a", none), ("b", some), ("c", some)]).collect()] == ["b"]
    assert search.tiered([("a", none), ("c", none)]).count() == 0


def test_text_functions(rows):
    df = rows("h string", ("sub.agency.gov.uk",), ("EXAMPLE.com",), ("gov.uk",), ("10.0.0.1",), ("host",), (None,))
    assert [r[0] for r in df.select(S.registrable_domain(F.col("h"))).collect()] == ["agency.gov.uk", "example.com", None, None, None, None]
    hops = rows("h string", ("8.8.8.8, 10.0.0.1",), ("2001:4860:4860:1:2:3:4:5",), ("::ffff:9.9.9.9",), ("garbage",), (None,))
    assert [r[0] for r in hops.select(S.address_bucket("h")).collect()] == ["8.8.8.8", "2001:4860:4860:1::/64", "9.9.9.9", None, None]
    notes = rows("s string", ("soft_fail",)).select(S.noted_status(S.status_note(F.col("s"))).alias("n"), S.spelled_out(F.lit("sjr 5")).alias("x"), S.spelled_out(F.lit("zz 5")).alias("y")).first()
    assert tuple(notes) == ("soft_fail", "Senate Joint Resolution 5", None)


def test_filters_without_a_query(rows):
    df = rows("k string, a array<string>", ("x", ["p"]), ("y", ["q"]), (None, None))
    assert df.where(filters.null_or_listed("k", "x")).count() == 2


def test_full_record_cuts_hot_records_and_keeps_counts(spark, rows):
    bills = rows("id bigint, jurisdiction_id int", (1, 7), (2, None), (3, 9))
    many = spark.range(5000).selectExpr("1L id", "id % 1000 n")
    lists = {name: (many.limit(0), ["n"], ["n"]) for name in detail.LISTS} | {"actions": (many, ["n"], ["n"])}
    places = rows("jurisdiction_id int, code string", (7, "NC"))
    got = {r["id"]: r for r in detail.full_record(bills, "id", lists, places, "jurisdiction_id", 4).collect()}
    assert [x["n"] for x in got[1]["actions"]] == [0, 0, 0, 0] and got[1]["actions_count"] == 5000 and got[1]["actions_truncated"]
    assert got[1]["jurisdiction"]["code"] == "NC" and got[2]["jurisdiction"] is None and got[3]["jurisdiction"] is None
    assert got[2]["actions_count"] == 0 and not got[2]["votes_truncated"]
    with pytest.raises(ValueError):
        detail.full_record(bills, "id", {"actions": lists["actions"]}, places, "jurisdiction_id")


def test_listed_pages_and_totals(rows):
    df = rows("id int, kind string", *((k, "ab"[k % 2]) for k in range(7)), (9, None))
    got = detail.listed(df, [F.asc("id")], 2, 2, kind="a").collect()
    assert [(r["id"], r["total"]) for r in got] == [(4, 4), (6, 4)]
    assert detail.listed(df, [F.asc("id")], 9, 2).count() == 0
    assert detail.listed(df, [F.asc("id")], 1, 2, kind=None).first()["total"] == 8


def test_contradictions_only_of_places_asked_for(rows):
    df = rows("place string, s string, active boolean", ("a", "died_on_adjournment", True), ("b", "died_on_adjournment", True), ("b", "died_on_adjournment", True), ("c", "dead", True), ("a", None, True), ("a", "died_on_adjournment", None))
    assert [tuple(r) for r in sessions.contradictions(df, "s", "active", "place").collect()] == [("b", 2), ("a", 1)]
    assert [tuple(r) for r in sessions.contradictions(df, "s", "active", "place", ["a"]).collect()] == [("a", 1)]
