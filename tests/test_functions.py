"""Golden rows of the scalar functions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lexlake.functions import dates, digests
from lexlake.functions import strings as S
from lexlake.operators import coverage, feed, paging
from lexlake.operators import status as ST


def value(spark, expression, **columns):
    df = spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in columns.items()), F.lit(1).alias("_"))
    return df.select(expression.alias("x")).first()[0]


@pytest.mark.parametrize("raw, want", [("H.B. 123", "HB 123"), ("hb-123", "HB 123"), ("HB123", "HB 123"), ("A1234", "A 1234"), ("SB0001", "SB 1"), ("HB 123A", "HB 123A"), ("000", "0"), ("7", "7"), ("none", None), ("", None), (None, None)])
def test_bill_number(spark, raw, want):
    assert value(spark, S.bill_number("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [("20252026", ["2025", "2026"]), ("2026rs", ["2026"]), ("89R", []), ("1999-2000", ["1999", "2000"])])
def test_years(spark, raw, want):
    assert value(spark, S.years("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [("89R", ["89"]), ("57th-2nd-regular", ["57", "2"]), ("Council Period 26", ["26"]), ("891", ["89", "1"]), ("2025", [])])
def test_ordinals(spark, raw, want):
    assert value(spark, S.ordinals("a"), a=raw) == want


def test_small_strings(spark):
    assert value(spark, S.list_repr("a"), a="['x y', \"z\"]") == ["x y", "z"]
    assert value(spark, S.list_repr("a"), a="plain") == ["plain"]
    assert value(spark, S.list_repr("a"), a=None) == []
    assert value(spark, S.slug("a"), a=" The Act (2) ") == "the-act-2"
    assert value(spark, S.plain_text("a"), a="a  \r\nb\n\n\n\nc\0\n") == "a\nb\n\nc"
    assert value(spark, S.visible_text("a"), a="<p>x<script>var p='</p>'</script> y</p>") == "x y"
    assert value(spark, S.vote_detail("a", "b", "c", "y", "n"), a="Senate", b="Pass", c="pass", y="3", n="2") == "Senate: Pass -- pass 3-2"
    assert value(spark, S.vote_detail("a", "b", "c", "y", "n"), a="Senate", b=" ", c=None, y=None, n=None) == "Senate"
    assert value(spark, S.truth("a"), a=" YES ") is True and value(spark, S.truth("a"), a=None) is False
    assert value(spark, S.admissible_url("a"), a="https://Example.ORG/x") == "https://example.org/x"
    assert value(spark, S.admissible_url("a"), a="http://example.org/x") is None
    assert value(spark, S.admissible_url("a"), a="https://localhost/") is None
    assert value(spark, S.longest_word("a", ["longer"]), a="some longest winner longer") == "longest"
    assert value(spark, S.lines("a"), a=" a \n\n b") == ["a", "b"]


def test_dates(spark):
    for raw, want in (("2026-03-01", "2026-03-01"), ("03/01/2026", "2026-03-01"), ("2026-03-01T10:00:00", "2026-03-01"), ("soon", None), ("", None)):
        assert value(spark, dates.lenient_date(F.col("a")).cast("string"), a=raw) == want
    assert value(spark, dates.delivery_delay(F.lit(30))) == 21600
    assert value(spark, dates.delivery_delay(F.lit(1), F.lit(90000))) == 21600
    assert value(spark, dates.delivery_delay(F.lit(1), F.lit(-1))) == 120


def test_signature(spark):
    for secret in (b"k", b"s" * 100):
        want = hmac.new(secret, b"17.body", hashlib.sha256).hexdigest()
        assert value(spark, digests.signature("b", "t", secret), b="body", t="17") == want


def test_cursor():
    for seq in (0, 5, (1 << 63) - 1):
        assert paging.decode_cursor(paging.encode_cursor(seq)) == seq
    for bad in ("", "x", "W10", paging.encode_cursor(1)[:-3], paging.encode_cursor(-1), paging.encode_cursor(1 << 63), paging.encode_cursor(True)):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad)


@pytest.mark.parametrize(
    "actions, want",
    [
        ([("2026-01-01", None, "Died In Committee")], "dead"),
        ([("2026-01-01", "became-law", None), ("2026-02-01", "referral-committee", None)], "enacted"),
        ([("2026-01-01", "executive-veto", None), ("2026-01-01", None, "Veto overridden")], "enacted"),
        ([(None, "executive-veto", None), ("2020-01-01", "failure", None)], "dead"),
        ([("2026-01-01", None, "Motion to withdraw failed")], None),
        ([("2026-01-01", "introduction, passage", "x")], "passed_one_chamber"),
        ([("2026-01-01", "unheard-of", "Referred to Ways and Means")], "in_committee"),
    ],
)
def test_derive(rows, actions, want):
    df = rows("k int, day date, classes string, words string", *((1, __import__("datetime").date.fromisoformat(d) if d else None, c, t) for d, c, t in actions))
    got = ST.derive(df, "k", "day", ST.of_action("classes", "words")).collect()
    assert (got[0]["status"] if got else None) == want


@pytest.mark.parametrize(
    "status, end, active, recent, want",
    [
        ("in_committee", "2026-01-01", False, False, "died_on_adjournment"),
        ("in_committee", "2026-06-01", False, False, "in_committee"),
        ("in_committee", None, False, False, "in_committee"),
        ("enrolled", "2026-01-01", False, False, "enrolled"),
        ("in_committee", "2026-01-01", True, True, "in_committee"),
        ("in_committee", "2026-01-01", True, False, None),
        (None, "2026-01-01", False, False, "died_on_adjournment"),
    ],
)
def test_after_session(spark, status, end, active, recent, want):
    x = ST.after_session(F.lit(status).cast("string"), F.lit(end).cast("date"), F.lit(active), F.lit(recent), F.lit("2026-06-01").cast("date"))
    assert value(spark, x) == want


def test_coverage(spark):
    v = lambda s, b, r, t, a: value(spark, coverage.by_validation(F.lit(s), F.lit(b), F.lit(r).cast("double"), F.lit(t), F.lit(a).cast("int")))
    assert v("VALIDATING", 5, 1.0, 0, 0) == "GREEN"
    assert v("METADATA_SEARCHABLE", 5, 1.0, 0, None) == "VALIDATING"
    assert v("GREEN", 5, 0.5, 5, 5) == "DEGRADED"
    assert v("BLOCKED", 5, 1.0, 5, 5) == "BLOCKED"
    assert v("GREEN", 5, 1.0, 1, 5) == "VALIDATING"
    assert v("GREEN", 0, 0.1, 1, 5) == "GREEN"
    c = lambda s, b, t: value(spark, coverage.by_counts(F.lit(s), F.lit(b), F.lit(t)))
    assert c("NOT_STARTED", 1, 0) == "METADATA_SEARCHABLE" and c("NOT_STARTED", 0, 0) == "NOT_STARTED" and c("BOOTSTRAPPED", 3, 1) == "FULL_TEXT_SEARCHABLE" and c("DEGRADED", 3, 1) == "DEGRADED"


def test_halved():
    assert feed.halved([10] * 8, 45) == 4 and feed.halved([50], 45) == 0 and feed.halved([], 45) == 0


def test_classes_of_answers(spark):
    want = {200: "ok", 204: "ok", 301: "redirect", 404: "hard", 422: "hard", 408: "retryable", 425: "retryable", 409: "retryable", 410: "gone", 429: "limited", 500: "soft", 503: "soft", None: "transport"}
    df = spark.createDataFrame([(k,) for k in want], "s int")
    assert {r["s"]: r["c"] for r in df.select("s", S.error_class("s").alias("c")).collect()} == want
