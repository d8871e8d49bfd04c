"""What is written and read again: archives, postings, tables, reports, feeds."""

import zipfile

from pyspark.sql import functions as F

from lexlake.operators import feed, paging
from lexlake.sources import bulk, sinks


def test_archives_from_their_paths(spark, rows, tmp_path):
    for n, name in enumerate(("a", "b")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x_bills.csv", "id,session,extra\n" + "".join(f"{n}{k},s{n},z\n" for k in range(25)))
            z.writestr("text/t1.txt", f"text of {name}")
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("other.csv", "id\n1\n")
    got = bulk.zip_csv(spark, str(tmp_path / "*.zip"), ("_bills.csv",), ["id", "session", "missing"], split=10)
    assert got.count() == 50 and {r["missing"] for r in got.collect()} == {None}
    assert bulk.first_session(got.orderBy("id"), "session") == "s0" and bulk.first_session(got.where("false"), "session") is None
    named = got.where("id = '01'").withColumn("file", F.lit("x/y/t1.txt")).union(got.where("id = '02'").withColumn("file", F.lit("nope")))
    assert {r["id"]: r["content"] and bytes(r["content"]) for r in bulk.with_bodies(named, bulk.zip_members(spark, str(tmp_path / "*.zip")), "file").collect()} == {"01": b"text of a", "02": None}


def test_tables_and_reports(spark, rows, tmp_path):
    a, b = rows("id int", (1,)), rows("id int, a int", (1, 1), (2, 1))
    for _ in range(2):
        sinks.write_tables({"child": b, "parent": a}, str(tmp_path), ["parent"])
    assert spark.read.parquet(f"{tmp_path}/child").count() == 4 and spark.read.parquet(f"{tmp_path}/parent").count() == 2
    sinks.write_report(b, str(tmp_path / "report"), {"who": ["id"], "what": ["a"]})
    assert {(r["who"]["id"], r["what"]["a"]) for r in spark.read.json(str(tmp_path / "report")).collect()} == {(1, 1), (2, 1)}
    calls = rows("occurred_at int, tool string, outcome string, error_code string, client_family string, duration_ms int", (1, "t" * 99, "ok", None, "c", 5))
    sinks.telemetry(calls, str(tmp_path / "calls"))
    assert spark.read.parquet(str(tmp_path / "calls")).first()["tool"] == "t" * 80


def test_feeds(rows):
    log = rows("key string, seq bigint, title string, at string", ("a", 2, "two <&>", "2024-01-02 00:00:00"), ("a", 1, "one", "2024-01-01 00:00:00")).withColumn("changed_at", F.col("at").cast("timestamp_ntz"))
    xml = sinks.atom_feeds(sinks.atom_entries(log, "https://x/")).first()["xml"]
    assert xml.index("two &lt;&amp;&gt;") < xml.index("one") and "<updated>2024-01-02T00:00:00Z</updated><entry>" in xml
    mails = sinks.digest_html(feed.digest(rows("key string, seq bigint, kind string", *(("k", n, "a<b") for n in range(40))), "key")).first()
    assert mails["html"].count("<li>") == 30 and "and 10 more" in mails["html"] and "a&lt;b" in mails["html"]


def test_numbers_by_ranges(rows):
    df = rows("g string, seq bigint", *((("hot" if k % 3 else None), k * 7 % 1000) for k in range(500)))
    got = paging.numbered(df, ["g"], "seq", "n", rows=37).collect()
    for g in ("hot", None):
        mine = sorted((r["seq"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert sorted(r["chunk"] for r in paging.chunks(df.select("seq").distinct(), "seq", 100, rows=50).collect())[-1] == 4
    assert paging.numbered(df.where("false"), ["g"], "seq", "n").count() == 0
