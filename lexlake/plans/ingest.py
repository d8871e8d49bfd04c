"""Sessions, bulk and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.functions import digests
from lexlake.functions import strings as S
from lexlake.operators import ingest, sessions
from lexlake.sources import tables as T

from .browse import ACTIONS, BILLS
from .registry import query

TODAY = "1998-06-17"
SESSIONS_SQL = f"(select jurisdiction_id place, year, make_date(year, 12, 31) as \"end\", year >= 1996 active, count(*) n from {BILLS} group by all)"


def session_rows(spark, d):
    rows = T.bills(spark, d).groupBy(F.col("jurisdiction_id").alias("place"), "year").agg(F.count("*").alias("n"))
    return rows.withColumn("end", F.make_date("year", F.lit(12), F.lit(31))).withColumn("active", F.col("year") >= 1996)


@query(f"select place, year from {SESSIONS_SQL} where active and \"end\" < date '{TODAY}'")
def contradicted_sessions(spark, d):
    return sessions.contradicted(session_rows(spark, d), TODAY).select("place", "year")


@query(f"select id from (select id, year, case status_code when 'O' then 'introduced' when 'F' then 'enacted' end s from {BILLS}) where make_date(year, 12, 31) < date '{TODAY}' and year < 1996 and (s is null or s = 'introduced') order by id limit 20000")
def swept_bills(spark, d):
    status = F.when(F.col("status_code") == "O", "introduced").when(F.col("status_code") == "F", "enacted")
    rows = T.bills(spark, d, of_customer=False).withColumns({"status": status, "end": F.make_date("year", F.lit(12), F.lit(31)), "active": F.col("year") >= 1996})
    return sessions.to_sweep(rows, "status", "end", "active", TODAY).select("id")


@query(f"""select place, year, cast("start" as varchar) as "start", cast("end" as varchar) as "end", active, did from (
 select place, year, f, coalesce(f, s) as "start", coalesce(t, e) as "end", case when coalesce(t, e) is null then active else coalesce(t, e) >= date '{TODAY}' end active,
 case when t is null and f is null then 'unknown' when e is null and s is null then 'filled' when not (coalesce(f, s) is not distinct from s and coalesce(t, e) is not distinct from e) then 'corrected' else 'same' end did
 from (select place, year, active, case when year % 3 = 0 then make_date(year, 1, 1) end s, case when year % 3 = 0 then "end" end e, case when n % 2 = 0 then make_date(year, 1, 1) end f, case when n % 2 = 0 then make_date(year, 12, 30 + cast(place % 2 as int)) end t from {SESSIONS_SQL}))""")
def session_dates(spark, d):
    rows = session_rows(spark, d)
    first = F.make_date("year", F.lit(1), F.lit(1))
    known = rows.select("place", "year", "active", F.when(F.col("year") % 3 == 0, first).alias("start"), F.when(F.col("year") % 3 == 0, F.col("end")).alias("end"))
    found = rows.where("n % 2 = 0").select("place", "year", first.alias("start"), F.make_date("year", F.lit(12), (F.col("place") % 2 + 30).cast("int")).alias("end"))
    out = sessions.with_dates(known, found, ["place", "year"], TODAY)
    return out.select("place", "year", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "active", "did")


@query(f"select distinct part_id % 50 place, year(day) y from {ACTIONS} where (kind ilike 'a%' or kind ilike '%o') and day > date '{TODAY}' - 30 and day <= date '{TODAY}'")
def recent_sessions(spark, d):
    rows = T.actions(spark, d).select((F.col("part_id") % 50).alias("place"), F.year("day").cast("long").alias("y"), "day", "kind")
    return sessions.recently_active(rows, ["place", "y"], "day", F.col("kind"), ["a%", "%o"], TODAY)


@query(f"select place, year, n from {SESSIONS_SQL} order by n desc, place, year limit 8")
def top_sessions(spark, d):
    rows = T.bills(spark, d).withColumnRenamed("jurisdiction_id", "place")
    return sessions.largest(rows, ["place", "year"], 8)


@query("select slug, case when slug like '%special%' then 'special' else 'regular' end class from (select distinct year(o_orderdate) || case when o_orderstatus = 'P' then '-special-session-1' else '-regular' end slug from orders)")
def new_session_class(spark, d):
    o = T.bills(spark, d, of_customer=False)
    slug = F.concat(F.col("year").cast("string"), F.when(F.col("status_code") == "P", "-special-session-1").otherwise("-regular"))
    return o.select(slug.alias("slug")).distinct().select("slug", S.session_class("slug").alias("class"))


@query("select l_orderkey bill_id, l_linenumber place, n_name org from lineitem left join (select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 4 <> 0) on l_suppkey = s_suppkey")
def organisations_resolved(spark, d):
    known = T.table(spark, d, "supplier").where("s_suppkey % 4 <> 0").join(T.jurisdictions(spark, d), F.col("s_nationkey") == F.col("jurisdiction_id")).select("s_suppkey", "code")
    return ingest.resolved(T.actions(spark, d), "sponsor_id", known, "s_suppkey", "code", "org").select("bill_id", "place", "org")


@query("""with i as (select l_orderkey id, arg_max(sha256(l_linenumber || '|' || l_returnflag || '|' || l_suppkey), (l_linenumber, l_suppkey, l_returnflag)) checksum from lineitem group by 1),
 s as (select l_orderkey id, max(sha256(l_linenumber || '|' || l_returnflag || '|' || l_suppkey)) filter (l_linenumber = 1) stored from lineitem where l_orderkey % 3 <> 0 group by 1)
 select id, case when stored is null then 'created' when stored = checksum then 'unchanged' else 'updated' end outcome from i left join s using (id)""")
def bulk_merge(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("sponsor"))
    rows = rows.withColumn("checksum", F.sha2(F.concat_ws("|", F.col("place").cast("string"), "flag", F.col("sponsor").cast("string")), 256))
    stored = rows.where("id % 3 <> 0 and place = 1").select("id", "checksum")
    return ingest.merged(rows, stored, ["id"], "checksum", F.struct("place", "sponsor", "flag")).select("id", "outcome")


PULL_SQL = "(select o_orderkey id, (o_orderkey // 4000) page, case when o_orderkey % 5 = 0 and o_orderkey // 4000 <> 2 then 'updated' when o_orderkey % 7 = 0 and o_orderkey // 4000 <> 2 then 'created' else 'unchanged' end outcome, o_orderstatus s, o_orderpriority p from orders)"


def pull(spark, d):
    page, id_ = F.expr("o_orderkey div 4000"), F.col("o_orderkey")
    quiet = page == 2
    outcome = F.when((id_ % 5 == 0) & ~quiet, "updated").when((id_ % 7 == 0) & ~quiet, "created").otherwise("unchanged")
    return T.table(spark, d, "orders").select(id_.alias("id"), page.alias("page"), outcome.alias("outcome"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))


@query(f"select id, page, outcome from {PULL_SQL} where page <= coalesce((select min(page) from (select page from {PULL_SQL} group by page having bool_and(outcome = 'unchanged'))), 1000000000)")
def incremental_pull(spark, d):
    return ingest.until_unchanged(pull(spark, d), "page", "outcome").select("id", "page", "outcome")


@query(f"select id, unnest(list_filter([case when outcome = 'created' then 'created' end, case when outcome <> 'created' and s <> 'O' then 'status_changed' end, case when outcome <> 'created' and p is distinct from '1-URGENT' then 'title_changed' end], lambda x: x is not null)) kind from {PULL_SQL} where outcome <> 'unchanged'")
def change_events(spark, d):
    rows = pull(spark, d).where("outcome <> 'unchanged'")
    return ingest.field_events(rows, "id", {"status": F.lit("O"), "title": F.lit("1-URGENT")}, {"status": F.col("s"), "title": F.col("p")}, F.col("outcome") == "created")


@query("select o_orderkey id, cast(cast(greatest(o_orderdate, case when o_orderkey % 3 = 0 then timestamp '1995-05-05' end) as date) as varchar) updated from orders")
def updated_never_back(spark, d):
    sent = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1995-05-05").cast("date"))
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ingest.never_back(F.col("o_orderdate").cast("date"), sent).cast("string").alias("updated"))


@query(f"""with a as (select bill_id, place, part_id, min(day) as day, min(kind) kind from {ACTIONS} group by all), s as (select * from a where part_id % 3 <> 0)
 select a.bill_id, a.place, a.part_id, case when s.bill_id is null then 'inserted' when a.part_id % 5 = 0 then 'revised' else 'kept' end outcome from a left join s using (bill_id, place, part_id)""")
def revised_actions(spark, d):
    key = ["bill_id", "place", "part_id"]
    rows = T.actions(spark, d).groupBy(*key).agg(F.min("day").alias("day"), F.min("kind").alias("kind"))
    sent = rows.withColumn("day", F.when(F.col("part_id") % 5 == 0, F.date_add("day", 1)).otherwise(F.col("day")))
    return ingest.revised_children(sent, rows.where("part_id % 3 <> 0"), key, ["day", "kind"]).select(*key, "outcome")


@query(f"""with s as (select place, year, year >= 1996 active from {SESSIONS_SQL} where year <> 1993), b as (select id, jurisdiction_id place, year from {BILLS}), x as (select place, max(year) a from s where active group by place)
 select id, coalesce(s.year, a) session_id, case when s.year is null then case when a is null then 'no_session' else 'active_session_assumed' end end warning from b left join s using (place, year) left join x using (place)""")
def session_for_payload(spark, d):
    known = session_rows(spark, d).where("year <> 1993").select("place", F.col("year").cast("string").alias("slug"), F.col("year").alias("session_id"), "active")
    rows = T.bills(spark, d).select("id", F.col("jurisdiction_id").alias("place"), F.col("year").cast("string").alias("slug"))
    return ingest.session_or_active(rows, "slug", "place", known).select("id", "session_id", "warning")


RUNS_SQL = "(select event_type pipeline, ts started_at, case when user_id % 3 = 0 then 'bad' end as error from events)"


def runs(spark, d):
    rows = T.change_log(spark, d).withColumn("error", F.when(F.col("entity_id") % 3 == 0, "bad"))
    return rows.select(F.col("kind").alias("pipeline"), *[c for c in ingest.run_row("x", F.col("changed_at"), F.col("changed_at"), F.lit(1), F.col("error"))[1:]])


@query(f"select pipeline, cast(epoch_us(max(started_at) filter (error is null)) as bigint) since from {RUNS_SQL} group by 1")
def sync_watermarks(spark, d):
    return ingest.sync_watermark(runs(spark, d)).select("pipeline", F.unix_micros(F.col("since").cast("timestamp")).alias("since"))


@query(f"select pipeline, case when error is null then 'success' else 'failed' end state, count(*) n from {RUNS_SQL} group by all")
def run_ledger(spark, d):
    return runs(spark, d).groupBy("pipeline", "state").agg(F.count("*").alias("n"))


@query("select l_partkey part_id, arg_max(l_orderkey, (coalesce(cast(l_shipdate as date), date '0001-01-01'), l_linenumber, -l_orderkey)) version from lineitem group by 1")
def latest_bulk_version(spark, d):
    rows = T.actions(spark, d).select("part_id", "day", "place", "bill_id", F.col("bill_id").alias("version"))
    return ingest.latest_version(rows, "part_id", "day", "place", "bill_id", "version")


@query("select p_partkey id, case when p_size % 4 = 0 then false else sha256(p_name) is distinct from case when p_size % 3 = 0 then sha256(p_name) end end written from part")
def texts_written(spark, d):
    p = T.table(spark, d, "part")
    docs = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, F.sha2("p_name", 256)).alias("checksum"))
    texts = p.where("p_size % 4 <> 0").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("checksum"))
    return ingest.texts_onto(docs, texts, "id", "checksum").select("id", "written")


@query("select c_custkey id, case when s is null or s = 'NOT_STARTED' then 'SOURCE_IDENTIFIED' else s end status from (select c_custkey, case c_mktsegment when 'BUILDING' then 'NOT_STARTED' when 'MACHINERY' then 'GREEN' when 'FURNITURE' then 'BLOCKED' end s from customer)")
def registry_advanced(spark, d):
    m = F.col("c_mktsegment")
    stored = F.when(m == "BUILDING", "NOT_STARTED").when(m == "MACHINERY", "GREEN").when(m == "FURNITURE", "BLOCKED")
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ingest.advanced(stored, F.lit("SOURCE_IDENTIFIED")).alias("status"))


@query("select event_id seq, case when t is null and ts < timestamp '2024-01-15' then case when user_id % 50 = 0 then 'probe' end else t end tag from (select *, case when event_type = 'click' then 'user' end t from events)")
def retagged(spark, d):
    rows = T.change_log(spark, d).withColumn("tag", F.when(F.col("kind") == "click", "user"))
    return ingest.tagged_before(rows, "tag", "changed_at", "2024-01-15", F.when(F.col("entity_id") % 50 == 0, "probe")).select("seq", "tag")
