"""Aggregations, statuses and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.functions import dates
from lexlake.operators import aggregates, coverage, filters, joins, schedule
from lexlake.operators import status as ST
from lexlake.sources import tables as T

from .browse import ACTIONS, BILLS
from .registry import query

KIND_CLASSES = {"RF": "failure", "AF": "passage", "NO": "referral-committee", "NF": "became-law"}
STATUS_SQL = "case kind when 'NF' then 'enacted' when 'RF' then 'dead' when 'AF' then 'passed_one_chamber' when 'NO' then 'in_committee' end"
RANK_SQL = "case s when 'introduced' then 10 when 'in_committee' then 20 when 'passed_one_chamber' then 30 when 'dead' then 70 when 'enacted' then 90 end"
DERIVED_SQL = f"(select bill_id, arg_max(s, (case when s in ('enacted', 'dead') then 1 else 0 end) * 1000000000 + datediff('day', date '1900-01-01', day) * 100 + {RANK_SQL}) as status from (select bill_id, day, {STATUS_SQL} s from {ACTIONS}) where s is not null group by bill_id)"
TODAY = "1998-06-17"
FATE_SQL = f"case when status is not null and status in ('enacted', 'dead') then status when make_date(year, 12, 31) >= date '{TODAY}' then status when year < 1997 then 'died_on_adjournment' when jurisdiction_id % 2 = 0 then status end"


def derived(spark, d):
    classes = F.create_map(*(F.lit(x) for k, v in KIND_CLASSES.items() for x in (k, v)))
    rows = T.actions(spark, d).select("bill_id", "day", F.try_element_at(classes, F.col("kind")).alias("classes"), F.lit(None).cast("string").alias("words"))
    return ST.derive(rows, "bill_id", "day", ST.of_action("classes", "words"))


def fated(spark, d):
    bills = T.bills(spark, d).select("id", "jurisdiction_id", "year", "status_code")
    rows = bills.join(derived(spark, d), F.col("id") == F.col("bill_id"), "left")
    fate = ST.after_session(F.col("status"), F.make_date("year", F.lit(12), F.lit(31)), F.col("year") >= 1997, F.col("jurisdiction_id") % 2 == 0, F.lit(TODAY).cast("date"))
    return rows.select("id", "jurisdiction_id", "year", "status_code", fate.alias("status"))


@query(f"select bill_id, status from {DERIVED_SQL}")
def derive_status(spark, d):
    return derived(spark, d)


@query(f"select id, {FATE_SQL} as status from {BILLS} left join {DERIVED_SQL} on bill_id = id")
def session_fate(spark, d):
    return fated(spark, d).select("id", "status")


@query(f"""with c as (select id, case status_code when 'F' then 'enacted' when 'P' then 'dead' end as old, status as new from {BILLS} left join {DERIVED_SQL} on bill_id = id)
 select id, old, new, old is not null and new is not null event from c where old is distinct from new""")
def status_changes(spark, d):
    bills = T.bills(spark, d, of_customer=False)
    current = bills.select("id", F.when(F.col("status_code") == "F", "enacted").when(F.col("status_code") == "P", "dead").alias("status"))
    return ST.status_changes(derived(spark, d).withColumnRenamed("bill_id", "id"), current, "id")


@query(f"""with s as (select n_name code, {FATE_SQL} as status from {BILLS} join nation on n_nationkey = jurisdiction_id left join {DERIVED_SQL} on bill_id = id),
 g as (select code, count(*) total, count(*) filter (status = 'enacted') passed, count(*) filter (status = 'died_on_adjournment') died, count(*) filter (status in ('dead', 'vetoed', 'withdrawn')) killed,
 count(*) filter (status in ('introduced', 'in_committee', 'passed_one_chamber', 'passed_both', 'enrolled')) pending, count(*) filter (status is null) unknown, grouping(code) = 1 is_total from s group by rollup (code))
 select *, died + killed did_not_pass, died + killed > 0 and (died = 0 or killed = 0) degenerate, passed * 10000 // nullif(total, 0) passed_bp, (died + killed) * 10000 // nullif(total, 0) did_not_pass_bp from g""")
def mortality_by_nation(spark, d):
    rows = joins.with_labels(fated(spark, d), T.jurisdictions(spark, d), "jurisdiction_id", "jurisdiction_id", ["code"])
    return aggregates.mortality(rows, "code", "status")


@query("""select event_type tool, count(*) filter (not probe and outcome = 'ok') ok, count(*) filter (not probe and outcome = 'error') as error, count(*) filter (probe) excluded, percentile_disc(0.5) within group (order by ms) filter (not probe and outcome = 'ok') median
 from (select event_type, user_id % 50 = 0 probe, case when event_type = 'error' then 'error' else 'ok' end outcome, cast(floor(value * 1000) as bigint) ms from events) group by 1""")
def usage_by_tool(spark, d):
    rows = T.change_log(spark, d).select(F.col("kind").alias("tool"), F.when(F.col("kind") == "error", "error").otherwise("ok").alias("outcome"), F.floor(F.col("value") * 1000).cast("long").alias("ms"), "entity_id")
    return aggregates.usage(rows, "tool", "outcome", "ms", F.col("entity_id") % 50 == 0)


@query("select json_extract_string(props, '$.k') code, count(*) n from events where event_type = 'error' group by 1")
def error_histogram(spark, d):
    rows = T.change_log(spark, d).where("kind = 'error'")
    return rows.groupBy(F.get_json_object("detail", "$.k").alias("code")).agg(F.count("*").alias("n"))


COVERAGE_SQL = "(select source, count(distinct d.doc_id) bills, count(distinct case when quality = 1 then d.doc_id end) with_text, count(distinct case when quality = 1 or (quality is not null and toxic = 0) then d.doc_id end) available from documents d left join labels l using (doc_id) group by source)"


def covered(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    marks = T.table(spark, d, "labels")
    texts = docs.join(marks, F.col("id") == F.col("doc_id")).select("source", F.col("id").alias("bill_id"), (F.col("quality") == 1).alias("has_text"), (F.col("toxic") == 1).alias("terminal"))
    return coverage.counts(docs, texts, "source")


@query(f"select source, bills, with_text, available from {COVERAGE_SQL}")
def coverage_counts(spark, d):
    return covered(spark, d)


@query(f"""with c as (select *, ['NOT_STARTED', 'BOOTSTRAPPED', 'DEGRADED', 'BLOCKED', 'VALIDATING'][1 + (length(source) + bills) % 5] state, case when with_text % 3 = 0 then null else 90 + with_text % 11 end rate from {COVERAGE_SQL}),
 n as (select *, case when state in ('GREEN', 'DEGRADED', 'BLOCKED', 'VALIDATING') then state when with_text > 0 then 'FULL_TEXT_SEARCHABLE' when bills > 0 then 'METADATA_SEARCHABLE' else state end counted from c)
 select source, state, counted, case when bills = 0 or rate is null then counted when rate < 95 then case when counted = 'BLOCKED' then counted else 'DEGRADED' end
 when available = 0 or with_text * 100 >= 95 * available then case when counted = 'BLOCKED' then counted else 'GREEN' end when counted in ('BOOTSTRAPPED', 'METADATA_SEARCHABLE', 'SOURCE_IDENTIFIED', 'FULL_TEXT_SEARCHABLE', 'DEGRADED', 'GREEN') then 'VALIDATING' else counted end validated from n""")
def coverage_next_status(spark, d):
    states = F.array(*map(F.lit, ("NOT_STARTED", "BOOTSTRAPPED", "DEGRADED", "BLOCKED", "VALIDATING")))
    rows = covered(spark, d).withColumn("state", F.get(states, ((F.length("source") + F.col("bills")) % 5).cast("int")))
    rate = F.when(F.col("with_text") % 3 != 0, (90 + F.col("with_text") % 11) / 100)
    rows = rows.withColumn("counted", coverage.by_counts(F.col("state"), F.col("bills"), F.col("with_text")))
    return rows.select("source", "state", "counted", coverage.by_validation(F.col("counted"), F.col("bills"), rate, F.col("with_text"), F.col("available")).alias("validated"))


WORST_SQL = "(select c_custkey // 3 place, case c_mktsegment when 'AUTOMOBILE' then 'GREEN' when 'BUILDING' then 'BOOTSTRAPPED' when 'FURNITURE' then 'VALIDATING' when 'MACHINERY' then 'METADATA_SEARCHABLE' else 'ODD' end state from customer)"


def states(spark, d):
    c = T.table(spark, d, "customer")
    names = F.create_map(*(F.lit(x) for x in ("AUTOMOBILE", "GREEN", "BUILDING", "BOOTSTRAPPED", "FURNITURE", "VALIDATING", "MACHINERY", "METADATA_SEARCHABLE")))
    return c.select(F.expr("c_custkey div 3").alias("place"), F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), F.lit("ODD")).alias("state"))


@query(f"select place, arg_min(state, v * 1000 + ascii(state)) worst, min(v) severity from (select *, case state when 'GREEN' then 6 when 'VALIDATING' then 5 when 'METADATA_SEARCHABLE' then 3 when 'BOOTSTRAPPED' then 2 else 0 end v from {WORST_SQL}) group by place")
def worst_status(spark, d):
    return aggregates.worst_status(states(spark, d), "place", "state")


@query(f"select place, case when count(distinct state) = 1 then min(state) else 'MIXED' end summary from {WORST_SQL} group by place")
def summary_status(spark, d):
    return aggregates.summary_status(states(spark, d), "place", "state")


@query(f"select place from {WORST_SQL} group by place having bool_and(state in ('BOOTSTRAPPED', 'ODD', 'METADATA_SEARCHABLE', 'VALIDATING')) or sum(case when state = 'GREEN' then 0 else 1 end) = 0")
def bootstrap_set(spark, d):
    rows = states(spark, d).withColumn("n", F.when(F.col("state") == "GREEN", 0).otherwise(1))
    return aggregates.all_below_or_empty(rows, "place", "state", "n", ["BOOTSTRAPPED", "ODD", "METADATA_SEARCHABLE", "VALIDATING"])


TOPICS = {"metals": ("%brass%", "%steel%"), "economy": ("%economy%",), "colours": ("%red%", "%blue%green%", "%ivory%"), "widgets": ("%widget%",)}
TOPIC_SQL = {t: " or ".join(f"lower(p_name || ' ' || p_type) like '{p}'" for p in ps) for t, ps in TOPICS.items()}


def topic_rows(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return rows, {t: filters.any_like("title", ps) for t, ps in TOPICS.items()}


@query(" union all ".join(f"select '{t}' topic, count(*) filter ({c}) n from part" for t, c in TOPIC_SQL.items()))
def topic_counts(spark, d):
    return aggregates.topic_counts(*topic_rows(spark, d))


@query(f"select p_partkey id, p_name || ' ' || p_type title from part where {TOPIC_SQL['colours']}")
def topic_members(spark, d):
    rows, topics = topic_rows(spark, d)
    return rows.where(topics["colours"])


@query(f"select bill_id, arg_max(kind, (day, place, part_id, sponsor_id, cents)) latest from (select bill_id, day, place, part_id, sponsor_id, cents, kind from {ACTIONS}) group by bill_id")
def latest_action_argmax(spark, d):
    return aggregates.latest_child(T.actions(spark, d), "bill_id", "kind", ["day", "place", "part_id", "sponsor_id", "cents"], "latest")


@query(f"select bill_id, arg_min(kind, (day, place, part_id, sponsor_id, cents)) as first from {ACTIONS} group by bill_id")
def introduced_argmin(spark, d):
    return aggregates.first_child(T.actions(spark, d), "bill_id", "kind", ["day", "place", "part_id", "sponsor_id", "cents"], "first")


@query("select l_orderkey bill_id, cast(sum(case when l_returnflag = 'A' then cast(l_quantity as bigint) else 0 end) as bigint) yes, cast(sum(case when l_returnflag = 'R' then cast(l_quantity as bigint) else 0 end) as bigint) as no, cast(sum(case when l_returnflag not in ('A', 'R') then cast(l_quantity as bigint) else 0 end) as bigint) other from lineitem group by 1")
def vote_tally(spark, d):
    flag = F.substring("kind", 1, 1)
    option = F.when(flag == "A", "yes").when(flag == "R", "no").otherwise("other")
    return aggregates.tally(T.actions(spark, d), "bill_id", option, F.col("quantity"))


@query(" union all ".join(f"select '{w}' word, count(*) filter (p_name ilike '%{w}%') n from part" for w in ("blue", "green", "small", "large")).join(("select * from (", ") order by n, length(word) desc, word limit 1")))
def rarest_word(spark, d):
    return aggregates.rarest(T.table(spark, d, "part"), "p_name", ["blue", "green", "small", "large"])


@query("select source, count(quality) checked, count(*) filter (quality = 1) passed, count(*) filter (quality = 1) * 10000 // nullif(count(quality), 0) rate_bp from documents left join labels using (doc_id) group by source")
def pass_rate(spark, d):
    docs, marks = T.table(spark, d, "documents").select("doc_id", "source"), T.table(spark, d, "labels").select("doc_id", "quality")
    legs = docs.join(marks, "doc_id", "left").withColumn("outcome", F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").otherwise("unverifiable"))
    return aggregates.pass_rate(legs, "source", "outcome")


@query(f"select id from {BILLS} where status_code = 'O' and datediff('day', make_date(year, 12, 31), date '1999-06-17') > 180")
def enrolled_uncaptured(spark, d):
    rows = T.bills(spark, d).select("id", F.when(F.col("status_code") == "O", "enrolled").alias("status"), F.make_date("year", F.lit(12), F.lit(31)).alias("end"))
    return rows.where(filters.enrolled_uncaptured("status", "end", "1999-06-17")).select("id")


@query("""with p as (select doc_id, source, lang, exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1)::int covered from documents d),
 n as (select *, row_number() over (partition by source, lang order by doc_id) in_item from p) select doc_id, source, row_number() over (partition by source order by covered, in_item, doc_id) turn from n""")
def fair_round_robin(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "source", "lang")
    good = T.table(spark, d, "labels").where("quality = 1").select("doc_id")
    return schedule.fair_order(joins.marked(docs, good, "doc_id", "covered"), "source", "lang", "covered", ["doc_id"]).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@query("select user_id entity_id, event_type kind, event_id seq from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def dedup_newest(spark, d):
    return joins.newest(T.change_log(spark, d), ["entity_id", "kind"], [F.desc("changed_at"), F.desc("seq")]).select("entity_id", "kind", "seq")


PRIORITY_SQL = "select c_custkey k, c_nationkey p, case when c_mktsegment = 'BUILDING' then 0 when c_mktsegment = 'MACHINERY' then 1 else 2 end pr, m from customer left join (select o_custkey ck, max(cast(o_orderdate as date)) m from orders group by 1) on ck = c_custkey"


@query(f"with r as ({PRIORITY_SQL}), g as (select p place, arg_min(pr, pr * 100000 + coalesce(datediff('day', date '1900-01-01', m), 0)) as priority, arg_min(coalesce(m, date '1900-01-01'), pr * 100000 + coalesce(datediff('day', date '1900-01-01', m), 0)) as l from r group by p) select place, priority, cast(nullif(l, date '1900-01-01') as varchar) as last from g order by priority, l, place limit 12")
def validation_priority(spark, d):
    c = T.table(spark, d, "customer")
    last = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ck")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last"))
    rows = c.join(last, F.col("c_custkey") == F.col("ck"), "left").withColumnRenamed("c_nationkey", "place")
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return schedule.priority_plan(rows, "place", rank, "last", 12).withColumn("last", F.col("last").cast("string"))


@query("select c_custkey id, cast(m as varchar) as last from customer left join (select o_custkey k, max(cast(o_orderdate as date)) m from orders where o_orderstatus = 'P' group by 1) on k = c_custkey order by m nulls first, id limit 50")
def rotation_order(spark, d):
    rows = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    kids = T.table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    out = schedule.rotation(joins.best_child(rows, kids, "id", "o_custkey", F.col("day"), F.col("day"), "last"), "id", "last")
    return out.withColumn("last", F.col("last").cast("string"))


@query("""select id, tier, case tier when 'active' then 30 when 'year_round' then 60 when 'recently_adjourned' then 1440 else 10080 end as minutes from (select o_orderkey id, case when a and e is null then 'year_round' when a then 'active' when datediff('day', e, date '1998-06-17') between 0 and 30 then 'recently_adjourned' else 'dormant' end tier
 from (select o_orderkey, o_orderstatus = 'O' a, case when o_orderpriority <> '5-LOW' then cast(o_orderdate as date) end e from orders))""")
def cadence_plan(spark, d):
    o = T.table(spark, d, "orders")
    end = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate").cast("date"))
    rows = o.select(F.col("o_orderkey").alias("id"), dates.cadence(F.col("o_orderstatus") == "O", end, F.lit("1998-06-17").cast("date")).alias("tier"))
    return rows.withColumn("minutes", dates.cadence_minutes(F.col("tier")))


@query("select l_linenumber n, cast(60 * power(2, l_linenumber - 1) as bigint) job, least(21600, cast(power(2, l_linenumber * 2) as bigint) * 60) delivery from (select distinct l_linenumber from lineitem)")
def backoff_schedule(spark, d):
    n = T.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return n.select("n", dates.job_delay(F.col("n")).alias("job"), dates.delivery_delay(F.col("n") * 2).cast("long").alias("delivery"))


@query("select user_id entity_id, epoch_us(ts) // 60000000 * 60 as begin, count(*) n, greatest(count(*) - 1, 0) refused from events group by 1, 2")
def rate_window(spark, d):
    return schedule.windows(T.change_log(spark, d), "entity_id", "changed_at", 60, 1)


@query(f"select place, best from (select jurisdiction_id place, year best, row_number() over (partition by jurisdiction_id order by year >= 2000 desc, year desc) n from (select distinct jurisdiction_id, year from {BILLS})) where n = 1")
def latest_session(spark, d):
    rows = T.bills(spark, d).select(F.col("jurisdiction_id").alias("place"), F.col("year").alias("session_id")).distinct()
    rows = rows.withColumn("active", F.col("session_id") >= 2000).withColumn("start", F.col("session_id"))
    return schedule.best_session(rows, "place").select("place", F.col("session_id").alias("best"))


@query(f"select n_name code, count(*) total, count(*) filter (status_code = 'F') part, case when count(*) > 0 then cast(count(*) filter (status_code = 'F') * 10000 // count(*) as bigint) end bp from {BILLS} join nation on n_nationkey = jurisdiction_id group by 1")
def passed_share(spark, d):
    rows = joins.with_labels(T.bills(spark, d), T.jurisdictions(spark, d), "jurisdiction_id", "jurisdiction_id", ["code"])
    out = rows.groupBy("code").agg(F.count("*").alias("total"), F.count_if(F.col("status_code") == "F").alias("part"))
    return out.withColumn("bp", F.expr("part * 10000 div nullif(total, 0)"))


