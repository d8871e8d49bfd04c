"""What readers ask for: records, votes, evidence, lists, search tiers, coverage, validation, subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.functions import digests
from lexlake.functions import strings as S
from lexlake.operators import coverage, detail, filters, joins, search, subscriptions, validation
from lexlake.sources import tables as T

from .browse import ACTIONS, BILLS
from .registry import query
from .reports import COVERAGE_SQL, covered


@query(f"select bill_id, place, part_id, cast(day as varchar) as day from {ACTIONS} where day >= date '1998-06-01' order by day, bill_id, place, part_id, sponsor_id limit 100")
def hearings_upcoming(spark, d):
    rows = T.actions(spark, d).withColumn("start", F.col("day").cast("timestamp_ntz"))
    out = detail.upcoming(rows, "start", "1998-06-01", ["bill_id", "place", "part_id", "sponsor_id"], 100)
    return out.select("bill_id", "place", "part_id", F.col("day").cast("string").alias("day"))


@query(f"""with r as (select id bill_id, jurisdiction_id, year, upper(chamber || ' ' || priority) k, case when id % 4 = 0 then 'prior-session' else 'companion' end relation from {BILLS}),
 b as (select jurisdiction_id, year, upper(chamber || ' ' || priority) k, min(id) target_id from {BILLS} where id % 3 = 0 group by all)
 select bill_id, relation, case when relation <> 'prior-session' then target_id end target_id from r left join b using (jurisdiction_id, year, k)""")
def related_at_read(spark, d):
    rows = T.bills(spark, d).withColumn("session", F.col("year"))
    ident = F.upper(F.concat_ws(" ", "chamber", "priority"))
    related = rows.select(F.col("id").alias("bill_id"), "jurisdiction_id", "session", ident.alias("k"), F.when(F.col("id") % 4 == 0, "prior-session").otherwise("companion").alias("relation"))
    return detail.related_read(related, rows.where("id % 3 = 0"), "k", "relation", ident).select("bill_id", "relation", "target_id")


@query(f"select id, status_code, status_code = 'O' and datediff('day', make_date(year, 12, 31), date '1999-06-17') > 180 enrolled_uncaptured from {BILLS}")
def bill_detail(spark, d):
    rows = T.bills(spark, d).select("id", "status_code", F.when(F.col("status_code") == "O", "enrolled").otherwise("dead").alias("status"), F.make_date("year", F.lit(12), F.lit(31)).alias("end"))
    return rows.select("id", "status_code", F.coalesce(filters.enrolled_uncaptured("status", "end", "1999-06-17"), F.lit(False)).alias("enrolled_uncaptured"))


@query(f"""with a as (select n_nationkey || '/' || p as token from nation, (select distinct o_orderpriority p from orders) union all select '99/none'),
 b as (select jurisdiction_id || '/' || priority as token, id, row_number() over (partition by jurisdiction_id, priority order by id) n, count(*) over (partition by jurisdiction_id, priority) hits from {BILLS} where cents > 40000000)
 select token, case when max(hits) is null then 'not_found' when max(hits) = 1 then 'found' else 'ambiguous_bill' end outcome, case when max(hits) = 1 then min(id) end row_id, case when max(hits) > 1 then string_agg(id, ',' order by id) filter (n <= 5) end candidates from a left join b using (token) group by token""")
def bill_record(spark, d):
    kinds = T.table(spark, d, "orders").select("o_orderpriority").distinct()
    asked = T.jurisdictions(spark, d).crossJoin(F.broadcast(kinds)).select(F.concat_ws("/", F.col("jurisdiction_id").cast("string"), "o_orderpriority").alias("token"))  # 25 places, five kinds
    asked = asked.union(spark.range(1).select(F.lit("99/none")))
    rows = T.bills(spark, d).where("cents > 40000000").withColumn("k", F.concat_ws("/", F.col("jurisdiction_id").cast("string"), "priority"))
    out = detail.record_or_candidates(asked, rows.withColumnRenamed("k", "token"), "token", "id", 5)
    return out.select("token", "outcome", "row_id", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates"))


@query("""select l_orderkey bill_id, count(*) filter (l_returnflag = 'A') yes, count(*) filter (l_returnflag = 'R') as no, count(*) filter (l_returnflag = 'N') other,
 string_agg(s_name || '=' || case l_returnflag when 'A' then 'yes' when 'R' then 'no' else 'other' end, ';' order by s_name, case l_returnflag when 'A' then 'yes' when 'R' then 'no' else 'other' end) members from lineitem join supplier on l_suppkey = s_suppkey group by 1""")
def votes_with_members(spark, d):
    flag = F.substring("kind", 1, 1)
    a = T.actions(spark, d).select("bill_id", "sponsor_id", F.when(flag == "A", "yes").when(flag == "R", "no").otherwise("other").alias("option"))
    s = T.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    out = detail.votes(a.join(s, F.col("sponsor_id") == F.col("s_suppkey")), "bill_id", "name", "option")
    return out.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat_ws("=", m["name"], m["option"])), ";"))


@query("""with a as (select l_orderkey id, l_linenumber p, l_partkey k, l_suppkey s, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) n, count(*) over (partition by l_orderkey) c from lineitem),
 x as (select id, string_agg(p || ':' || k, ',' order by n) filter (n <= 3) actions, max(c) c from a group by 1),
 v as (select id, string_agg(s, ',' order by r) filter (r <= 2) votes, max(c) c from (select l_orderkey id, l_suppkey s, row_number() over (partition by l_orderkey order by l_suppkey, l_linenumber) r, count(*) over (partition by l_orderkey) c from lineitem where l_returnflag = 'R') group by 1)
 select o_orderkey id, coalesce(actions, '') actions, coalesce(x.c, 0) actions_count, coalesce(x.c > 3, false) actions_truncated, coalesce(votes, '') votes, coalesce(v.c, 0) votes_count, coalesce(v.c > 2, false) votes_truncated
 from orders left join x on x.id = o_orderkey left join v on v.id = o_orderkey""")
def evidence_capped(spark, d):
    """True counts decide what is truncated."""
    a = T.actions(spark, d).withColumnRenamed("bill_id", "id")
    kinds = {"actions": (a, ["place", "part_id", "sponsor_id"], ["place", "part_id"]), "votes": (a.where("kind like 'R%'"), ["sponsor_id", "place"], ["sponsor_id"])}
    out = detail.evidence_packet(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", kinds, {"actions": 3, "votes": 2})
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit("")).alias(c)
    return out.select("id", text("actions", lambda x: F.concat_ws(":", x["place"].cast("string"), x["part_id"].cast("string"))), "actions_count", "actions_truncated", text("votes", lambda x: x["sponsor_id"].cast("string")), "votes_count", "votes_truncated")


@query("select s_suppkey id, s_name as name, s_nationkey place from supplier order by s_name, s_suppkey limit 20 offset 2")
def people_list(spark, d):
    rows = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("place"))
    return detail.listing(rows, ["name", "id"], 2, 20, place=None)


@query("select s_suppkey id, s_name as name from supplier where s_suppkey = 3")
def person_detail(spark, d):
    rows = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return detail.listing(rows, ["id"], 0, 1, id=3)


@query("select id, p priority, s snippet from (select id, p, s, row_number() over (partition by id order by p, s) n from (select p_partkey id, 0 p, p_name s from part where p_name ilike '%blue%' union all select p_partkey, 1, p_type from part where p_size < 20)) where n = 1")
def snippet_by_priority(spark, d):
    p = T.table(spark, d, "part")
    titles = p.where(F.col("p_name").ilike("%blue%")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("snippet"))
    return detail.first_by_priority([titles, p.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("snippet"))], "id")


@query("select p_partkey id, replace(p_name, 'blue', '[blue]') marked from part")
def highlight_segments(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit("blue"), F.lit("⟦H⟧blue⟦/H⟧")).alias("h"))
    text = F.transform(search.segments("h"), lambda s: F.when(s["marked"], F.concat(F.lit("["), s["text"], F.lit("]"))).otherwise(s["text"]))
    return rows.select("id", F.array_join(text, "").alias("marked"))


NUMBER_SQL = "select o_orderkey id, count(*) over () total from orders where upper(regexp_replace(case when o_orderstatus = 'O' then 'hb' else 'SB ' end || ' ' || (o_orderkey % 100), '[^A-Za-z0-9]', '', 'g')) = 'HB42'"


@query(NUMBER_SQL)
def number_search(spark, d):
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderstatus") == "O", "hb").otherwise("SB "), F.lit(" "), (F.col("o_orderkey") % 100).cast("string")).alias("number"))
    found = search.number_lookup(rows, F.col("number"), "H.B. 42", lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))).select("id")
    return found.join(F.broadcast(found.agg(F.count("*").alias("total"))), F.lit(True))  # one row


@query("select 'fulltext' tier, 'blue' q, * from (select p_partkey id from part where list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'blue')) union all select 'number', '#7', 7 where exists (select 1 from part where p_partkey = 7) union all select 'browse', '', * from (select p_partkey from part order by p_retailprice desc, p_partkey limit 10)")
def search_tiers(spark, d):
    """Three requests, each answered by the first tier that has rows."""
    p, out = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_retailprice"), None
    for q in ("blue", "#7", ""):
        number = p.where(F.concat(F.lit("#"), F.col("id").cast("string")) == q)
        words = p.where(F.array_contains(F.split(F.lower("p_name"), "[^a-z0-9]+"), q or " "))
        browse = p.orderBy(F.desc("p_retailprice"), "id").limit(10)
        rows = search.tiered([("number", number), ("fulltext", words), ("browse", browse)]).select("tier", F.lit(q).alias("q"), "id")
        out = rows if out is None else out.union(rows)
    return out


@query("with m as (select p_partkey id, p_name, p_brand from part where p_name ilike '%blue%'), f as (select *, row_number() over (order by id) n from m), k as (select * from f where n <= 50) select id, (select count(*) from m) > 50 truncated, (select count(*) from m) > 50 or (select count(distinct p_brand) from f where n <= 51) > 1 ambiguous from k")
def candidates_capped(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand").where(F.col("p_name").ilike("%blue%"))
    return search.capped_candidates(rows, "id", [F.length("p_name")], 50, "p_brand").select("id", "truncated", "ambiguous")


@query("select p_brand brand, sort, case when count(*) > 20 then case when sort = 'introduced' then 'More than 20 records match; these are the newest.' else 'More than 20 records match; only the first 20 were ranked.' end end notice from part, (values ('introduced'), ('relevance')) v(sort) group by p_brand, sort")
def saturation_notices(spark, d):
    counts = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    rows = counts.select("brand", "n", F.explode(F.array(F.lit("introduced"), F.lit("relevance"))).alias("sort"))
    return rows.select("brand", "sort", search.saturation_notice(F.col("n") > 20, F.col("sort"), 20).alias("notice"))


@query("with t as (select o_orderkey id, o_custkey c, row_number() over (order by o_totalprice desc, o_orderkey) place from orders qualify place <= 200) select place, id, c_mktsegment segment from t left join customer on c = c_custkey")
def page_order_kept(spark, d):
    """Places are numbered on the page of 200, so that the join may lose its order."""
    from pyspark.sql.window import Window

    page = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "id").limit(200)
    page = page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "id")).cast("long"))
    return joins.with_labels(page, T.table(spark, d, "customer"), "o_custkey", "c_custkey", ["c_mktsegment"]).select("place", "id", F.col("c_mktsegment").alias("segment"))


@query("select o_orderkey id from orders where o_orderkey > 1000 order by id limit 500")
def key_chunk(spark, d):
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).where("id > 1000").orderBy("id").limit(500)


@query("select count(*) total, count(distinct c_nationkey) places, count(*) filter (c_mktsegment = 'BUILDING') green, count(*) filter (c_mktsegment in ('MACHINERY', 'FURNITURE')) open, count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY', 'FURNITURE')) other, (select cast(max(cast(o_orderdate as date)) as varchar) from orders) last_update from customer")
def site_totals(spark, d):
    m = F.col("c_mktsegment")
    totals = T.table(spark, d, "customer").agg(
        F.count("*").alias("total"), F.count_distinct("c_nationkey").alias("places"), F.count_if(m == "BUILDING").alias("green"), F.count_if(m.isin("MACHINERY", "FURNITURE")).alias("open"),
        F.count_if(~m.isin("BUILDING", "MACHINERY", "FURNITURE")).alias("other"),
    )
    return totals.join(F.broadcast(T.table(spark, d, "orders").agg(F.max(F.col("o_orderdate").cast("date")).cast("string").alias("last_update"))), F.lit(True))  # one row each


@query(f"select source, bills, with_text, available, with_text * 10000 // nullif(bills, 0) text_bp, available * 10000 // nullif(bills, 0) available_bp, array_to_string(list_filter([case when bills = 0 then 'no_bills' end, case when bills > 0 and with_text = 0 then 'no_text' end, case when with_text < available then 'text_incomplete' end], lambda x: x is not null), ',') gaps from {COVERAGE_SQL}")
def coverage_report(spark, d):
    return coverage.report(covered(spark, d))


@query("select c_custkey id, 'coverage_below_threshold' code, case c_mktsegment when 'BUILDING' then 1 when 'FURNITURE' then 3 else 0 end severity, c_custkey || ' is ' || case c_mktsegment when 'BUILDING' then 'NOT_STARTED' when 'FURNITURE' then 'BOOTSTRAPPED' when 'HOUSEHOLD' then 'unknown' else 'ODD' end || ', not yet METADATA_SEARCHABLE' message from customer where c_mktsegment <> 'MACHINERY'")
def coverage_warnings(spark, d):
    m = F.col("c_mktsegment")
    status = F.when(m == "MACHINERY", "GREEN").when(m == "BUILDING", "NOT_STARTED").when(m == "FURNITURE", "BOOTSTRAPPED").when(m != "HOUSEHOLD", "ODD")
    rows = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), status.alias("status"))
    out = coverage.warnings(rows.withColumn("id", F.col("id").cast("string")), "id", "status", "METADATA_SEARCHABLE")
    return out.withColumn("id", F.col("id").cast("bigint")).withColumn("severity", F.col("severity").cast("int"))


@query(f"select source, '{{\"bills\":' || bills || ',\"with_text\":' || with_text || '}}' as row from {COVERAGE_SQL}")
def coverage_rows_json(spark, d):
    return coverage.serialised(covered(spark, d), "source", ["bills", "with_text"])


@query("select o_orderkey id from orders order by md5('7|' || o_orderkey), o_orderkey limit 100")
def random_sample(spark, d):
    return validation.sampled(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 100, 7)


STRUCT_SQL = "(select o_orderkey id, array_to_string(list_filter([case when o_orderkey % 9 = 0 then 'title' end, case when not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 'children' end], lambda x: x is not null), ',') missing from orders)"


def structural(spark, d):
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"))
    return validation.structural_leg(rows, "id", ["title"], T.actions(spark, d).where("kind like 'R%'"), "bill_id")


@query(f"select id, missing, case when missing = '' then 'pass' else 'fail' end outcome from {STRUCT_SQL}")
def structural_leg(spark, d):
    return structural(spark, d)


@query(f"""with l as (select id, 'structural' leg, case when missing = '' then 'pass' else 'fail' end outcome from {STRUCT_SQL} union all
 select o_orderkey, 'search', case when o_orderkey % 4 = 0 then 'unverifiable' when o_orderstatus = 'O' then 'pass' else 'fail' end from orders union all select o_orderkey, 'keyword', 'fail' from orders)
 select id, case when count(*) filter (outcome = 'fail' and leg <> 'keyword') > 0 then 'fail' when count(*) filter (outcome = 'pass' and leg <> 'keyword') > 0 then 'pass' else 'unverifiable' end verdict from l group by id""")
def validation_verdicts(spark, d):
    """The keyword leg is advisory; the search leg doesn't reach a quarter of the records."""
    orders = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    reached = validation.result_leg(orders.where("id % 4 <> 0"), "id", orders.where("o_orderstatus = 'O'"), "id")
    legs = validation.recorded(orders, "id", {"structural": structural(spark, d), "search": reached, "keyword": orders.select("id", F.lit("fail").alias("outcome"))})
    return validation.verdicts(legs, "id", ["keyword"])


@query("""with r as (select user_id, event_type, arg_max(case when cast(value as bigint) % 3 = 0 then 'unsubscribe' else 'subscribe' end, event_id) ask from events group by all), s as (select distinct user_id, event_type, user_id % 2 = 0 active from events where user_id % 3 = 0)
 select user_id entity_id, event_type kind, case when ask = 'subscribe' and active is null then 'created' when ask = 'subscribe' and not active then 'reactivated' when ask <> 'subscribe' and active then 'ended' else 'unchanged' end outcome, ask = 'subscribe' active from r left join s using (user_id, event_type)""")
def subscriptions_asked(spark, d):
    log = T.change_log(spark, d)
    # a double rounds half to even where the SQL casts
    asks = log.select("entity_id", "kind", "seq", F.when(F.bround("value", 0).cast("bigint") % 3 == 0, "unsubscribe").otherwise("subscribe").alias("ask"))
    stored = log.where("entity_id % 3 = 0").select("entity_id", "kind", (F.col("entity_id") % 2 == 0).alias("active")).distinct()
    return subscriptions.subscribed(asks, stored, ["entity_id", "kind"])


@query("select id, notice from (select c_custkey id, case when c_custkey % 5 = 0 then 'ended' else 'confirmed' end notice from customer) where not (id % 2 = 0 and notice = 'confirmed')")
def notices_left(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    pending = c.select("id", F.when(F.col("id") % 5 == 0, "ended").otherwise("confirmed").alias("notice"))
    return subscriptions.drained_notices(pending, c.where("id % 2 = 0").select("id", F.lit("confirmed").alias("notice")), "id")


@query("""with s as (select user_id subscription_id, max(event_id) last_seq from events where event_type = 'click' group by 1),
 a as (select user_id subscription_id, string_agg(event_type, ',' order by event_id desc) recent from (select *, row_number() over (partition by user_id order by event_id desc) n from events) where n <= 10 group by 1)
 select subscription_id, last_seq, greatest(0, (select max(event_id) from events) - 5 - last_seq) cursor_lag_seq, recent from s left join a using (subscription_id)""")
def hook_status(spark, d):
    log = T.change_log(spark, d)
    subs = log.where("kind = 'click'").groupBy(F.col("entity_id").alias("subscription_id")).agg(F.max("seq").alias("last_seq"))
    subs = subs.join(F.broadcast(log.agg((F.max("seq") - 5).alias("w"))), F.lit(True))  # the watermark is one row
    attempts = log.select(F.col("entity_id").alias("subscription_id"), "seq", F.col("kind").alias("outcome"))
    return subscriptions.hook_status(subs, attempts, F.col("w")).select("subscription_id", "last_seq", "cursor_lag_seq", F.array_join("recent", ",").alias("recent"))


@query("select c_custkey id, case when c_custkey % 2 = 0 then greatest(c_custkey, 500) else c_custkey end last_seq from customer")
def cursor_reactivated(spark, d):
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), subscriptions.reactivated(F.col("c_custkey"), F.lit(500), F.col("c_custkey") % 2 == 0).cast("bigint").alias("last_seq"))


@query("select event_id seq from events where ts >= timestamp '2024-01-20' - case when event_type = 'click' then interval 48 hour else interval 720 hour end")
def deliveries_kept(spark, d):
    rows = T.change_log(spark, d).select("seq", F.col("changed_at").alias("at"), F.when(F.col("kind") == "click", "created").otherwise(F.col("kind")).alias("kind"))
    return subscriptions.pruned(rows, "2024-01-20").select("seq")


@query("""with p as (select event_type k, event_id "at", user_id % 4 <> 0 ok from events), t as (select *, sum(ok::int) over (partition by k order by "at") turn from p), f as (select *, sum(1 - ok::int) over (partition by k, turn order by "at") fails from t),
 b as (select *, lag(fails) over (partition by k order by "at") before from f) select k, "at", case when not ok then 'down' else 'up' end alarm from b where (not ok and fails = 2) or (ok and before >= 2)""")
def stall_alarms(spark, d):
    """Probes a microsecond apart; no failure lasts six hours, so none is repeated."""
    rows = T.change_log(spark, d).select(F.col("kind").alias("k"), F.timestamp_micros("seq").alias("at"), (F.col("entity_id") % 4 != 0).alias("ok"))
    return subscriptions.alarms(rows, "k").select("k", F.unix_micros("at").alias("at"), "alarm")


@query("select n_name code from nation where n_nationkey not in (select s_nationkey from supplier where s_suppkey % 3 = 0)")
def hub_unresolved(spark, d):
    found = T.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey")
    return T.jurisdictions(spark, d).join(found, F.col("jurisdiction_id") == F.col("s_nationkey"), "left_anti").select("code")


@query("select p_partkey id, case p_size % 4 when 0 then 'House Bill ' || p_size when 1 then 'Senate Joint Resolution ' || p_size end spelled, case when p_size % 4 = 2 then p_brand end noted, 'https://x.test/bills/' || p_partkey url, case p_size % 4 when 0 then 'example.org' when 1 then 'council.gov.uk' end as domain, split_part(p_name, ' ', 1) hint from part")
def labels_and_links(spark, d):
    k = F.col("p_size") % 4
    number = F.concat(F.when(k == 0, " hb ").when(k == 1, "SJR-").otherwise("QQ "), F.col("p_size").cast("string"))
    note = F.when(k == 2, F.concat(F.lit("seen; "), S.status_note(F.col("p_brand")), F.lit("; x"))).otherwise("nothing")
    host = F.when(k == 0, "www.Example.org").when(k == 1, "a.b.council.gov.uk").when(k == 2, "10.0.0.1").otherwise("localhost")
    return T.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), S.spelled_out(number).alias("spelled"), S.noted_status(note).alias("noted"), S.search_url("https://x.test/", "bills", F.col("p_partkey")).alias("url"),
        S.registrable_domain(host).alias("domain"), S.topic_hint(F.array(F.concat(F.lit("%"), F.split("p_name", " ")[0], F.lit("%")), F.lit("%x%"))).alias("hint"),
    )


@query("select event_id seq, case when epoch_us(ts) > epoch_us(timestamp '2024-01-10') then 0 else (epoch_us(timestamp '2024-01-10') - epoch_us(ts)) // 1000000 end lag_seconds, '{\"kind\":\"' || event_type || '\",\"entity\":' || user_id || '}' payload from events")
def job_payloads(spark, d):
    now = F.lit("2024-01-10").cast("timestamp")
    lag = F.greatest(F.lit(0), (F.unix_micros(now) - F.unix_micros(F.col("changed_at").cast("timestamp"))))
    payload = F.to_json(F.struct("kind", F.col("entity_id").alias("entity")))
    return T.change_log(spark, d).select("seq", F.expr("0L").alias("z"), lag.alias("l"), payload.alias("payload")).select("seq", F.expr("l div 1000000").alias("lag_seconds"), "payload")


@query("select o_orderkey id, '{\"leg\":\"search\",\"result\":{\"outcome\":\"' || case when o_orderstatus = 'O' then 'pass' else 'fail' end || '\",\"hits\":' || (o_orderkey % 5) || '}}' details from orders")
def validation_details(spark, d):
    o = T.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), validation.details(F.lit("search"), F.when(F.col("o_orderstatus") == "O", "pass").otherwise("fail"), hits=F.col("o_orderkey") % 5).alias("details"))


#: Texts of pages that name records in several ways, and numbers that only look like theirs.
PAGE_SQL = """(select p_partkey page, case p_partkey % 8 when 0 then 'See H.B. ' || n || ', as read' when 1 then 'on SB26-0' || n || '.' when 2 then 'The House Joint  Resolution ' || n when 3 then 'shb ' || n || ' graph' || n
 when 4 then 'S*0' || n when 5 then 'sb 9' || n || ', hb ' || n || '7' when 6 then 'h' || n || 'x HJR00' || n else p_name end text from (select p_partkey, p_name, p_partkey % 400 + 100 n from part))"""


@query(f"""with r as (select distinct case o_orderstatus when 'O' then 'hb' when 'F' then 'sb' else 'hjr' end p, o_orderkey % 500 n from orders), t as (select page, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) || ' ' x from {PAGE_SQL})
 select page, upper(p) || ' ' || n record from t join r on x like '%' || n || '%'
 where n >= 100 and regexp_matches(x, '[^a-z0-9]((' || p || '|' || p[1] || ') ?0?|' || p || '[0-9][0-9]0*|' || case p when 'hb' then 'house bill' when 'sb' then 'senate bill' else 'house joint resolution' end || ' )' || n || '[^0-9]')""")
def surface_mentions(spark, d):
    """Which pages name which records in any surface form; numbers of three digits, so that the SQL's pattern is all of them."""
    n, k = (F.col("p_partkey") % 400 + 100).cast("string"), F.col("p_partkey") % 8
    text = F.when(k == 0, F.concat(F.lit("See H.B. "), n, F.lit(", as read"))).when(k == 1, F.concat(F.lit("on SB26-0"), n, F.lit("."))).when(k == 2, F.concat(F.lit("The House Joint  Resolution "), n)).when(k == 3, F.concat(F.lit("shb "), n, F.lit(" graph"), n))
    text = text.when(k == 4, F.concat(F.lit("S*0"), n)).when(k == 5, F.concat(F.lit("sb 9"), n, F.lit(", hb "), n, F.lit("7"))).when(k == 6, F.concat(F.lit("h"), n, F.lit("x HJR00"), n)).otherwise(F.col("p_name"))
    pages = T.table(spark, d, "part").select(F.col("p_partkey").alias("page"), text.alias("text"))
    o = T.table(spark, d, "orders")
    named = F.concat(F.when(F.col("o_orderstatus") == "O", "HB ").when(F.col("o_orderstatus") == "F", "SB ").otherwise("HJR "), (F.col("o_orderkey") % 500).cast("string"))
    records = o.where("o_orderkey % 500 >= 100").select(named.alias("record")).distinct()
    return validation.mentions(pages, "page", "text", records, "record", "record").select("page", F.col("key").alias("record"))
