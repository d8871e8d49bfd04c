"""Filters, joins, lookups and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.functions import strings as S
from lexlake.operators import filters, joins, paging
from lexlake.sources import tables as T

from .registry import query

BILLS = "(select o_orderkey id, c_nationkey jurisdiction_id, c_mktsegment chamber, o_orderstatus status_code, cast(o_orderdate as date) as day, year(o_orderdate) as year, o_orderpriority priority, cast(round(o_totalprice * 100) as bigint) cents from orders join customer on o_custkey = c_custkey)"
ACTIONS = "(select l_orderkey bill_id, cast(l_shipdate as date) as day, l_linenumber place, l_partkey part_id, l_suppkey sponsor_id, l_returnflag || l_linestatus kind, cast(l_quantity as bigint) quantity, cast(round(l_extendedprice * 100) as bigint) cents from lineitem)"


@query(f"select b.id, n_name code, chamber, status_code, cast(day as varchar) as day, cents from {BILLS} b join nation on n_nationkey = jurisdiction_id where n_name = 'NATION_7' and status_code = 'O' and day >= date '1995-01-01' order by b.day desc nulls last, id limit 5 offset 5")
def browse_filtered_page(spark, d):
    rows = joins.with_labels(T.bills(spark, d), T.jurisdictions(spark, d), "jurisdiction_id", "jurisdiction_id", ["code"])
    rows = filters.structured(rows, code="nation_7".upper(), status_code="O", since="1995-01-01")
    out = paging.page(rows, paging.order_by("introduced"), 2, 5)
    return out.select("id", "code", "chamber", "status_code", F.col("day").cast("string").alias("day"), "cents")


@query("select count(*) n from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '1997-01-01'")
def list_count_conditional_join(spark, d):
    """The dimension isn't joined, since no filter needs it."""
    rows = T.table(spark, d, "orders").select("o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    return filters.structured(rows, o_orderstatus="O", since="1997-01-01").agg(F.count("*").alias("n"))


@query(f"select id, status_code from {BILLS} where exists (select 1 from lineitem join supplier on l_suppkey = s_suppkey where l_orderkey = id and lower(s_name) like '%0000007%')")
def semi_sponsor_like(spark, d):
    return filters.having_child(T.bills(spark, d, of_customer=False), T.sponsors(spark, d), F.lower("name").like("%0000007%")).select("id", "status_code")


@query(f"select id, chamber from {BILLS} where exists (select 1 from lineitem join part on l_partkey = p_partkey where l_orderkey = id and lower(p_type) = 'economy')")
def semi_subject_eq(spark, d):
    return filters.having_child(T.bills(spark, d), T.subjects(spark, d), filters.same_folded("subject", " Economy ")).select("id", "chamber")


@query(f"select id, chamber from {BILLS} where exists (select 1 from lineitem join part on l_partkey = p_partkey where l_orderkey = id and p_type ilike '%and%')")
def semi_subject_like(spark, d):
    return filters.having_child(T.bills(spark, d), T.subjects(spark, d), filters.contains("subject", "and")).select("id", "chamber")


@query(f"select id from {BILLS} where exists (select 1 from lineitem join supplier on l_suppkey = s_suppkey join nation on n_nationkey = s_nationkey where l_orderkey = id and n_name ilike '%ion_1%')")
def committee_exists_chain(spark, d):
    people = joins.with_labels(T.sponsors(spark, d), T.jurisdictions(spark, d), "home_id", "jurisdiction_id", ["code"])
    return filters.having_child(T.bills(spark, d, of_customer=False), people, filters.contains("code", "ion_1")).select("id")


@query("select o_orderkey id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def anti_unqueued(spark, d):
    bills = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return filters.without_child(bills, T.actions(spark, d), F.substring("kind", 1, 1) == "R")


@query("select o_orderkey id, nullif(o_orderpriority, '3-MEDIUM') note from orders where nullif(o_orderpriority, '3-MEDIUM') is null or nullif(o_orderpriority, '3-MEDIUM') not in ('1-URGENT', '2-HIGH')")
def not_in_null_guard(spark, d):
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("note"))
    return rows.where(filters.not_in_or_null("note", ["1-URGENT", "2-HIGH"]))


@query("select event_id seq, nullif(event_type, 'view') kind from events where nullif(event_type, 'view') is distinct from 'click'")
def distinct_from_filter(spark, d):
    rows = T.change_log(spark, d).select("seq", F.nullif("kind", F.lit("view")).alias("kind"))
    return rows.where(filters.distinct_from("kind", "click"))


@query(f"select id, n_name code, r_name region from {BILLS} left join nation on n_nationkey = jurisdiction_id and n_nationkey <> 3 left join region on r_regionkey = n_regionkey")
def labels_left(spark, d):
    places = T.jurisdictions(spark, d).where("jurisdiction_id <> 3")
    rows = joins.with_labels(T.bills(spark, d), places, "jurisdiction_id", "jurisdiction_id", ["code", "region_id"])
    return joins.with_labels(rows, T.table(spark, d, "region"), "region_id", "r_regionkey", ["r_name"]).select("id", "code", F.col("r_name").alias("region"))


@query(f"""with t as (select upper(n_name) || '-' || y as token from nation, (values ('1995'), ('1999'), ('2030')) v(y)),
 b as (select id, upper(n_name) || '-' || year as k, chamber from {BILLS} join nation on n_nationkey = jurisdiction_id where status_code = 'P' and cents > 30000000),
 h as (select k, count(*) hits, min(id) row_id, string_agg(distinct chamber, ',' order by chamber) sessions from b group by k)
 select token, case when hits is null then 'not_found' when hits = 1 then 'found' else 'ambiguous' end outcome, case when hits = 1 then row_id end row_id, case when hits > 1 then sessions end sessions from t left join h on k = token""")
def batch_lookup_ambiguity(spark, d):
    places = T.jurisdictions(spark, d)
    asked = places.select(F.explode(F.array(*map(F.lit, ("1995", "1999", "2030")))).alias("y"), "code").select(F.concat_ws("-", F.upper("code"), "y").alias("token"))
    rows = joins.with_labels(T.bills(spark, d).where("status_code = 'P' and cents > 30000000"), places, "jurisdiction_id", "jurisdiction_id", ["code"])
    rows = rows.withColumn("k", F.concat_ws("-", F.upper("code"), F.col("year").cast("string")))
    return joins.lookup(asked, rows, "token", "k", "chamber", "id")


@query(f"""with b as (select id, jurisdiction_id, year, chamber, priority from {BILLS}), k as (select jurisdiction_id, year, upper(chamber || ' ' || priority) ident, min(id) found from b group by all)
 select id bill_id, case when b.id % 3 = 0 then id when b.id % 3 = 1 and found <> id then found end target_id from b left join k on k.jurisdiction_id = b.jurisdiction_id and k.year = b.year and ident = upper(b.chamber || ' ' || b.priority)""")
def companion_self_join(spark, d):
    ident = S.companion_number(F.concat_ws("  ", "chamber", "priority"))
    rows = T.bills(spark, d).withColumn("session", F.col("year"))
    related = rows.select(
        F.col("id").alias("bill_id"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("target_id"), ident.alias("identifier"), F.when(F.col("id") % 3 == 2, "prior").otherwise("companion").alias("relation"), "jurisdiction_id", "session"
    )
    return joins.companions(related, rows, ident).select("bill_id", "target_id")


@query("select o_orderkey id, cast(m as varchar) as latest from orders left join (select l_orderkey k, max(cast(l_shipdate as date)) m from lineitem where l_returnflag = 'A' group by 1) on k = o_orderkey")
def lateral_latest_child(spark, d):
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    kids = T.actions(spark, d).where(F.col("kind").startswith("A"))
    return joins.best_child(rows, kids, "id", "bill_id", F.col("day").cast("string"), F.col("day"), "latest")


@query(f"select b.id, case when c.k is null then 0 else 1 end covered from {BILLS} b left join (select distinct l_orderkey k from lineitem where l_quantity > 45) c on c.k = b.id")
def left_mark(spark, d):
    covered = T.actions(spark, d).where("quantity > 45").select("bill_id")
    return joins.marked(T.bills(spark, d).select("id"), covered, "id", "covered")


@query(f"select id, (row_number() over (order by id) - 1) // 1000 chunk from {BILLS}")
def sitemap_chunks(spark, d):
    return paging.chunks(T.bills(spark, d), "id", 1000)


@query("select o_orderkey id, cast(least(count(*) over (), 100) as bigint) as n, true saturated from orders where o_orderpriority = '1-URGENT' order by id limit 100")
def capped_probe(spark, d):
    rows = T.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    out = paging.capped(rows, [F.asc("id")], 100)
    return out.select("id", F.lit(100).cast("long").alias("n"), "saturated")


@query(f"""with c as (select l_orderkey k, string_agg(l_linenumber || ':' || cast(cast(l_shipdate as date) as varchar) || ':' || l_partkey, ',' order by l_linenumber, cast(l_shipdate as date), l_partkey) lines from lineitem group by 1)
 select id, coalesce(lines, '') as lines from {BILLS} left join c on k = id where jurisdiction_id = 7""")
def eager_children(spark, d):
    bills = T.bills(spark, d).where("jurisdiction_id = 7").select("id")
    rows = joins.with_children(bills, "id", {"kids": (T.actions(spark, d), "bill_id", ["place", "day", "part_id"], [])})
    text = F.transform("kids", lambda k: F.concat_ws(":", k["place"].cast("string"), k["day"].cast("string"), k["part_id"].cast("string")))
    return rows.select("id", F.array_join(text, ",").alias("lines"))


@query("""with s as (select distinct n_nationkey place, year(o_orderdate) y from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
 a as (select n_nationkey place, n_nationkey || '-' || yy || '-regular' slug, yy from nation, (values (1995), (2040)) v(yy))
 select slug, case when count(y) = 1 then min(y) end session_id from a left join s on s.place = a.place and y = yy group by slug""")
def fuzzy_session(spark, d):
    sessions = T.bills(spark, d).select(F.col("jurisdiction_id").alias("place"), "year").distinct()
    sessions = sessions.select("place", F.lit("regular").alias("class"), F.array(F.col("year").cast("string")).alias("years"), F.array().cast("array<string>").alias("ordinals"), F.col("year").alias("session_id"))
    slugs = T.jurisdictions(spark, d).select(F.col("jurisdiction_id").alias("place"), F.explode(F.array(F.lit(1995), F.lit(2040))).alias("y"))
    slugs = slugs.withColumn("slug", F.concat_ws("-", F.col("place").cast("string"), F.col("y").cast("string"), F.lit("regular")))
    slugs = slugs.select("place", "slug", S.session_class("slug").alias("class"), S.years("slug").alias("years"), F.array().cast("array<string>").alias("ordinals"))
    return joins.unique_session(slugs, sessions)


@query("with t as (select p_partkey as place, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as token from part) select min(place) as place, arg_min(token, place) as token from t group by lower(token)")
def token_dedup(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("place"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("token"))
    return joins.first_tokens(rows, "place", "token")


@query("select s_suppkey id, s_nationkey place from supplier where s_nationkey in (select n_nationkey from nation where n_name ilike 'nation_1%' or n_name ilike 'nation_7')")
def find_jurisdiction(spark, d):
    places = T.jurisdictions(spark, d).where(F.col("code").ilike("nation_1%") | F.col("code").ilike("nation_7"))
    people = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("place"))
    return filters.having_child(people, places, F.lit(True), "place", "jurisdiction_id")


@query("select event_id seq, event_type kind from events where json_extract_string(props, '$.k') = '7' and event_type in ('click', 'view')")
def json_field_filter(spark, d):
    return T.change_log(spark, d).where(filters.json_field("detail", "k", "7") & filters.kinds("kind", "click, view")).select("seq", "kind")
