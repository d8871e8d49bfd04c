"""Records: checksums, upserts, timelines, evidence and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.functions import dates, digests
from lexlake.functions import strings as S
from lexlake.operators import joins, records
from lexlake.sources import tables as T

from .browse import ACTIONS, BILLS
from .registry import query


@query("""select id, case when old is null then 'created' when old = new then 'unchanged' else 'updated' end outcome from
 (select o_orderkey id, sha256(o_orderkey || '|' || case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end || '|' || o_orderpriority) as new, case when o_orderkey % 11 <> 0 then sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) end as old from orders)""")
def checksum_upsert(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    stored = o.where("id % 11 <> 0").withColumn("checksum", digests.checksum("id", "status", "priority"))
    incoming = o.withColumn("status", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("status"))).withColumn("checksum", digests.checksum("id", "status", "priority"))
    return joins.changes(incoming, stored, "id", "checksum").select("id", "outcome")


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'NEW' else o_orderstatus end status from orders where o_orderkey % 3 = 0 or o_orderkey % 5 = 0")
def upsert_snapshot(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return joins.upsert(o.where("id % 3 = 0").withColumn("status", F.lit("NEW")), o.where("id % 5 = 0"), "id")


@query(f"""select bill_id, cast(day as varchar) as day, source, ordinal, what from (
 select bill_id, day, 'action' source, place ordinal, kind || ':' || part_id || ':' || cents what from {ACTIONS} union all
 select id, day, 'filing', 0, status_code from {BILLS} union all
 select event_id, cast(ts as date), 'event', user_id, event_type from events where event_type <> 'view')""")
def timeline_union(spark, d):
    a = T.actions(spark, d).select("bill_id", "day", F.col("place").alias("ordinal"), F.concat_ws(":", "kind", F.col("part_id").cast("string"), F.col("cents").cast("string")).alias("what"))
    b = T.bills(spark, d).select(F.col("id").alias("bill_id"), "day", F.lit(0).alias("ordinal"), F.col("status_code").alias("what"))
    e = T.change_log(spark, d).select(F.col("seq").alias("bill_id"), F.when(F.col("kind") != "view", F.col("changed_at").cast("date")).alias("day"), F.col("entity_id").alias("ordinal"), F.col("kind").alias("what"))
    return records.timeline({"action": a, "filing": b, "event": e}).select("bill_id", F.col("day").cast("string").alias("day"), "source", "ordinal", "what")


@query(f"""with a as (select l_orderkey k, string_agg(l_partkey, ',' order by l_partkey) actions from lineitem group by 1),
 c as (select id, 'id=' || id || ';code=' || coalesce(n_name, '') || ';status_code=' || status_code || ';actions=' || coalesce(actions, '') canonical from {BILLS} left join nation on n_nationkey = jurisdiction_id left join a on k = id)
 select id, canonical, 'bcs1_' || substr(sha256(canonical), 1, 16) as snapshot from c""")
def evidence_digest(spark, d):
    rows = joins.with_labels(T.bills(spark, d), T.jurisdictions(spark, d), "jurisdiction_id", "jurisdiction_id", ["code"])
    return records.evidence(rows, "id", ["code", "status_code"], {"actions": (T.actions(spark, d), "part_id")})


@query(f"""select id, n_name || ' ' || upper(substr(chamber, 1, 2)) || ' ' || id || ', session ' || year || ', "' || priority || '", ' || case when status_code = 'P' then 'status: not determined' else 'status (derived): ' || status_code end || ', snapshot s' cite from {BILLS} join nation on n_nationkey = jurisdiction_id""")
def citations(spark, d):
    rows = joins.with_labels(T.bills(spark, d), T.jurisdictions(spark, d), "jurisdiction_id", "jurisdiction_id", ["code"])
    rows = rows.select("id", F.concat_ws(" ", F.upper(F.substring("chamber", 1, 2)), F.col("id").cast("string")).alias("number"), "code", F.col("year").cast("string").alias("session"), "priority", F.when(F.col("status_code") != "P", F.col("status_code")).alias("status"), F.lit("s").alias("snapshot"))
    return rows.select("id", S.citation("number", "code", "session", "priority", "status", "snapshot").alias("cite"))


@query("select o_orderkey id, 'W/\"' || substr(sha256(o_orderkey || ':' || cast(cast(o_orderdate as date) as varchar)), 1, 32) || '\"' tag from orders")
def weak_tags(spark, d):
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("changed"))
    return rows.select("id", digests.weak_tag("id", "changed").alias("tag"))


@query("select o_orderkey id, cast(case when cast(o_orderdate as date) is null then null when o_orderkey % 4 = 3 then null else cast(o_orderdate as date) end as varchar) as day, cast(year(o_orderdate) - (year(o_orderdate) + 1) % 2 as bigint) biennium from orders")
def lenient_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    texts = F.when(F.col("o_orderkey") % 4 == 0, day.cast("string")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "MM/dd/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "yyyyMMdd")).otherwise("no date")
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), texts.alias("x"), day.alias("d"))
    return rows.select("id", dates.lenient_date("x").cast("string").alias("day"), dates.session_year(F.col("d")).cast("long").alias("biennium"))


@query()
def version_diff(spark, d):
    out = records.diffs(T.table(spark, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "from", "to", F.size(F.filter("lines", lambda x: x["type"] == "add")).alias("added"), F.size(F.filter("lines", lambda x: x["type"] == "remove")).alias("removed"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("diff"))


@query("select doc_id, yes, no, case when note is null then '' else note || ': ' end || 'Motion' || ' -- ' || yes || '-' || no detail from (select doc_id, n_chars % 50 yes, n_chars % 7 as no, case when doc_id % 2 = 0 then source end note from documents)")
def vote_details(spark, d):
    rows = T.table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 50).alias("yes"), (F.col("n_chars") % 7).alias("no"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("note"), F.lit(" Motion ").alias("motion"), F.lit(" ").alias("result"))
    return rows.select("doc_id", "yes", "no", S.vote_detail("note", "motion", "result", "yes", "no").alias("detail"))
