"""The change log's queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators import feed, joins, paging, scopes
from lexlake.sources import tables as T

from .registry import query

NOW = "2024-01-30 00:00:00"
VISIBLE = f"(select event_id seq, ts, user_id, event_type kind, value, props from events where ts <= timestamp '{NOW}' - interval 240 seconds)"


@query(f"select seq, kind, user_id entity_id from {VISIBLE} where seq > 500 and kind in ('click', 'view') order by seq limit 101")
def feed_page(spark, d):
    return feed.page(T.change_log(spark, d), 500, 100, NOW, ["click", "view"]).select("seq", "kind", "entity_id")


@query(f"with w as (select coalesce(max(seq), 0) m from {VISIBLE}), s as (select user_id u, count(*) % 4 * 1000 c from events group by 1) select u % 1000000 subscription, seq from s join events_ e on e.user_id = u and e.seq > c, w where seq <= m and e.kind <> 'error'".replace("events_", "(select event_id seq, user_id, event_type kind from events)"))
def feed_by_scope(spark, d):
    return scoped(spark, d).select("subscription", "seq")


def scoped(spark, d):
    log = T.change_log(spark, d)
    cursors = log.groupBy(F.col("entity_id").alias("scope_key")).agg((F.count("*") % 4 * 1000).alias("cursor"))
    cursors = cursors.select((F.col("scope_key") % 1000000).alias("subscription"), "scope_key", "cursor", F.lit("").alias("kinds"))
    return feed.for_scopes(log, cursors, feed.watermark(log, NOW)).where("kind <> 'error'")


#: Topics by tests of customers, which stand for records here.
TOPIC_TESTS = {"building": "lower(c_mktsegment) like '%build%'", "machines": "(lower(c_mktsegment) like '%machin%' or lower(c_name) like '%9')"}


def subscribed(spark, d):
    """Subscriptions to all kinds of scope: a jurisdiction each, topics with and without one, and lists of records; some of unknown targets."""
    n = T.table(spark, d, "nation").select("n_nationkey", "n_name")
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    places = n.select(key("j", "n_nationkey").alias("subscription"), F.lit("jurisdiction").alias("kind"), F.lower("n_name").alias("target"), (F.col("n_nationkey") * 300).alias("cursor"), F.lit("").alias("kinds"))
    topical = n.select(key("t", "n_nationkey").alias("subscription"), F.lit("topic").alias("kind"), F.when(F.col("n_nationkey") == 0, "machines").when(F.col("n_nationkey") == 1, "nothing").otherwise(F.concat(F.lit("building:"), "n_name")).alias("target"), F.lit(1000).alias("cursor"), F.lit("click,view").alias("kinds"))
    s, k = T.table(spark, d, "supplier"), F.col("s_suppkey")
    lists = s.select(key("b", "s_suppkey").alias("subscription"), F.lit("bills").alias("kind"), F.concat_ws(",", k.cast("string"), (k * 3).cast("string"), k.cast("string"), (k + 1).cast("string")).alias("target"), F.when(k % 2 == 0, k * 5).alias("cursor"), F.lit(None).cast("string").alias("kinds"))
    return places.unionByName(topical).unionByName(lists)


@query(f"""with v as (select event_id seq, user_id, event_type kind from events where event_id <= (select max(seq) from {VISIBLE})), e as (select v.*, n_name code, c_mktsegment, c_name from v join customer on c_custkey = user_id join nation on n_nationkey = c_nationkey)
 select 'j' || n_nationkey subscription, seq, user_id entity_id, kind from nation join e on code = n_name and seq > n_nationkey * 300
 union all select 't' || n_nationkey, seq, user_id, kind from nation join e on seq > 1000 and kind in ('click', 'view') and ((n_nationkey = 0 and {TOPIC_TESTS["machines"]}) or (n_nationkey > 1 and code = n_name and {TOPIC_TESTS["building"]}))
 union all select 'b' || s_suppkey, seq, user_id, kind from supplier join e on user_id in (s_suppkey, s_suppkey * 3, s_suppkey + 1) and seq > case when s_suppkey % 2 = 0 then s_suppkey * 5 else 0 end""")
def feed_by_all_scopes(spark, d):
    """Events of records, jurisdictions and topics behind each subscription's cursor; the log is read once."""
    log = T.change_log(spark, d)
    people = joins.with_labels(T.table(spark, d, "customer"), T.jurisdictions(spark, d), "c_nationkey", "jurisdiction_id", ["code"])
    keyed = scopes.scope_keys(people, "c_custkey", "code", {k: F.expr(x) for k, x in TOPIC_TESTS.items()})
    return scopes.events_for(log, keyed, "c_custkey", subscribed(spark, d), feed.watermark(log, NOW).first()[0])


@query("select 't1' subscription, 'topic' kind, 'nothing' target")
def unknown_scopes(spark, d):
    """Subscriptions to be disabled, as what they name isn't there."""
    found = scopes.unknown_scopes(subscribed(spark, d), T.jurisdictions(spark, d).select("code"), TOPIC_TESTS)
    return found.select("subscription", "kind", "target")


@query(f"select count(*) n, max(seq) last from {VISIBLE}")
def feed_lag(spark, d):
    return feed.visible(T.change_log(spark, d), NOW).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query(f"select user_id entity_id, seq from {VISIBLE} where ts >= timestamp '{NOW}' - interval 30 days qualify row_number() over (partition by user_id order by seq desc) <= 3")
def feed_recent(spark, d):
    return feed.recent(T.change_log(spark, d), "entity_id", NOW, 30, 3).select("entity_id", "seq")


@query("""select event_id seq, rtrim(translate(base64(encode('{"v":1,"seq":' || event_id || '}')), '+/', '-_'), '=') as cursor from events""")
def cursor_encode(spark, d):
    return T.change_log(spark, d).select("seq", paging.cursor_column("seq").alias("cursor"))


@query("with n as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) k from events) select user_id entity_id, count(*) || case when count(*) = 1 then ' change' else ' changes' end subject, string_agg(event_id || ' ' || event_type, chr(10) order by event_id) filter (k <= 5) body, greatest(count(*) - 5, 0) more, max(event_id) last_seq from n group by 1")
def digest_first_n(spark, d):
    return feed.digest(T.change_log(spark, d), "entity_id", 5)


@query("with n as (select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 7 batch from events), b as (select user_id subscription, batch, min(event_id) first_seq, max(event_id) last_seq, count(*) n from n group by 1, 2) select *, batch < max(batch) over (partition by subscription) more from b")
def drain_batches(spark, d):
    return feed.batches(T.change_log(spark, d).withColumnRenamed("entity_id", "subscription"), size=7)


@query("select event_id seq, max(epoch_us(ts - to_seconds(cast(event_id * 7919 % 100 as bigint)))) over (order by event_id) - epoch_us(ts - to_seconds(cast(event_id * 7919 % 100 as bigint))) behind_us from events")
def skew_running_max(spark, d):
    log = T.change_log(spark, d).withColumn("changed_at", F.timestamp_add("SECOND", (-(F.col("seq") * 7919 % 100)).cast("int"), F.col("changed_at")))
    return feed.skew(log)


@query("select user_id entity_id, greatest(min(event_id), 500) as cursor, greatest(0, 9000 - max(event_id)) lag from events group by 1")
def cursor_advance(spark, d):
    out = T.change_log(spark, d).groupBy("entity_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    return out.select("entity_id", feed.advanced(F.col("a"), F.lit(500)).alias("cursor"), feed.lag_of(F.col("b"), F.lit(9000)).alias("lag"))


@query(f"with s as (select user_id % 25 as k, count(*) n, max(event_id) m from {VISIBLE.replace('event_id seq', 'event_id')} group by 1) select n_name code, n, m last_seq from nation left join s on k = n_nationkey")
def feed_by_jurisdiction(spark, d):
    log = feed.visible(T.change_log(spark, d), NOW)
    sums = log.groupBy((F.col("entity_id") % 25).alias("k")).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))
    return T.jurisdictions(spark, d).join(sums, F.col("k") == F.col("jurisdiction_id"), "left").select("code", "n", "last_seq")


@query("select kind, count(*) n from (select event_type kind, user_id from events e where not exists (select 1 from events x where x.user_id = e.user_id and x.event_type = 'error' and x.event_id > 9000)) group by 1")
def anti_recent_errors(spark, d):
    from lexlake.operators import filters

    log = T.change_log(spark, d)
    return filters.without_child(log, log, (F.col("kind") == "error") & (F.col("seq") > 9000), "entity_id", "entity_id").groupBy("kind").agg(F.count("*").alias("n"))


