"""Subscriptions and their deliveries as tables: who asks for what, what is due, what can go."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("bill", "jurisdiction", "topic", "all")


def valid_subscription(kind: str, target: str | None, events: str | None, known_events: list[str]) -> tuple[str, str | None, list[str]]:
    """Kind, target and sorted event kinds in canonical form; ValueError says what is wrong."""
    kind = kind.strip().lower()
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    target = (target or "").strip() or None
    if (target is None) != (kind == "all"):
        raise ValueError("a target is needed for all kinds but 'all'")
    if kind == "bill" and not re.fullmatch(r"\d+", target):
        raise ValueError("a bill is named by its id")
    wanted = sorted({x.strip().lower() for x in (events or "").split(",") if x.strip()})
    if unknown := set(wanted) - set(known_events):
        raise ValueError(f"unknown events: {', '.join(sorted(unknown))}")
    return kind, target.lower() if target else None, wanted or sorted(known_events)


def subscribed(requests: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """(key, outcome, active): requests are subscribe or unsubscribe (column ask); asking twice changes nothing."""
    last = requests.groupBy(*key).agg(F.max_by("ask", "seq").alias("ask"))
    out = last.join(stored.select(*key, F.col("active").alias("_was")), key, "left")
    on = F.col("ask") == "subscribe"
    outcome = F.when(on & F.col("_was").isNull(), "created").when(on & ~F.col("_was"), "reactivated").when(~on & F.col("_was"), "ended").otherwise("unchanged")
    return out.select(*key, outcome.alias("outcome"), F.when(F.col("_was").isNull() & ~on, False).otherwise(on).alias("active"))


def drained_notices(pending: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Notices that are left after a drain: one is cleared only if it is still what was sent."""
    done = sent.select(F.col(key).alias("_key"), F.col("notice").alias("_sent"))
    out = pending.join(done, pending[key] == done["_key"], "left")
    cleared = F.col("_sent").isNotNull() & (F.col("notice") == F.col("_sent"))
    return out.withColumn("notice", F.when(~cleared, F.col("notice"))).drop("_key", "_sent").where("notice is not null")


def hook_status(subscriptions: DataFrame, attempts: DataFrame, watermark: Column, most: int = 10) -> DataFrame:
    """subscriptions with cursor_lag_seq and the newest attempts. attempts: (subscription_id, seq, outcome)."""
    place = F.row_number().over(Window.partitionBy("subscription_id").orderBy(F.desc("seq")))
    recent = attempts.withColumn("_n", place).where(F.col("_n") <= most)
    lists = recent.groupBy("subscription_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "seq", "outcome"))), lambda x: x["outcome"]).alias("recent"))
    return subscriptions.join(lists, "subscription_id", "left").withColumn("cursor_lag_seq", F.greatest(F.lit(0), watermark - F.col("last_seq")))


def reactivated(last_seq: Column, watermark: Column, skip: Column) -> Column:
    """Where a subscription goes on: where it stopped, or behind all that it missed."""
    return F.when(skip, F.greatest(last_seq, watermark)).otherwise(last_seq)


def pruned(deliveries: DataFrame, now: str) -> DataFrame:
    """Deliveries of the last 30 days; those of creations only of the last 48 hours."""
    at = F.lit(now).cast("timestamp_ntz")
    age = F.when(F.col("kind") == "created", F.expr("INTERVAL 48 HOUR")).otherwise(F.expr("INTERVAL 720 HOUR"))
    return deliveries.where(F.col("at") >= at - age)


def alarms(probes: DataFrame, key: str, confirm: int = 2, again_hours: int = 6) -> DataFrame:
    """(key, at, alarm): down when failures in a row are confirmed, still_down each so many hours after, up when a confirmed failure ends. probes: (key, at, ok)."""
    order = Window.partitionBy(key).orderBy("at")
    rows = probes.withColumn("_turn", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order))
    run = Window.partitionBy(key, "_turn").orderBy("at")
    rows = rows.withColumn("_fails", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(run))
    rows = rows.withColumn("_since", F.min(F.when(F.col("_fails") == confirm, F.col("at"))).over(run))
    hours = F.floor((F.unix_timestamp("at") - F.unix_timestamp("_since")) / 3600 / again_hours)
    rows = rows.withColumn("_hours", hours).withColumn("_before", F.lag("_hours").over(run)).withColumn("_ended", F.lag("_fails").over(order))
    alarm = F.when(~F.col("ok") & (F.col("_fails") == confirm), "down").when(~F.col("ok") & (F.col("_hours") > F.col("_before")), "still_down")
    alarm = alarm.when(F.col("ok") & (F.col("_ended") >= confirm), "up")
    return rows.withColumn("alarm", alarm).where("alarm is not null").select(key, "at", "alarm")
