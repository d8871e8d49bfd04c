"""What to fetch, refresh and validate next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .paging import numbered, offset_by, range_of


#: Numbers within an item whose counts are summed together first.
COUNTED = 4096


def fair_order(pending: DataFrame, group: str, item: str, covered: str, order: list[str], rows: int | None = None) -> DataFrame:
    """pending with `in_item` and `turn`: within a group, first those of items not covered, of each item one at a time. Sorted by (turn, group) that is round robin.

    A turn is counted, not sorted for: so many rows of the group have a lesser number within their item, or the same and lie
    in a range of `order` before, and so many of its own range come first. Windows hold a range of one number's rows, or counts.
    """
    part = range_of(pending, order[0], rows)
    own = numbered(pending, [group, item], order[0], "_n", order=order, part=part).withColumn("in_item", F.col("_n") + 1).drop("_n")
    own = own.withColumn("_part", F.lit(0) if part is None else part)
    cell = [group, covered, "in_item", "_part"]
    counts = own.groupBy(*cell).count().withColumn("_many", F.expr(f"in_item div {COUNTED}"))
    large = counts.groupBy(group, covered, "_many").agg(F.sum("count").alias("_sum"))
    large = large.withColumn("_large", F.sum("_sum").over(Window.partitionBy(group).orderBy(covered, "_many")) - F.col("_sum"))
    small = counts.withColumn("_small", F.sum("count").over(Window.partitionBy(group, covered, "_many").orderBy("in_item", "_part")) - F.col("count"))
    before = offset_by(small, [group, covered, "_many"], large, "_large").withColumn("_before", F.col("_small") + F.col("_large"))
    placed = own.withColumn("_own", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return offset_by(placed, cell, before, "_before").withColumn("turn", (F.col("_own") + F.col("_before")).cast("long")).select(*pending.columns, "in_item", "turn")


def priority_plan(rows: DataFrame, key: str, priority: Column, last: str, batch: int) -> DataFrame:
    """The next keys to validate: by priority, longest ago first and never before all, one row a key."""
    best = rows.groupBy(key).agg(F.min(F.struct(priority.alias("priority"), F.col(last).isNotNull().alias("done"), F.col(last).alias("last"))).alias("_best"))
    return best.select(key, "_best.priority", F.col("_best.last").alias(last)).orderBy("priority", F.asc_nulls_first(last), key).limit(batch)


def rotation(rows: DataFrame, key: str, last: str, most: int = 50) -> DataFrame:
    return rows.orderBy(F.asc_nulls_first(last), key).limit(most)


def due(rows: DataFrame, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    return rows.where(F.col("active") & F.col("verified") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= at)))


def enqueued(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (kind, payload) without what is queued or running already, each once."""
    open_ = jobs.where(F.col("state").isin("queued", "running")).select("kind", "payload")
    return wanted.select("kind", "payload").distinct().join(open_, ["kind", "payload"], "left_anti")


def last_enqueued(jobs: DataFrame, kind: str, states: tuple[str, ...] = ("queued", "running", "done")) -> DataFrame:
    """(payload, last): when the newest job of a kind was made for each payload, in any of three states."""
    rows = jobs.where((F.col("kind") == kind) & F.col("state").isin(*states))
    return rows.groupBy("payload").agg(F.max("created_at").alias("last"))


def claim(jobs: DataFrame, now: str, kinds: list[str] | None = None, most: int = 1, but: list[str] | None = None) -> DataFrame:
    """The oldest jobs that may run, of some kinds only or of all but some; taking them is the single writer's next snapshot."""
    rows = jobs.where((F.col("state") == "queued") & (F.col("run_after") <= F.lit(now).cast("timestamp_ntz")))
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    rows = rows.where(~F.col("kind").isin(but)) if but else rows
    return rows.orderBy("run_after", "id").limit(most)


def after_attempt(jobs: DataFrame, results: DataFrame, now: str, most_attempts: int = 5) -> DataFrame:
    """The queue's next snapshot after attempts (id, ok, error): done, queued again with doubled delay, or dead."""
    from lexlake.functions.dates import job_delay

    r = results.select(F.col("id").alias("_id"), "ok", F.substring("error", 1, 4000).alias("_error"))
    out = jobs.join(r, jobs["id"] == r["_id"], "left")
    attempts = F.col("attempts") + F.when(F.col("_id").isNotNull(), 1).otherwise(0)
    state = F.when(F.col("_id").isNull(), F.col("state")).when(F.col("ok"), "done").when(attempts >= most_attempts, "dead").otherwise("queued")
    again = F.timestamp_add("SECOND", job_delay(attempts).cast("int"), F.lit(now).cast("timestamp_ntz"))
    columns = {"state": state, "attempts": attempts, "run_after": F.when(F.col("_id").isNotNull() & (state == "queued"), again).otherwise(F.col("run_after")), "last_error": F.coalesce("_error", "last_error")}
    return out.select(*(columns.get(c, jobs[c]).alias(c) for c in jobs.columns))


def best_session(sessions: DataFrame, key: str) -> DataFrame:
    """A session for each key: active first, then the latest begin, unknown begins last."""
    w = Window.partitionBy(key).orderBy(F.desc("active"), F.desc_nulls_last("start"), "session_id")
    return sessions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def windows(rows: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """(key, begin, n, refused): requests in fixed windows of the clock."""
    begin = (F.unix_timestamp(F.col(at).cast("timestamp")) / seconds).cast("long") * seconds
    return rows.groupBy(key, begin.alias("begin")).agg(F.count("*").alias("n")).withColumn("refused", F.greatest(F.col("n") - most, F.lit(0)))
