"""The change log: gap-free pages, lag, cursors, drains and digests. Lag delays rows and never drops any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexlake.functions.dates import LAG_SECONDS, lagged

from .paging import numbered, range_of

KINDS = ("CREATED", "METADATA", "ACTIONS", "SPONSORS", "STATUS", "TEXT", "VOTE")  # fixed values
DIGEST_EVENTS, BATCH = 30, 100


def visible(log: DataFrame, now: str) -> DataFrame:
    """Rows old enough that no earlier seq can still be committed after them."""
    return log.where(F.col("changed_at") <= lagged(now))


def page(log: DataFrame, cursor: int, size: int, now: str, kinds: list[str] | None = None) -> DataFrame:
    """The next rows behind the cursor, oldest first, and one more that says whether there are others."""
    rows = visible(log, now).where(F.col("seq") > cursor)
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    return rows.orderBy("seq").limit(min(size, 500) + 1)


def watermark(log: DataFrame, now: str) -> DataFrame:
    """One row: the greatest visible seq, 0 if there is none."""
    return visible(log, now).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("watermark"))


def recent(log: DataFrame, key: str, now: str, days: int = 30, most: int = 100) -> DataFrame:
    """The newest visible rows of each key within the lookback."""
    rows = visible(log, now).where(F.col("changed_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where(F.col("place") <= most)


def for_scopes(log: DataFrame, scopes: DataFrame, limit: DataFrame) -> DataFrame:
    """(subscription, seq, ...): events of each subscription's key and kinds behind its own cursor, up to the watermark. scopes: (subscription, scope_key, cursor, kinds)."""
    s = scopes.alias("s")
    met = log.join(s, (F.col("scope_key") == F.col("entity_id")) & (F.col("seq") > F.col("cursor")))
    wanted = (F.coalesce("kinds", F.lit("")) == "") | F.array_contains(F.split("kinds", ","), F.col("kind"))
    return met.where(wanted).join(F.broadcast(limit), F.col("seq") <= F.col("watermark"))  # the limit is one row


def batches(events: DataFrame, subscription: str = "subscription", size: int = BATCH) -> DataFrame:
    """(subscription, batch, first_seq, last_seq, n, more): how each subscription's events are delivered in order."""
    out = numbered(events, [subscription], "seq", "_n").withColumn("batch", F.expr(f"_n div {size}")).groupBy(subscription, "batch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))
    return out.withColumn("more", F.col("batch") < F.max("batch").over(Window.partitionBy(subscription)))


def halved(sizes: list[int], most: int) -> int:
    """How many of the first events fit a body limit when a batch is halved until it does; 0 if even one doesn't."""
    n = len(sizes)
    while n and sum(sizes[:n]) > most:
        n //= 2
    return n


def digest(events: DataFrame, key: str, most: int = DIGEST_EVENTS) -> DataFrame:
    """(key, subject, body, more): the first events of each key as lines, and how many others there are. Only those few are gathered."""
    w = Window.partitionBy(key).orderBy("seq")
    totals = events.groupBy(key).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))
    first = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    lines = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda e: F.concat_ws(" ", e["seq"].cast("string"), e["kind"])), "\n").alias("body"))
    subject = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " change").otherwise(" changes"))
    return totals.join(lines, key).select(key, subject.alias("subject"), "body", F.greatest(F.col("n") - most, F.lit(0)).alias("more"), "last_seq")


def skew(log: DataFrame, rows: int | None = None) -> DataFrame:
    """(seq, behind_us): by how much a row's time lies before the greatest time of any smaller or equal seq.

    A running maximum within ranges of seq, carried over by the ranges' own maxima: no task holds the whole log.
    """
    part = range_of(log, "seq", rows)
    rows = log.select("seq", F.expr("unix_micros(cast(changed_at as timestamp))").alias("us"), (F.lit(0) if part is None else part).alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("part").agg(F.max("us").alias("m")).select("part", F.max("m").over(before).alias("carried"))  # a row for each range
    running = F.max("us").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).join(carried, "part").select("seq", (F.greatest("running", "carried") - F.col("us")).alias("behind_us"))


def start_cursor(stored: Column, mark: Column) -> Column:
    """Where a reader begins: a cursor of 0 has never read and goes to the watermark without telling anything."""
    return F.when(F.coalesce(stored, F.lit(0)) == 0, mark).otherwise(stored)


def advanced(old: Column, new: Column) -> Column:
    """A cursor never goes back."""
    return F.greatest(old, new)


def lag_of(cursor: Column, mark: Column) -> Column:
    return F.greatest(F.lit(0), mark - cursor)


def append(log_path: str, rows: DataFrame) -> None:
    """Adds change rows; one of an unknown kind fails the write."""
    checked = rows.withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("null"))))))
    checked.write.mode("append").parquet(log_path)


__all__ = ["LAG_SECONDS", "advanced", "append", "batches", "digest", "for_scopes", "halved", "lag_of", "page", "recent", "skew", "visible", "watermark"]
