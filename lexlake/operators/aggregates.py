"""Reports: conditional and distinct aggregations in one scan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"GREEN": 6, "VALIDATING": 5, "FULL_TEXT_SEARCHABLE": 4, "METADATA_SEARCHABLE": 3, "BOOTSTRAPPED": 2, "SOURCE_IDENTIFIED": 1, "NOT_STARTED": 0}


def mortality(rows: DataFrame, group: str, status: str) -> DataFrame:
    """Counts by outcome for each group and in all (is_total), with shares in hundredths of a percent: a null status is unknown.

    degenerate: one of the two ways not to pass is empty.
    """
    s = F.col(status)
    parts = rows.rollup(group).agg(
        F.count("*").alias("total"), F.count_if(s == "enacted").alias("passed"), F.count_if(s == "died_on_adjournment").alias("died"), F.count_if(s.isin("dead", "vetoed", "withdrawn")).alias("killed"),
        F.count_if(s.isin("introduced", "in_committee", "passed_one_chamber", "passed_both", "enrolled")).alias("pending"), F.count_if(s.isNull()).alias("unknown"), (F.grouping(group) == 1).alias("is_total"),
    )
    did_not = F.col("died") + F.col("killed")
    parts = parts.withColumns({"did_not_pass": did_not, "degenerate": (did_not > 0) & ((F.col("died") == 0) | (F.col("killed") == 0))})
    return parts.withColumns({f"{c}_bp": F.expr(f"{c} * 10000 div nullif(total, 0)") for c in ("passed", "did_not_pass")})


def with_active(report: DataFrame, group: str, sessions: DataFrame, active: str) -> DataFrame:
    """A mortality report with has_active: whether the group has a session under way; null for the row of all."""
    live = sessions.where(F.col(active)).select(F.col(group).alias("_group")).distinct()
    rows = report.join(live, report[group] == live["_group"], "left")
    return rows.withColumn("has_active", F.when(~F.col("is_total"), F.col("_group").isNotNull())).drop("_group")


def usage(rows: DataFrame, tool: str, outcome: str, duration: str, excluded: Column) -> DataFrame:
    """(tool, ok, error, excluded, median): the lower median of the counted successful calls' duration. excluded rows count only as such."""
    rows = rows.withColumns({"_counted": ~F.coalesce(excluded, F.lit(False)), "_ok": F.col(outcome) == "ok"})
    median = F.expr(f"cast(percentile_disc(0.5) within group (order by {duration}) filter (where _counted and _ok) as bigint)")
    return rows.groupBy(tool).agg(
        F.count_if(F.col("_counted") & F.col("_ok")).alias("ok"), F.count_if(F.col("_counted") & (F.col(outcome) == "error")).alias("error"),
        F.count_if(~F.col("_counted")).alias("excluded"), median.alias("median"),
    )


def topic_counts(rows: DataFrame, topics: dict[str, Column]) -> DataFrame:
    """(topic, n): all topics in one scan, then turned."""
    counts = rows.agg(*(F.count_if(c).alias(t) for t, c in topics.items()))
    return counts.unpivot([], list(topics), "topic", "n")


def pass_rate(legs: DataFrame, group: str, outcome: str) -> DataFrame:
    """(group, checked, passed, rate_bp): of the legs that could be checked; null if none could."""
    s = F.col(outcome)
    out = legs.groupBy(group).agg(F.count_if(s.isin("pass", "fail")).alias("checked"), F.count_if(s == "pass").alias("passed"))
    return out.withColumn("rate_bp", F.expr("passed * 10000 div nullif(checked, 0)"))


def rarest(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    """(word, n): how many rows have each word, counted in one scan; the rarest first, of equal ones the longest."""
    counts = rows.agg(*(F.count_if(F.col(text).ilike(f"%{w}%")).alias(w) for w in words)).unpivot([], words, "word", "n")
    return counts.orderBy("n", F.desc(F.length("word")), "word").limit(1)


def tally(rows: DataFrame, key: str, option: Column, votes: Column) -> DataFrame:
    """Sums of yes, no and anything else."""
    return rows.groupBy(key).agg(*(F.sum(F.when(c, votes).otherwise(0)).cast("long").alias(n) for n, c in (("yes", option == "yes"), ("no", option == "no"), ("other", ~option.isin("yes", "no")))))


def worst_status(rows: DataFrame, group: str, status: str, groups: DataFrame | None = None) -> DataFrame:
    """The least trustworthy status of each group; unknown ones count as the worst. groups: all that there are; those without rows are NOT_STARTED."""
    if groups is not None:
        found = worst_status(rows, group, status)
        out = groups.select(group).distinct().join(found, group, "left")
        return out.select(group, F.coalesce("worst", F.lit("NOT_STARTED")).alias("worst"), F.coalesce("severity", F.lit(0)).alias("severity"))
    table = F.create_map(*(F.lit(x) for item in SEVERITY.items() for x in item))
    severity = F.coalesce(F.try_element_at(table, F.col(status)), F.lit(0))
    return rows.groupBy(group).agg(F.min_by(status, F.struct(severity, F.col(status))).alias("worst"), F.min(severity).alias("severity"))


def summary_status(rows: DataFrame, group: str, status: str) -> DataFrame:
    n, first = F.count_distinct(status), F.min(status)
    return rows.groupBy(group).agg(F.when(n == 0, "NOT_STARTED").when(n == 1, first).otherwise("MIXED").alias("summary"))


def all_below_or_empty(rows: DataFrame, group: str, status: str, count: str, below: list[str]) -> DataFrame:
    """Groups whose rows all have an early status, or that have nothing at all."""
    return rows.groupBy(group).agg(F.bool_and(F.col(status).isin(below)).alias("_early"), F.sum(F.coalesce(count, F.lit(0))).alias("_n")).where("_early or _n = 0").select(group)


def health(log: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """One row: newest change, changes of the last hour, jobs by state, and a verdict."""
    at = F.lit(now).cast("timestamp_ntz")
    changes = log.agg(F.max("changed_at").alias("newest"), F.count_if(F.col("changed_at") > at - F.expr("INTERVAL 1 HOUR")).alias("last_hour"))
    queue = jobs.agg(F.count_if((F.col("state") == "queued") & (F.col("run_after") <= at)).alias("claimable"), F.count_if(F.col("state") == "dead").alias("dead"))
    verdict = F.when(F.col("newest").isNull(), "empty").when(F.col("dead") > 0, "degraded").when((F.col("last_hour") == 0) & (F.col("claimable") > 0), "stalled").otherwise("ok")
    return changes.join(F.broadcast(queue), F.lit(True)).withColumn("verdict", verdict)  # one row each


def latest_child(children: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    return children.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(name))


def first_child(children: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    return children.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(name))


def quotas(rows: DataFrame, key: str, since: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count_if(F.col("created_at") >= since).alias("recent"), F.count_if("active").alias("active"), F.count_if(~F.col("verified")).alias("unverified"))


def queue_depth(jobs: DataFrame, now: str) -> DataFrame:
    """(kind, state, n, claimable): how many jobs of each kind are in each state, and how many may run."""
    may = (F.col("state") == "queued") & (F.col("run_after") <= F.lit(now).cast("timestamp_ntz"))
    return jobs.groupBy("kind", "state").agg(F.count("*").alias("n"), F.count_if(may).alias("claimable"))
