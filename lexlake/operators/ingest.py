"""Bulk and incremental ingest as set operations: references resolved, rows merged, events for what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(rows: DataFrame, reference: str, known: DataFrame, external: str, internal: str, name: str) -> DataFrame:
    """rows with the internal id of an external reference, null where it is unknown: one join instead of a cached look-up for each row."""
    ids = known.groupBy(F.col(external).alias("_ref")).agg(F.min(internal).alias(name))
    return rows.join(ids, rows[reference] == ids["_ref"], "left").drop("_ref")


def merged(incoming: DataFrame, stored: DataFrame, key: list[str], checksum: str, newest: Column) -> DataFrame:
    """Every incoming key once, by its newest row, with outcome created, updated or unchanged against the stored checksum. Rows whose key has a null are refused and don't come out."""
    rows = incoming.dropna(subset=key)
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), newest).alias("_row")).select("_row.*")
    old = stored.groupBy(*key).agg(F.max(checksum).alias("_stored"))
    outcome = F.when(F.col("_stored").isNull(), "created").when(F.col("_stored") == F.col(checksum), "unchanged").otherwise("updated")
    return best.join(old, key, "left").withColumn("outcome", outcome).drop("_stored")


def until_unchanged(rows: DataFrame, page: str, outcome: str) -> DataFrame:
    """Rows of the pages up to and with the first page on which nothing changed: where an incremental pull stops."""
    quiet = rows.groupBy(page).agg(F.bool_and(F.col(outcome) == "unchanged").alias("_quiet")).where("_quiet").agg(F.min(page).alias("_last"))
    return rows.join(F.broadcast(quiet), F.col("_last").isNull() | (F.col(page) <= F.col("_last"))).drop("_last")  # quiet has one row


def field_events(rows: DataFrame, key: str, old: dict[str, Column], new: dict[str, Column], created: Column) -> DataFrame:
    """(key, kind) of each event: created for new rows, else one for each part that differs."""
    kinds = [F.when(created, "created"), *(F.when(~created & ~old[k].eqNullSafe(new[k]), f"{k}_changed") for k in old)]
    return rows.select(key, F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("kind"))


def never_back(stored: Column, incoming: Column) -> Column:
    """A time stamp that only advances; nulls don't count."""
    return F.greatest(stored, incoming)


def revised_children(incoming: DataFrame, stored: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Incoming children with outcome inserted, revised or kept, by a natural key; stored ones that aren't sent stay and don't come out."""
    old = stored.select(*key, F.struct(*values).alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.struct(*values), "kept").otherwise("revised")
    return incoming.join(old, key, "left").withColumn("outcome", outcome).drop("_old")


def session_or_active(rows: DataFrame, slug: str, place: str, sessions: DataFrame) -> DataFrame:
    """rows with session_id: that of the slug, else the place's active session with a warning. sessions: (place, slug, session_id, active)."""
    exact = sessions.groupBy(F.col("place").alias("_p"), F.col("slug").alias("_s")).agg(F.min("session_id").alias("_exact"))
    active = sessions.where("active").groupBy(F.col("place").alias("_q")).agg(F.max("session_id").alias("_active"))
    out = rows.join(exact, (rows[place] == exact["_p"]) & (rows[slug] == exact["_s"]), "left").join(active, rows[place] == active["_q"], "left")
    warning = F.when(F.col("_exact").isNull(), F.when(F.col("_active").isNull(), "no_session").otherwise("active_session_assumed"))
    return out.withColumn("session_id", F.coalesce("_exact", "_active")).withColumn("warning", warning).drop("_p", "_s", "_q", "_exact", "_active")


def run_row(pipeline: str, started: Column, finished: Column, rows: Column, error: Column) -> list[Column]:
    """Columns of a run ledger's row; a run with an error has failed."""
    state = F.when(error.isNull(), "success").otherwise("failed").alias("state")
    return [F.lit(pipeline).alias("pipeline"), started.alias("started_at"), finished.alias("finished_at"), rows.alias("n_rows"), state, error.alias("error")]


def sync_watermark(runs: DataFrame, pipeline: str | None = None) -> DataFrame:
    """(pipeline, since): when the last successful run of a pipeline started; other pipelines' runs don't count."""
    runs = runs if pipeline is None else runs.where(F.col("pipeline") == pipeline)
    return runs.groupBy("pipeline").agg(F.max(F.when(F.col("state") == "success", F.col("started_at"))).alias("since"))


def latest_version(versions: DataFrame, key: str, day: str, number: str, ordinal: str, value: str) -> DataFrame:
    """(key, value) of the version with the greatest (day, number); of ties the one that came first."""
    return versions.groupBy(key).agg(F.max_by(value, F.struct(F.coalesce(day, F.lit("0001-01-01").cast("date")), number, -F.col(ordinal))).alias(value))


def texts_onto(documents: DataFrame, texts: DataFrame, key: str, checksum: str) -> DataFrame:
    """documents with the latest text's checksum and whether it was written: a second run writes nothing. texts: (key, checksum)."""
    new = texts.select(F.col(key).alias("_key"), F.col(checksum).alias("_new"))
    out = documents.join(new, documents[key] == new["_key"], "left")
    written = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(checksum))
    return out.withColumn("written", written).withColumn(checksum, F.coalesce("_new", checksum)).drop("_key", "_new")


def advanced(stored: Column, incoming: Column) -> Column:
    """A registry's coverage status: taken from a registry only as long as nothing has been done."""
    return F.when(stored.isNull() | (stored == "NOT_STARTED"), incoming).otherwise(stored)


def tagged_before(rows: DataFrame, column: str, at: str, cutoff: str, tag: Column) -> DataFrame:
    """A one-off tag of rows before a cutoff that have none."""
    return rows.withColumn(column, F.when(F.col(column).isNull() & (F.col(at) < F.lit(cutoff).cast("timestamp_ntz")), tag).otherwise(F.col(column)))
