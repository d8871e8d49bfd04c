"""Sessions: their dates, what contradicts these, and bounded passes over their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import strings as S

from .status import LIVE


def with_dates(sessions: DataFrame, found: DataFrame, key: list[str], today: str) -> DataFrame:
    """sessions with start and end filled or corrected from what was found, active by the end, and what was done to each. found: (key, start, end)."""
    new = found.select(*key, F.col("start").alias("_start"), F.col("end").alias("_end"))
    out = sessions.join(new, key, "left")
    end = F.coalesce("_end", "end")
    did = F.when(F.col("_end").isNull() & F.col("_start").isNull(), "unknown").when(F.col("end").isNull() & F.col("start").isNull(), "filled")
    did = did.when(~(F.coalesce("_start", "start").eqNullSafe(F.col("start")) & end.eqNullSafe(F.col("end"))), "corrected").otherwise("same")
    active = F.when(end.isNull(), F.col("active")).otherwise(end >= F.lit(today).cast("date"))
    return out.select(*key, F.coalesce("_start", "start").alias("start"), end.alias("end"), active.alias("active"), did.alias("did"))


def contradicted(sessions: DataFrame, today: str) -> DataFrame:
    """Sessions that are marked active although they have ended."""
    return sessions.where(F.col("active") & (F.col("end") < F.lit(today).cast("date")))


def contradictions(bills: DataFrame, status: str, active: str, place: str, only: list[str] | None = None) -> DataFrame:
    """(place, n), most first: records said to have died with a session that is still under way. only: the places asked for, all if None."""
    rows = bills.where((F.col(status) == "died_on_adjournment") & F.col(active))
    rows = rows if only is None else rows.where(F.col(place).isin(*only))
    return rows.groupBy(place).agg(F.count("*").alias("n")).orderBy(F.desc("n"), place)


def to_sweep(bills: DataFrame, status: str, end: str, active: str, today: str, most: int = 20_000) -> DataFrame:
    """The first records, by id, of ended and inactive sessions whose status is open."""
    open_ = F.col(status).isNull() | F.col(status).isin(*LIVE)
    return bills.where((F.col(end) < F.lit(today).cast("date")) & ~F.col(active) & open_).orderBy("id").limit(most)


def recently_active(actions: DataFrame, key: list[str], day: str, what: Column, patterns: list[str], today: str, days: int = 30) -> DataFrame:
    """Sessions with an action of a chamber within the last days and none of the future's."""
    now = F.lit(today).cast("date")
    like = F.lit(False)
    for p in patterns:
        like = like | what.ilike(p)
    return actions.where(like & (F.col(day) > F.date_sub(now, days)) & (F.col(day) <= now)).select(*key).distinct()


def largest(bills: DataFrame, key: list[str], most: int) -> DataFrame:
    """The sessions, or places, with the most records."""
    return bills.groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(most)


def resolved(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(place, slug, path, session_id, identifier): the session of each name of a load, found or made.

    wanted: (place, slug); known: (place, session_id, identifier, class, active, start). A name is a session's own (exact);
    without a name it is the place's latest active session (active), or none; else the one session of the place with the same class and
    a year or ordinal in common (fuzzy); else a new one (new), which the names after it may match in turn, so that two
    names of one new session give one. Names of a place are taken in order, against its few sessions; a repeated load finds
    what it made. Several sessions in question are no match.
    """
    of = lambda text, kind: F.struct(F.col("session_id").alias("id"), F.col(text).alias("identifier"), kind.alias("class"), S.years(text).alias("years"), S.ordinals(text).alias("ordinals"))
    own = known.groupBy("place").agg(F.array_sort(F.collect_list(of("identifier", F.col("class")))).alias("known"), F.max(F.when(F.col("active"), F.struct(F.coalesce("start", F.lit("0001-01-01").cast("date")).alias("start"), F.col("session_id").alias("id")))).alias("latest"))
    made = F.xxhash64(F.col("place"), F.lower(F.trim("slug"))) if known.schema["session_id"].dataType.simpleString() == "bigint" else F.concat_ws("/", F.col("place").cast("string"), "slug")
    names = wanted.select("place", "slug").where("slug is not null").distinct().select("place", "slug", made.alias("session_id"))
    names = names.groupBy("place").agg(F.array_sort(F.collect_list(of("slug", S.session_class("slug")))).alias("_names"))
    names = names.withColumn("names", F.array_sort("_names", lambda a, b: F.when(a["identifier"] < b["identifier"], -1).when(a["identifier"] > b["identifier"], 1).otherwise(0)))
    both = names.join(own, "place", "left")
    kind = both.select("names").schema["names"].dataType.elementType.simpleString()
    start = F.struct(F.coalesce("known", F.array().cast(f"array<{kind}>")).alias("seen"), F.array().cast(f"array<struct<slug:string,path:string,session:{kind}>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        exact = F.filter(state["seen"], lambda c: c["identifier"] == x["identifier"])
        alike = F.filter(state["seen"], lambda c: (c["class"] == x["class"]) & (F.arrays_overlap(c["years"], x["years"]) | F.arrays_overlap(c["ordinals"], x["ordinals"])))
        path = F.when(F.size(exact) > 0, "exact").when(F.size(alike) == 1, "fuzzy").otherwise("new")
        session = F.when(F.size(exact) > 0, F.get(exact, F.lit(0))).when(F.size(alike) == 1, F.get(alike, F.lit(0))).otherwise(x)
        seen = F.when(path == "new", F.concat(state["seen"], F.array(x))).otherwise(state["seen"])
        return F.struct(seen.alias("seen"), F.concat(state["out"], F.array(F.struct(x["identifier"].alias("slug"), path.alias("path"), session.alias("session")))).alias("out"))

    named = both.select("place", F.inline(F.aggregate("names", start, step, lambda s: s["out"]))).select("place", "slug", "path", F.col("session.id").alias("session_id"), F.col("session.identifier").alias("identifier"))
    ids = known.select(F.col("session_id").alias("_id"), "identifier")
    unnamed = wanted.where("slug is null").select("place").distinct().join(own.select("place", F.col("latest.id").alias("session_id")), "place", "left").join(ids, F.col("_id") == F.col("session_id"), "left")
    return named.unionByName(unnamed.select("place", F.lit(None).cast("string").alias("slug"), F.when(F.col("session_id").isNotNull(), "active").alias("path"), "session_id", "identifier"))
