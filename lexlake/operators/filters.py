"""Predicates and projections over entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def structured(df: DataFrame, *, since=None, until=None, date_col: str = "day", **equal) -> DataFrame:
    """Conjunction of the filters that are given: equality, and a date range that includes both ends."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    if since is not None:
        df = df.where(F.col(date_col) >= F.lit(since).cast("date"))
    return df if until is None else df.where(F.col(date_col) <= F.lit(until).cast("date"))


def having_child(df: DataFrame, children: DataFrame, condition: Column, key: str = "id", child_key: str = "bill_id") -> DataFrame:
    """Rows with at least one child that meets the condition; rows don't multiply."""
    kids = children.where(condition).select(F.col(child_key).alias("_key"))
    return df.join(kids, df[key] == kids["_key"], "left_semi")


def without_child(df: DataFrame, children: DataFrame, condition: Column | None = None, key: str = "id", child_key: str = "bill_id") -> DataFrame:
    kids = (children if condition is None else children.where(condition)).select(F.col(child_key).alias("_key"))
    return df.join(kids, df[key] == kids["_key"], "left_anti")


def contains(column: str, text: str) -> Column:
    """Case-insensitive substring; % and _ of the text act as wildcards, as its callers expect."""
    return F.col(column).ilike(f"%{text}%")


def same_folded(column: str, text: str) -> Column:
    return F.lower(column) == F.lower(F.trim(F.lit(text)))


def not_in_or_null(column: str, values: list) -> Column:
    """NOT IN that keeps nulls."""
    return F.col(column).isNull() | ~F.col(column).isin(values)


def distinct_from(column: str, value) -> Column:
    return ~F.col(column).eqNullSafe(F.lit(value))


def kinds(column: str, wanted: str | None) -> Column:
    """A comma-separated list of kinds; an empty one means all."""
    names = [x.strip() for x in (wanted or "").split(",") if x.strip()]
    return F.col(column).isin(names) if names else F.lit(True)


def null_or_listed(column: str, wanted: str) -> Column:
    return F.col(column).isNull() | F.array_contains(F.split(F.lit(wanted), ","), F.col(column))


def none_of(column: str, values: list[str]) -> Column:
    return ~F.array_contains(F.array(*map(F.lit, values)), F.col(column))


def json_field(column: str, field: str, value: str) -> Column:
    return F.get_json_object(column, f"$.{field}") == F.lit(value)


def any_like(column: str, patterns: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(column).like(p) for p in patterns), F.lit(False))


def enrolled_uncaptured(status: str, session_end: str, today: str, days: int = 180) -> Column:
    """Enrolled, and the session ended more than so many days ago; an unknown end is false."""
    return F.coalesce((F.col(status) == "enrolled") & (F.datediff(F.lit(today).cast("date"), F.col(session_end)) > days), F.lit(False))


def emptiness(result: DataFrame, unfiltered: DataFrame) -> str | None:
    """Why a result is empty: nothing was ever collected, or nothing matches. None if it isn't."""
    if not result.isEmpty():
        return None
    return "not_collected" if unfiltered.isEmpty() else "no_match"


def scope(kind: str, target: str, topics: dict, known: set[str]) -> Column | None:
    """Predicate of a subscription's scope over change rows; None if it names something unknown (then it is to be disabled)."""
    if kind == "jurisdiction":
        return F.col("code") == target.upper() if target.upper() in known else None
    if kind == "bills":
        ids = [x for x in target.split(",") if x]
        return F.col("entity_id").cast("string").isin(ids) if ids else None
    if kind == "topic":
        slug, _, code = target.partition(":")
        if slug not in topics or (code and code.upper() not in known):
            return None
        return topics[slug] & (F.col("code") == code.upper()) if code else topics[slug]
    return None


def id_set(column: str, ids: list[int], most: int) -> Column:
    """An explicit set of ids. More than the bound are an error, so that a plan's size is known."""
    if len(ids) > most:
        raise ValueError(f"at most {most} ids")
    return F.col(column).isin(ids)
