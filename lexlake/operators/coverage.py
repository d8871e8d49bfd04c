"""The coverage state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of advancement, and states that counts alone don't change.
ORDER = ("NOT_STARTED", "SOURCE_IDENTIFIED", "BOOTSTRAPPED", "METADATA_SEARCHABLE", "FULL_TEXT_SEARCHABLE", "VALIDATING", "GREEN")
HELD = ("GREEN", "DEGRADED", "BLOCKED", "VALIDATING")
PASS_RATE, TEXT_SHARE = 0.95, 0.95
RECOVERABLE = ("BOOTSTRAPPED", "METADATA_SEARCHABLE", "SOURCE_IDENTIFIED", "FULL_TEXT_SEARCHABLE", "DEGRADED", "GREEN")


def place(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), status)


def by_counts(status: Column, bills: Column, texts: Column) -> Column:
    """Forward only: searchable metadata with any bill, searchable text with any text."""
    with_bills = F.when((bills > 0) & (place(status) < 4), "METADATA_SEARCHABLE").otherwise(status)
    with_text = F.when((texts > 0) & (place(with_bills) < 5), "FULL_TEXT_SEARCHABLE").otherwise(with_bills)
    return F.when(status.isin(*HELD), status).otherwise(with_text)


def by_validation(status: Column, bills: Column, rate: Column, texts: Column, available: Column) -> Column:
    """What a validation makes of a row. available: null, not computed; 0, nothing to be had, which is enough."""
    open_ = status != "BLOCKED"
    enough = (available == 0) | (texts >= TEXT_SHARE * available)
    return (
        F.when((bills == 0) | rate.isNull(), status)
        .when(rate < PASS_RATE, F.when(open_, "DEGRADED").otherwise(status))
        .when(available.isNull(), F.when(status.isin("BOOTSTRAPPED", "METADATA_SEARCHABLE", "SOURCE_IDENTIFIED"), "VALIDATING").otherwise(status))
        .when(enough, F.when(open_, "GREEN").otherwise(status))
        .otherwise(F.when(status.isin(*RECOVERABLE), "VALIDATING").otherwise(status))
    )


def counts(bills: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """(group, bills, with_text, available): distinct bills in all, with text, and with text to be had. texts: (group, bill_id, has_text, terminal)."""
    b = bills.groupBy(group).agg(F.count_distinct("id").alias("bills"))
    t = texts.groupBy(group).agg(F.count_distinct(F.when(F.col("has_text"), F.col("bill_id"))).alias("with_text"), F.count_distinct(F.when(F.col("has_text") | ~F.col("terminal"), F.col("bill_id"))).alias("available"))
    return b.join(t, group, "left").select(group, "bills", F.coalesce("with_text", F.lit(0)).alias("with_text"), F.coalesce("available", F.lit(0)).alias("available"))


def report(rows: DataFrame) -> DataFrame:
    """Published rows: shares of the bills with text and with text to be had, in hundredths of a percent, and what is lacking."""
    share = lambda c: F.expr(f"{c} * 10000 div nullif(bills, 0)")
    gaps = [F.when(F.col("bills") == 0, "no_bills"), F.when((F.col("bills") > 0) & (F.col("with_text") == 0), "no_text"), F.when(F.col("with_text") < F.col("available"), "text_incomplete")]
    return rows.withColumns({"text_bp": share("with_text"), "available_bp": share("available"), "gaps": F.array_join(F.filter(F.array(*gaps), lambda g: g.isNotNull()), ",")})


def warnings(rows: DataFrame, group: str, status: str, least: str) -> DataFrame:
    """(group, code, severity, message) for rows whose status is below one of the order; unknown states are below all."""
    own = F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col(status)), F.lit(0))
    below = rows.where(own < ORDER.index(least) + 1)
    message = F.concat(F.col(group), F.lit(" is "), F.coalesce(status, F.lit("unknown")), F.lit(f", not yet {least}"))
    return below.select(group, F.lit("coverage_below_threshold").alias("code"), own.alias("severity"), message.alias("message"))


def serialised(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, row): each row's columns as JSON, nulls left out."""
    return rows.select(group, F.to_json(F.struct(*columns)).alias("row"))
