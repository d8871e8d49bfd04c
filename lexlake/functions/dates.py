"""Dates, cadences and delays as Column expressions. Now is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minutes between refreshes of each tier (fixed values).
CADENCE_MINUTES = {"active": 30, "year_round": 60, "recently_adjourned": 1440, "dormant": 10080}
ADJOURNED_DAYS = 30
LAG_SECONDS = 240
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyyMMdd")


def lenient_date(x: str) -> Column:
    """The first format that fits the whole text or its first ten characters; null if none does."""
    text = F.trim(x)
    return F.coalesce(*(F.try_to_date(text, f) for f in FORMATS), F.try_to_date(F.substring(text, 1, 10), FORMATS[0]))


def cadence(active: Column, end: Column, today: Column) -> Column:
    since = F.datediff(today, end)
    return F.when(active & end.isNull(), "year_round").when(active, "active").when(since.between(0, ADJOURNED_DAYS), "recently_adjourned").otherwise("dormant")


def cadence_minutes(tier: Column) -> Column:
    out = F.lit(CADENCE_MINUTES["dormant"])
    for name, minutes in CADENCE_MINUTES.items():
        out = F.when(tier == name, minutes).otherwise(out)
    return out


def due(last: Column, minutes: Column, now: Column) -> Column:
    """Never done, or as long ago as the cadence says."""
    return last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= minutes * 60)


def job_delay(attempt: Column) -> Column:
    """Seconds before a job's next attempt: a minute, doubled each time."""
    return (60 * F.pow(F.lit(2), attempt - 1)).cast("long")


def delivery_delay(failures: Column, retry_after: Column | None = None, jitter: Column | None = None) -> Column:
    """Seconds before a delivery's next attempt: 2^n minutes, six hours at most; a positive Retry-After instead, as long. jitter: a share from -0.2 to 0.2."""
    most = 6 * 3600
    delay = F.least(F.lit(most), F.pow(F.lit(2), F.least(failures, F.lit(20))).cast("long") * 60)
    if jitter is not None:
        delay = (delay * (1 + jitter)).cast("long")
    return delay if retry_after is None else F.when(retry_after > 0, F.least(F.lit(most), retry_after)).otherwise(delay)


def lagged(now: str) -> Column:
    """The latest time whose changes are visible."""
    return F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {LAG_SECONDS} SECONDS")


def session_year(day: Column) -> Column:
    """The odd year that begins a biennium."""
    year = F.year(day)
    return year - F.pmod(year + 1, F.lit(2))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
