"""Sort modes, pages, keyset cursors and capped probes. Every order ends with a unique key."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_PAGE_MOST, PAGE_MOST, OFFSET_MOST = 50, 1000, 50_000
CURSOR_VERSION = 1


def order_by(mode: str, key: str = "id") -> list[Column]:
    modes = {"relevance": [F.desc_nulls_last("rank")], "latest_action": [F.desc_nulls_last("latest_day")], "introduced": [F.desc_nulls_last("day")], "jurisdiction": [F.asc_nulls_last("code")]}
    if mode not in modes:
        raise ValueError(f"unknown sort mode: {mode}")
    return [*modes[mode], F.asc(key)]


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = PER_PAGE_MOST) -> DataFrame:
    """A page by offset; sorts no more than the rows up to its end."""
    size = max(1, min(size, most))
    number = max(1, min(number, PAGE_MOST))
    if (number - 1) * size > OFFSET_MOST:
        raise ValueError(f"offset beyond {OFFSET_MOST}")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def envelope(rows: list[dict], number: int, size: int, total: int) -> dict:
    return {"data": rows, "pagination": {"page": number, "per_page": size, "total": total, "total_pages": -(-total // size)}, "meta": {}}


def keyset(df: DataFrame, cursor: int, size: int, key: str = "seq") -> DataFrame:
    """The next page and one row more, whose presence says that there is more."""
    return df.where(F.col(key) > cursor).orderBy(key).limit(size + 1)


@dataclass(frozen=True)
class Capped:
    rows: DataFrame
    saturated: Column


def capped(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """At most cap rows, each with `saturated`: whether there were more. One row beyond the cap tells; exactly cap rows aren't more."""
    probe = df.orderBy(*order).limit(cap + 1)
    numbered = probe.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # cap + 1 rows
    return numbered.withColumn("saturated", F.max("_n").over(Window.partitionBy()) > cap).where(F.col("_n") <= cap).drop("_n")


#: Rows that a range of a whole table's order is meant to have, and the most ranges: bounds are literals of the plan.
RANGE_ROWS, RANGES = 1 << 20, 1024


def bounds_of(df: DataFrame, key: str, rows: int | None = None) -> list:
    """Bounds between as many ranges of `key` as the table's size asks for, from one job."""
    n, at = df.agg(F.count("*"), F.percentile_approx(key, [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()
    many = min(RANGES, 1 + n // (rows or RANGE_ROWS))
    return sorted({at[k * RANGES // many - 1] for k in range(1, many)}) if at else []


def range_of(df: DataFrame, key: str, rows: int | None = None) -> Column | None:
    """Number of the range of `key` that a row is in; none if all are in one."""
    bounds = bounds_of(df, key, rows)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))) if bounds else None


def offset_by(parted: DataFrame, cell: list[str], before: DataFrame, name: str) -> DataFrame:
    """parted with a cell's number `name` of `before`, one row a cell; null cells meet null ones."""
    named = before.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(cell)), name)
    same = F.lit(True)
    for k, c in enumerate(cell):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{k}"))
    return parted.join(named, same).drop(*(f"_c{k}" for k in range(len(cell))))


def numbered(df: DataFrame, groups: list[str], key: str, name: str, rows: int | None = None, order: list[str] | None = None, part: Column | None = None) -> DataFrame:
    """df with a running number from 0 by `key` (or by `order`, which begins with what the key ranks) within each group. Ranges of the key are numbered alone and offset by the counts of those before, so no task sorts a whole group. part: the ranges, if they are known."""
    part = range_of(df, key, rows) if part is None else part
    parted, own = df.withColumn("_part", F.lit(0) if part is None else part), Window.partitionBy(*groups, "_part").orderBy(*(order or [key]))
    out = parted.withColumn("_own", F.row_number().over(own) - 1)
    if part is None:  # nothing lies before the only range
        return out.withColumn(name, F.col("_own").cast("long")).select(*df.columns, name)
    cell = [*groups, "_part"]
    before = parted.groupBy(*cell).count().withColumn("_before", F.sum("count").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("count"))  # a row for each group and range
    return offset_by(out, cell, before, "_before").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).select(*df.columns, name)


def chunks(df: DataFrame, key: str, size: int, rows: int | None = None) -> DataFrame:
    """(key, chunk): the ordered key in chunks of `size`, numbered by ranges."""
    return numbered(df.select(key), [], key, "_n", rows).select(key, F.expr(f"_n div {size}").alias("chunk"))


# A cursor is a JSON object of these members in this order, without blanks, in URL-safe base64 without padding.
MEMBERS = {"v": CURSOR_VERSION, "seq": None}


def encode_cursor(seq: int) -> str:
    text = json.dumps(MEMBERS | {"seq": seq}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(text: str) -> int:
    """The position; anything but a version 1 object with a whole number from 0 to below 2^63 is an error."""
    try:
        data = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except Exception as defect:
        raise ValueError("not a cursor") from defect
    seq = data.get("seq") if isinstance(data, dict) and data.get("v") == CURSOR_VERSION else None
    if isinstance(seq, bool) or not isinstance(seq, int) or not 0 <= seq < 1 << 63:
        raise ValueError("not a cursor")
    return seq


def cursor_column(seq: str) -> Column:
    body = F.concat(F.lit(f'{{"v":{CURSOR_VERSION},"seq":'), F.col(seq).cast("string"), F.lit("}"))
    return F.rtrim(F.translate(F.base64(body.cast("binary")), "+/", "-_"), F.lit("="))
