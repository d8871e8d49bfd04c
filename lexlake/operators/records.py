"""Timelines, evidence digests and version diffs of a record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions import linediff
from lexlake.functions.digests import snapshot_id


def timeline(sources: dict[str, DataFrame]) -> DataFrame:
    """(bill_id, day, source_no, source, ordinal, what): dated rows of all sources, in no order: readers of one record sort by (day, source_no, ordinal)."""
    out = None
    for n, (name, rows) in enumerate(sources.items()):
        part = rows.where("day is not null").select("bill_id", "day", F.lit(n).alias("source_no"), F.lit(name).alias("source"), F.col("ordinal").cast("long").alias("ordinal"), F.col("what").cast("string").alias("what"))
        out = part if out is None else out.unionByName(part)
    return out


def evidence(rows: DataFrame, key: str, fields: list[str], children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, canonical, snapshot): facts in a fixed order with sorted child ids, so that row order can't change the id."""
    parts = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in [key, *fields]]
    for name, (child, child_id) in children.items():
        ids = child.groupBy(F.col("bill_id").alias("_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col(child_id))), lambda x: x.cast("string")), ",").alias(name))
        rows = rows.join(ids, rows[key] == ids["_key"], "left").drop("_key")
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(name, F.lit(""))))
    return rows.withColumn("canonical", F.concat_ws(";", *parts)).select(key, "canonical", snapshot_id(F.col("canonical")).alias("snapshot"))


#: Characters of both texts of a comparison together; beyond that there is no difference but a mark that says so.
DIFF_MOST = 1_500_000


def within_bound(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with too_large; texts of those are null from here on, so that Python never gets them."""
    small = F.length(old) + F.length(new) <= DIFF_MOST
    return pairs.withColumn("too_large", ~small).withColumn(old, F.when(~F.col("too_large"), F.col(old))).withColumn(new, F.when(~F.col("too_large"), F.col(new)))


def diffs(versions: DataFrame, key: str, ordinal: str, text: str, context: int = 3) -> DataFrame:
    """(key, from, to, too_large, lines array<struct<type,text>>): unified diff of each version to the next, by pairs, so a record with many versions spreads over tasks."""
    from pyspark.sql.window import Window

    nxt = Window.partitionBy(key).orderBy(ordinal)
    pairs = versions.select(key, F.col(ordinal).alias("from"), F.lead(ordinal).over(nxt).alias("to"), F.coalesce(text, F.lit("")).alias("a"), F.lead(F.coalesce(text, F.lit(""))).over(nxt).alias("b")).where("to is not null")

    @F.pandas_udf("array<struct<type:string,text:string>>")
    def unified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [{"type": kind, "text": x} for kind, x in linediff.unified(p.split("\n"), q.split("\n"), context)] for p, q in zip(a, b)])

    return within_bound(pairs, "a", "b").select(key, "from", "to", "too_large", unified("a", "b").alias("lines"))


def opcodes(versions: DataFrame, key: str, ordinal: str, text: str) -> DataFrame:
    """(key, from, to, too_large, ops array<struct<op,i1,i2,j1,j2>>): line edits from each record's first version with a text to its last. Pairs beyond the bound have no ops and say so."""
    has = versions.where(F.coalesce(F.trim(text), F.lit("")) != "").select(key, F.struct(F.col(ordinal).alias("n"), F.col(text).alias("t")).alias("v"))
    pairs = has.groupBy(key).agg(F.min_by("v", "v.n").alias("a"), F.max_by("v", "v.n").alias("b")).where("a.n != b.n")
    pairs = pairs.select(key, F.col("a.n").alias("from"), F.col("b.n").alias("to"), F.col("a.t").alias("old"), F.col("b.t").alias("new"))

    @F.pandas_udf("array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>")
    def ops(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [dict(zip(("op", "i1", "i2", "j1", "j2"), o)) for o in linediff.opcodes(p.split("\n"), q.split("\n"))] for p, q in zip(a, b)])

    return within_bound(pairs, "old", "new").select(key, "from", "to", "too_large", ops("old", "new").alias("ops"))
