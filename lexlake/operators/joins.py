"""Joins that the engine's queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_labels(df: DataFrame, labels: DataFrame, key: str, label_key: str, columns: list[str]) -> DataFrame:
    """Columns of a small dimension, null where it has no row."""
    dim = labels.select(F.col(label_key).alias("_key"), *columns)
    return df.join(dim, df[key] == dim["_key"], "left").drop("_key")


def marked(df: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """df with 1 where its key is among the distinct keys, else 0: one aggregation instead of a correlated test."""
    found = keys.select(F.col(keys.columns[0]).alias("_key")).where("_key is not null").distinct()
    return df.join(found, df[key] == found["_key"], "left").withColumn(mark, F.when(F.col("_key").isNull(), 0).otherwise(1)).drop("_key")


def best_child(df: DataFrame, children: DataFrame, key: str, child_key: str, value: Column, order: Column, name: str) -> DataFrame:
    """The child value with the greatest order, for each row; null without children. An aggregation with partial sums, no window."""
    best = children.groupBy(F.col(child_key).alias("_key")).agg(F.max_by(value, order).alias(name))
    return df.join(best, df[key] == best["_key"], "left").drop("_key")


def lookup(tokens: DataFrame, rows: DataFrame, token: str, key: str, session: str, row_id: str) -> DataFrame:
    """Each token: found with its row, ambiguous with the sorted sessions of its rows, or not_found."""
    hits = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("hits"), F.min(row_id).alias("row_id"), F.array_join(F.array_sort(F.collect_set(F.col(session).cast("string"))), ",").alias("sessions"))
    out = tokens.join(hits, tokens[token] == hits["_key"], "left")
    outcome = F.when(F.col("hits").isNull(), "not_found").when(F.col("hits") == 1, "found").otherwise("ambiguous")
    return out.select(tokens[token], outcome.alias("outcome"), F.when(outcome == "found", F.col("row_id")).alias("row_id"), F.when(outcome == "ambiguous", F.col("sessions")).alias("sessions"))


def first_tokens(tokens: DataFrame, order: str, token: str) -> DataFrame:
    """Order-preserving removal of tokens equal but for case."""
    return tokens.groupBy(F.lower(token).alias("_folded")).agg(F.min(F.struct(order, token)).alias("_first")).select("_first.*")


def companions(related: DataFrame, rows: DataFrame, identifier: Column) -> DataFrame:
    """related (bill_id, target_id, identifier, relation, jurisdiction_id, session): null targets of companions resolved within their jurisdiction and session."""
    known = rows.groupBy("jurisdiction_id", "session", identifier.alias("identifier")).agg(F.min("id").alias("_found"))
    out = related.join(known, ["jurisdiction_id", "session", "identifier"], "left")
    fill = F.when(F.col("target_id").isNull() & (F.col("relation") == "companion") & ~F.col("_found").eqNullSafe(F.col("bill_id")), F.col("_found"))
    return out.withColumn("target_id", F.coalesce("target_id", fill)).drop("_found")


def changes(incoming: DataFrame, existing: DataFrame, key: str, checksum: str) -> DataFrame:
    """incoming with outcome created, updated or unchanged against what is stored."""
    old = existing.select(F.col(key).alias("_key"), F.col(checksum).alias("_old"))
    outcome = F.when(F.col("_key").isNull(), "created").when(F.col(checksum).eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    return incoming.join(old, incoming[key] == old["_key"], "left").withColumn("outcome", outcome).drop("_key", "_old")


def upsert(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The next snapshot: incoming rows replace those of their key, and the rest stays."""
    return incoming.unionByName(existing.join(incoming.select(key), key, "left_anti"))


def two_key_match(incoming: DataFrame, existing: DataFrame, by_id: str, by_key: list[str]) -> DataFrame:
    """incoming with matched_id: by the immutable id, else by the natural key."""
    ids = existing.select(F.col(by_id).alias("_id"), F.col("id").alias("_by_id"))
    keys = existing.groupBy(*by_key).agg(F.min("id").alias("_by_key"))
    out = incoming.join(ids, incoming[by_id] == ids["_id"], "left").join(keys, by_key, "left")
    return out.withColumn("matched_id", F.coalesce("_by_id", "_by_key")).drop("_id", "_by_id", "_by_key")


def with_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str], list[str]]]) -> DataFrame:
    """One row for each parent with its children as sorted arrays of structs. children: name -> (rows, key, order columns, columns)."""
    for name, (rows, child_key, order, columns) in children.items():
        fields = [*order, *(c for c in columns if c not in order)]
        lists = rows.groupBy(F.col(child_key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        parents = parents.join(lists, parents[key] == lists["_key"], "left").drop("_key")
        parents = parents.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return parents


def unique_session(slugs: DataFrame, sessions: DataFrame) -> DataFrame:
    """slug with the id of the one session of its place and class that shares a year or an ordinal; null if none or several do. Both have (place, class, years, ordinals)."""
    a, b = slugs.alias("a"), sessions.alias("b")
    meet = F.arrays_overlap("a.years", "b.years") | F.arrays_overlap("a.ordinals", "b.ordinals")
    hits = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.class") == F.col("b.class")) & meet, "left")
    found = hits.groupBy("a.slug").agg(F.count("b.session_id").alias("n"), F.min("b.session_id").alias("session_id"))
    return found.select("slug", F.when(F.col("n") == 1, F.col("session_id")).alias("session_id"))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
