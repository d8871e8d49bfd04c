"""One record and what hangs on it: detail, look-up, votes, evidence with caps, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexlake.operators import paging

# Most children of each kind in an evidence packet.
CAPS = {"versions": 100, "votes": 100, "hearings": 100, "actions": 500, "history": 500}
#: The lists of a full record, and most items of each that come with it; the rest is read by page.
LISTS = ("versions", "actions", "sponsors", "votes", "documents", "related", "subjects")
LIST_MOST = 500


def record_or_candidates(asked: DataFrame, rows: DataFrame, key: str, row_id: str, most: int = 20) -> DataFrame:
    """asked with outcome found, ambiguous_bill or not_found, the id if there is one, and the first candidates' ids if there are more."""
    first = rows.select(F.col(key).alias("_key"), F.col(row_id).alias("_id"))
    numbered = first.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_id")))
    hits = numbered.groupBy("_key").agg(F.count("*").alias("hits"), F.min("_id").alias("_one"), F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.col("_id")))).alias("_ids"))
    out = asked.join(hits, asked[key] == hits["_key"], "left")
    outcome = F.when(F.col("hits").isNull(), "not_found").when(F.col("hits") == 1, "found").otherwise("ambiguous_bill")
    return out.select(*asked.columns, outcome.alias("outcome"), F.when(F.col("hits") == 1, F.col("_one")).alias("row_id"), F.when(F.col("hits") > 1, F.col("_ids")).alias("candidates"))


def votes(rows: DataFrame, event: str, member: str, option: str) -> DataFrame:
    """(event, yes, no, other, members): tallies and sorted member records of each vote; a vote has no more members than its chamber."""
    o = F.col(option)
    return rows.groupBy(event).agg(
        *(F.count_if(c).alias(n) for n, c in (("yes", o == "yes"), ("no", o == "no"), ("other", ~o.isin("yes", "no")))),
        F.array_sort(F.collect_list(F.struct(member, option))).alias("members"),
    )


def capped_children(children: DataFrame, key: str, order: list[str], columns: list[str], cap: int, name: str) -> DataFrame:
    """(key, <name>, <name>_count, <name>_truncated): the first children, their true number, and whether some are left out. No more than cap children of a key are gathered."""
    # one shuffle and one sort for both: an item beyond the cap is counted, but null in the list, which leaves nulls out
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    item = F.when(F.col("_n") <= cap, F.struct("_n", *columns))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name)
    rows = children.where(F.col(key).isNotNull()).withColumn("_n", place).groupBy(key)
    return rows.agg(items, F.count("*").alias(f"{name}_count")).withColumn(f"{name}_truncated", F.col(f"{name}_count") > cap)


def evidence_packet(bills: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str], list[str]]], caps: dict[str, int] = CAPS) -> DataFrame:
    """bills with capped children of each kind. children: name to (rows with the key, order, columns)."""
    out = bills
    for name, (rows, order, columns) in children.items():
        out = out.join(capped_children(rows, key, order, columns, caps[name], name), key, "left")
        out = out.withColumns({f"{name}_count": F.coalesce(f"{name}_count", F.lit(0)), f"{name}_truncated": F.coalesce(f"{name}_truncated", F.lit(False))})
    return out


def full_record(bills: DataFrame, key: str, lists: dict[str, tuple[DataFrame, list[str], list[str]]], places: DataFrame, place: str, most: int = LIST_MOST) -> DataFrame:
    """bills with their place's facts as a struct (null if unknown) and the first items of all LISTS, each with its true number and whether items are left out.

    All lists are cut before they are gathered and lie by the record's key, so that the joins shuffle nothing more, and a record with
    any number of children costs no task more than the cut.
    """
    missing = [name for name in LISTS if name not in lists]
    if missing:
        raise ValueError(f"a full record has these lists, too: {missing}")
    facts = places.select(F.col(place).alias("_place"), F.struct(*places.columns).alias("jurisdiction"))
    rows = bills.join(facts, F.col(place) == F.col("_place"), "left").drop("_place")
    return evidence_packet(rows, key, {name: lists[name] for name in LISTS}, dict.fromkeys(LISTS, most))


def related_read(related: DataFrame, bills: DataFrame, identifier: str, relation: str, normal: Column) -> DataFrame:
    """related with the target's id by its normalised identifier in the same place and session; earlier sessions' relations and unknown identifiers keep null."""
    found = bills.groupBy(F.col("jurisdiction_id").alias("_p"), F.col("session").alias("_s"), normal.alias("_k")).agg(F.min("id").alias("target_id"))
    same = (related["jurisdiction_id"] == found["_p"]) & (related["session"] == found["_s"]) & (related[identifier] == found["_k"]) & (F.col(relation) != "prior-session")
    return related.join(found, same, "left").drop("_p", "_s", "_k")


def upcoming(events: DataFrame, start: str, as_of: str, order: list[str], most: int, **equal) -> DataFrame:
    """The next events that have not begun, those of the given place or record only."""
    rows = events.where(F.col(start) >= F.lit(as_of).cast("timestamp_ntz"))
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value) if value is not None else rows
    return rows.orderBy(start, *order).limit(most)


def listing(rows: DataFrame, order: list[str], offset: int, most: int, **equal) -> DataFrame:
    """A page of a list with optional filters."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value) if value is not None else rows
    return rows.orderBy(*order).offset(offset).limit(most)


def listed(rows: DataFrame, order: list[Column], number: int, size: int, **equal) -> DataFrame:
    """A page of a list with optional filters, each row with `total`, the number of rows that the filters leave."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value) if value is not None else rows
    return paging.page(rows, order, number, size).crossJoin(rows.agg(F.count("*").alias("total")))  # one row


def first_by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """A prioritised union: of each key the row of the first part that has it; of several there the smallest."""
    rows = None
    for k, part in enumerate(parts):
        part = part.withColumn("_priority", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    columns = parts[0].columns
    best = rows.groupBy(key).agg(F.min(F.struct("_priority", *(c for c in columns if c != key))).alias("_row"))
    return best.select(key, F.col("_row._priority").alias("priority"), *(F.col(f"_row.{c}").alias(c) for c in columns if c != key))
