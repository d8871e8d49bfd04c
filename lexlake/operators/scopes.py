"""Events for subscriptions by scope: records, jurisdictions, topics and topics within a jurisdiction, in one join."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a range of seq. A hot scope's events and the readers behind them meet range by range.
RANGE = 1 << 20


def scope_keys(entities: DataFrame, key: str, code: str, topics: dict[str, Column]) -> DataFrame:
    """(key, scopes): every scope that an entity's events belong to. topics: predicates over the entities' columns, each taken once in the one pass."""
    own = F.array(F.concat(F.lit("bills/"), F.col(key).cast("string")), F.concat(F.lit("jurisdiction/"), F.upper(code)))
    each = [F.when(F.coalesce(p, F.lit(False)), F.array(F.lit(f"topic/{slug}"), F.concat(F.lit(f"topic/{slug}:"), F.upper(code)))).otherwise(F.array().cast("array<string>")) for slug, p in topics.items()]
    return entities.select(key, F.filter(F.concat(own, *each), lambda x: x.isNotNull()).alias("scopes"))


def wanted_scopes(subscriptions: DataFrame) -> DataFrame:
    """subscriptions (subscription, kind, target, cursor, kinds) with `scope`, a row for each record of a list."""
    slug, code = F.substring_index("target", ":", 1), F.upper(F.expr("substring(target, instr(target, ':') + 1)"))
    topic = F.when((F.instr("target", ":") > 0) & (code != ""), F.concat(slug, F.lit(":"), code)).otherwise(slug)
    each = F.when(F.col("kind") == "topic", F.array(F.concat(F.lit("topic/"), topic))).when(F.col("kind") == "jurisdiction", F.array(F.concat(F.lit("jurisdiction/"), F.upper("target"))))
    records = F.transform(F.array_distinct(F.filter(F.transform(F.split("target", ","), lambda x: F.trim(x)), lambda x: x != "")), lambda x: F.concat(F.lit("bills/"), x))
    return subscriptions.withColumn("scope", F.explode(each.when(F.col("kind") == "bills", records)))


def unknown_scopes(subscriptions: DataFrame, codes: DataFrame, topics: Iterable[str]) -> DataFrame:
    """Subscriptions that name a topic or a jurisdiction that there isn't, or no record at all: to be disabled and told so. codes: (code); topics: the known ones."""
    known = codes.select(F.upper("code").alias("_code")).distinct()
    part = F.when(F.col("kind") == "jurisdiction", F.upper("target")).when((F.col("kind") == "topic") & (F.instr("target", ":") > 0), F.upper(F.expr("substring(target, instr(target, ':') + 1)")))
    named = subscriptions.withColumn("_part", F.when(part != "", part)).join(known, F.col("_part") == F.col("_code"), "left")
    slug = F.substring_index("target", ":", 1)
    bad = (F.col("_part").isNotNull() & F.col("_code").isNull()) | ~F.col("kind").isin("topic", "jurisdiction", "bills") | F.col("kind").isNull() | F.col("target").isNull()
    bad = bad | ((F.col("kind") == "topic") & ~slug.isin(*topics)) | ((F.col("kind") == "jurisdiction") & F.col("_part").isNull()) | ((F.col("kind") == "bills") & (F.regexp_replace("target", "[, ]", "") == ""))
    return named.where(bad).select(*subscriptions.columns)


def events_for(log: DataFrame, keyed: DataFrame, key: str, subscriptions: DataFrame, mark: int, width: int = RANGE) -> DataFrame:
    """(subscription, seq, entity_id, kind): each subscription's events of its scopes and kinds, behind its cursor and up to the watermark.

    log: (seq, entity_id, kind, ...), read once, and only behind the least cursor. keyed: scope_keys(). An event that several
    records or scopes of a subscription name comes once. A null kinds or cursor asks for all.
    """
    asked = wanted_scopes(subscriptions).withColumn("cursor", F.coalesce("cursor", F.lit(0)))
    least = asked.agg(F.min("cursor")).first()[0]  # one number
    if least is None or least >= mark:
        return log.limit(0).select(F.lit(None).cast(subscriptions.schema["subscription"].dataType).alias("subscription"), "seq", "entity_id", "kind")
    ranged = asked.where(F.col("cursor") < mark).withColumn("part", F.explode(F.sequence(F.expr(f"(cursor + 1) div {width}"), F.lit(mark // width).cast("bigint"))))
    ranged = ranged.select("subscription", "cursor", F.split(F.when(F.col("kinds") != "", F.col("kinds")), ",").alias("only"), "scope", "part")
    facts = keyed.select(F.col(key).alias("_key"), "scopes")
    recent = log.where((F.col("seq") > least) & (F.col("seq") <= mark)).select("seq", "entity_id", "kind")
    events = recent.join(facts, F.col("entity_id") == F.col("_key")).select("seq", "entity_id", "kind", F.expr(f"seq div {width}").alias("part"), F.explode("scopes").alias("scope"))
    met = events.join(ranged, ["scope", "part"]).where((F.col("seq") > F.col("cursor")) & F.coalesce(F.array_contains("only", F.col("kind")), F.lit(True)))
    return met.select("subscription", "seq", "entity_id", "kind").distinct()
