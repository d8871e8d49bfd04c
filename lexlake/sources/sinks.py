"""What the engine writes: tables parents first, reports, feeds and delivery bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions.dates import iso
from lexlake.functions.digests import signature
from lexlake.functions.strings import xml_safe

from .tables import exists

BODY_BYTES, BODY_EVENTS = 512 * 1024, 100


def write_tables(tables: dict[str, DataFrame], path: str, parents_first: list[str]) -> None:
    for name in [*parents_first, *sorted(set(tables) - set(parents_first))]:
        if name in tables:
            tables[name].write.mode("append").parquet(f"{path}/{name}")


def stage_table(rows: DataFrame, path: str, name: str, load: str) -> None:
    """A table's rows of a load, in a folder of their own that no reader looks at yet; a repeat replaces them."""
    rows.write.mode("overwrite").parquet(f"{path}/{name}/load={load}")


def published(spark: SparkSession, path: str) -> list[str]:
    """The loads that are complete."""
    return sorted(r["load"] for r in spark.read.schema("load string").parquet(f"{path}/_loads").distinct().collect()) if exists(spark, f"{path}/_loads") else []


def write_load(tables: dict[str, DataFrame], path: str, load: str, parents_first: list[str]) -> bool:
    """Writes all tables of a load, or nothing that a reader sees: rows are staged, and one file that names the load comes last.

    A load that is published already is not written again (False). One that was broken off is written anew.
    """
    spark = next(iter(tables.values())).sparkSession
    if load in published(spark, path):
        return False
    for name in [*(n for n in parents_first if n in tables), *sorted(set(tables) - set(parents_first))]:
        stage_table(tables[name], path, name, load)
    spark.createDataFrame([(load,)], "load string").coalesce(1).write.mode("append").parquet(f"{path}/_loads")
    return True


def read_loads(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's rows of all published loads, with `load`."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return rows.withColumn("load", F.col("load").cast("string")).where(F.col("load").isin(published(spark, path)))


def write_report(rows: DataFrame, path: str, sections: dict[str, list[str]]) -> None:
    """JSON objects with columns grouped in sections."""
    rows.select(*(F.struct(*columns).alias(name) for name, columns in sections.items())).write.mode("overwrite").json(path)


def atom_entries(rows: DataFrame, base: str) -> DataFrame:
    """(key, entry, updated): an Atom entry of each change."""
    safe = lambda c: F.replace(F.replace(F.replace(xml_safe(F.col(c)), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.concat(F.lit("<entry><id>"), F.lit(base), F.col("seq").cast("string"), F.lit("</id><title>"), safe("title"), F.lit("</title><updated>"), iso(F.col("changed_at")), F.lit("</updated></entry>"))
    return rows.select("key", "seq", entry.alias("entry"), F.col("changed_at").alias("updated"))


def atom_feeds(entries: DataFrame) -> DataFrame:
    """One document a key; it was updated when its newest change was, whichever row comes first. Keys have bounded numbers of entries (see feed.recent)."""
    body = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("seq", "entry")))), lambda e: e["entry"]), "")
    out = entries.groupBy("key").agg(F.max("updated").alias("updated"), body.alias("body"))
    return out.select("key", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><updated>'), iso(F.col("updated")), F.lit("</updated>"), F.col("body"), F.lit("</feed>")).alias("xml"))


def sitemap(chunks: DataFrame, base: str) -> DataFrame:
    """(chunk, xml) of (id, chunk): a urlset for each chunk of bounded size."""
    urls = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(F.lit(f"<url><loc>{base}"), i.cast("string"), F.lit("</loc></url>"))), "")
    return chunks.groupBy("chunk").agg(F.concat(F.lit("<urlset>"), urls, F.lit("</urlset>")).alias("xml"))


def sitemap_index(chunks: DataFrame, base: str) -> DataFrame:
    """(xml) of (id, chunk): the list of the chunks' sitemaps, which are few."""
    numbers = F.array_sort(F.collect_set("chunk"))
    urls = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit(f"<sitemap><loc>{base}"), n.cast("string"), F.lit(".xml</loc></sitemap>"))), "")
    return chunks.agg(F.concat(F.lit("<sitemapindex>"), urls, F.lit("</sitemapindex>")).alias("xml"))


def digest_html(digests: DataFrame) -> DataFrame:
    """Digests with their lines as an HTML list, and how many others there are."""
    safe = F.replace(F.replace(F.col("body"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    items = F.array_join(F.transform(F.split(safe, "\n"), lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
    rest = F.when(F.col("more") > 0, F.concat(F.lit("<p>and "), F.col("more").cast("string"), F.lit(" more</p>"))).otherwise("")
    return digests.withColumn("html", F.concat(F.lit("<ul>"), items, F.lit("</ul>"), rest))


def delivery_bodies(batches: DataFrame, secret: bytes) -> DataFrame:
    """(subscription, first_seq, body, signature) of batches (subscription, events array): halved until the body fits; a single event too large has none."""
    body = lambda e: F.to_json(F.struct(e.alias("events")))
    sizes = [BODY_EVENTS]
    while sizes[-1] > 1:
        sizes.append(sizes[-1] // 2)
    out: Column = F.lit(None).cast("string")
    for n in reversed(sizes):
        part = F.slice("events", 1, n)
        out = F.when(F.octet_length(body(part)) <= BODY_BYTES, body(part)).otherwise(out)
    rows = batches.withColumn("body", out).withColumn("sent_at", F.element_at("events", 1)["seq"].cast("string"))
    return rows.select("subscription", F.element_at("events", 1)["seq"].alias("first_seq"), "body", signature("body", "sent_at", secret).alias("signature"))


def telemetry(rows: DataFrame, path: str) -> None:
    short = [F.substring(c, 1, 80).alias(c) for c in ("tool", "outcome", "error_code", "client_family")]
    rows.select("occurred_at", *short, "duration_ms").write.mode("append").parquet(path)
