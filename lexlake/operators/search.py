"""Queries, scans of texts, trigram likeness and what a search page needs; stored postings are in postings.py."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import capped

def tokens(text) -> Column:
    """The simple analyser: lower case, runs of ASCII letters and digits."""
    x = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")


@dataclass
class Query:
    """Alternatives; each has terms and phrases that must occur and terms that mustn't."""

    alternatives: list[dict[str, list]] = field(default_factory=list)


def parse_query(text: str) -> Query:
    """Words and "phrases" that all must match, -words that mustn't, and or between alternatives."""
    query = Query([{"must": [], "phrases": [], "not": []}])
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            query.alternatives.append({"must": [], "phrases": [], "not": []})
            continue
        terms = [t for t in re.split("[^a-z0-9]+", (phrase or word).lower()) if t]
        now = query.alternatives[-1]
        if minus:
            now["not"] += terms
        elif phrase and len(terms) > 1:
            now["phrases"].append(terms)
        else:
            now["must"] += terms
    query.alternatives = [a for a in query.alternatives if a["must"] or a["phrases"]]
    return query


def matches(terms: Column, query: Query) -> Column:
    out = F.lit(False)
    for a in query.alternatives:
        one = F.lit(True)
        for t in a["must"]:
            one = one & F.array_contains(terms, t)
        for p in a["phrases"]:
            one = one & F.contains(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")), F.lit(f" {' '.join(p)} "))
        for t in a["not"]:
            one = one & ~F.array_contains(terms, t)
        out = out | one
    return out


def rank(terms: Column, query: Query) -> Column:
    """Occurrences of the query's terms for each thousand tokens, in whole numbers."""
    wanted = sorted({t for a in query.alternatives for t in [*a["must"], *(x for p in a["phrases"] for x in p)]})
    hits = F.size(F.filter(terms, lambda t: t.isin(*wanted)))
    return F.expr("1").cast("long") * F.floor(hits * 1000 / F.greatest(F.size(terms), F.lit(1))).cast("long")


def search(rows: DataFrame, text: str, query: str, cap: int, key: str = "id", analyser=tokens) -> DataFrame:
    """(key, rank, saturated): matches, capped in key order before they are ranked; one row more than the cap says whether that cut any."""
    parsed = parse_query(query)
    analysed = rows.select(key, analyser(text).alias("_terms")).where(matches(F.col("_terms"), parsed))
    hits = analysed.select(key, rank(F.col("_terms"), parsed).alias("rank"))
    return capped(hits, [F.asc(key)], cap)


def postings(rows: DataFrame, key: str, text: str, analyser=tokens) -> DataFrame:
    """(term, key, tf): to be stored bucketed by term, so that a query reads its own terms only."""
    return rows.select(key, F.explode(analyser(text)).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def branches(parts: list[tuple[DataFrame, int]], key: str, cap: int | None = None) -> DataFrame:
    """(key, rank, total): several branches' hits, the best rank of each key, and how many keys there are. parts: (rows (key, rank), weight). cap: where the caller wants one, most hits of a branch, the first by key before they are ranked."""
    cut = lambda rows: rows if cap is None else rows.orderBy(key).limit(cap)
    best = union_best([cut(rows).select(key, (F.col("rank") * weight).alias("rank")) for rows, weight in parts], key)
    return best.join(F.broadcast(best.agg(F.count("*").alias("total"))), F.lit(True))  # one row


def union_best(parts: list[DataFrame], key: str, score: str = "rank") -> DataFrame:
    """The best score of each key over several branches."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.max(score).alias(score))


def trigrams(text) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one behind."""
    per_word = F.transform(tokens(text), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) + 1), lambda i: F.substring(F.concat(F.lit("  "), t, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(per_word))


def similarity_ppm(a: Column, b: Column) -> Column:
    """Shared over all trigrams, in millionths."""
    return F.floor(F.size(F.array_intersect(a, b)).cast("long") * 1_000_000 / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).cast("long")


def similar_to(rows: DataFrame, text: str, wanted: str, least_ppm: int) -> DataFrame:
    """rows with similarity to a text strictly above a threshold."""
    own = trigrams(F.lit(wanted))
    return rows.withColumn("similarity", similarity_ppm(trigrams(text), own)).where(F.col("similarity") > least_ppm)


def similar_pairs(rows: DataFrame, key: str, text: str, least_ppm: int) -> DataFrame:
    """(a, b, similarity) of distinct texts above a threshold. Texts meet by a prefix of their rarest trigrams, not by all pairs."""
    distinct = rows.groupBy(F.col(text).alias("text")).agg(F.min(key).alias("key")).select("key", trigrams("text").alias("t"))
    each = distinct.select("key", F.explode("t").alias("g"))
    common = each.groupBy("g").agg(F.count("*").alias("n"))
    ordered = each.join(common, "g").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
    keep = F.size("o") - F.ceil(F.size("o") * least_ppm / 1_000_000).cast("int") + 1
    prefix = ordered.select("key", F.explode(F.slice("o", F.lit(1), keep)).alias("p")).select("key", "p.g")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    ta, tb = distinct.select(F.col("key").alias("a"), F.col("t").alias("ta")), distinct.select(F.col("key").alias("b"), F.col("t").alias("tb"))
    return met.join(ta, "a").join(tb, "b").select("a", "b", similarity_ppm(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") > least_ppm)


def number_lookup(rows: DataFrame, identifier: Column, wanted: Column | str, normal) -> DataFrame:
    """rows whose normalised identifier is that of the wanted one. normal: a function of columns."""
    return rows.where(normal(identifier) == normal(F.lit(wanted) if isinstance(wanted, str) else wanted))


def tiered(tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first tier that has any, with its name: number, then words, then likeness. Later tiers run only if those before are empty; the last is taken as it is."""
    for name, rows in tiers[:-1]:
        if not rows.isEmpty():
            return rows.withColumn("tier", F.lit(name))
    return tiers[-1][1].withColumn("tier", F.lit(tiers[-1][0]))


def capped_candidates(rows: DataFrame, key: str, order: list[Column], cap: int, session: str) -> DataFrame:
    """The first `cap` matches by key, then ranked among themselves, with whether that left any out and whether they are ambiguous: of several sessions, or cut."""
    first = rows.orderBy(key).limit(cap + 1)
    kept = first.orderBy(key).limit(cap)
    facts = first.agg((F.count("*") > cap).alias("truncated"), (F.count_distinct(session) > 1).alias("_several"))
    out = kept.join(F.broadcast(facts), F.lit(True))  # facts are one row
    return out.withColumn("ambiguous", F.col("truncated") | F.col("_several")).drop("_several").orderBy(*order, key)


def saturation_notice(saturated: Column, sort: Column, cap: int) -> Column:
    """What a reader is told of a capped result; null if it wasn't capped."""
    by_date = sort.isin("introduced", "latest_action")
    text = F.when(by_date, F.lit(f"More than {cap} records match; these are the newest.")).otherwise(F.lit(f"More than {cap} records match; only the first {cap} were ranked."))
    return F.when(saturated, text)


def segments(text: str, marks: tuple[str, str] = ("⟦H⟧", "⟦/H⟧")) -> Column:
    """A headline as an array of (text, marked), without empty parts."""
    opened = F.split(F.col(text), marks[0], -1)
    parts = F.flatten(F.transform(opened, lambda x, i: F.transform(F.split(x, marks[1], -1), lambda y, j: F.struct(y.alias("text"), ((i > 0) & (j == 0) & x.contains(marks[1])).alias("marked")))))
    return F.filter(parts, lambda p: p["text"] != "")
