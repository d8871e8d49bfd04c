"""Validation: a sample of records, the legs that test each, and what their outcomes amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions.strings import page_key

UNVERIFIABLE = "unverifiable"


def sampled(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """A random sample that a seed repeats: the first by a digest of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(size)


def structural_leg(bills: DataFrame, key: str, required: list[str], children: DataFrame, child_key: str) -> DataFrame:
    """(key, outcome, missing): fail where a required column is null or blank, or the record has no child."""
    has = children.select(F.col(child_key).alias("_key")).distinct()
    rows = bills.join(has, bills[key] == has["_key"], "left")
    missing = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required] + [F.when(F.col("_key").isNull(), "children")]
    missing = F.array_join(F.filter(F.array(*missing), lambda x: x.isNotNull()), ",")
    return rows.select(key, missing.alias("missing")).withColumn("outcome", F.when(F.col("missing") == "", "pass").otherwise("fail"))


def result_leg(sample: DataFrame, key: str, results: DataFrame, result_key: str) -> DataFrame:
    """(key, outcome): whether a search for the record finds it."""
    found = results.select(F.col(result_key).alias("_key")).distinct()
    return sample.join(found, sample[key] == found["_key"], "left").select(key, F.when(F.col("_key").isNotNull(), "pass").otherwise("fail").alias("outcome"))


def recorded(sample: DataFrame, key: str, legs: dict[str, DataFrame]) -> DataFrame:
    """(key, leg, outcome) of each leg for each sampled record; what a leg didn't reach is unverifiable."""
    out = None
    for name, leg in legs.items():
        rows = sample.select(key).join(leg.select(key, "outcome"), key, "left").select(key, F.lit(name).alias("leg"), F.coalesce("outcome", F.lit(UNVERIFIABLE)).alias("outcome"))
        out = rows if out is None else out.unionByName(rows)
    return out


def verdicts(legs: DataFrame, key: str, advisory: list[str]) -> DataFrame:
    """(key, verdict): fail if a leg that isn't advisory fails, pass if at least one passes, else unverifiable."""
    counts = legs.where(~F.col("leg").isin(*advisory)).groupBy(key).agg(F.count_if(F.col("outcome") == "fail").alias("_bad"), F.count_if(F.col("outcome") == "pass").alias("_good"))
    verdict = F.when(F.col("_bad") > 0, "fail").when(F.col("_good") > 0, "pass").otherwise(UNVERIFIABLE)
    return counts.select(key, verdict.alias("verdict"))


def details(leg: Column, outcome: Column, **more: Column) -> Column:
    """The nested details of an outcome as JSON."""
    return F.to_json(F.struct(leg.alias("leg"), F.struct(outcome.alias("outcome"), *(c.alias(n) for n, c in more.items())).alias("result")))


# How prefixes are spelled out on pages of official sources.
SPELLED_OUT = {
    "hb": "house bill", "sb": "senate bill", "hr": "house resolution", "sr": "senate resolution", "hjr": "house joint resolution", "sjr": "senate joint resolution",
    "hcr": "house concurrent resolution", "scr": "senate concurrent resolution",
}
#: Words of the longest prefix that is spelled out.
MOST_WORDS = 3


def surface_forms(identifier) -> Column:
    """Array of the forms in which an identifier may stand in a normalised text: joined and spaced, with its whole prefix or the first letter, plain or padded to three or four digits, and spelled out.

    The form `prefix + year/number` stands for two digits of a year put between the two, with zeros before the number. An identifier
    that isn't letters and a number has one form, its letters and digits, which must be a whole word.
    """
    compact = F.regexp_replace(F.lower(F.col(identifier) if isinstance(identifier, str) else identifier), "[^a-z0-9]", "")
    prefix, number = F.regexp_extract(compact, "^([a-z]+)([0-9]+)$", 1), F.regexp_extract(compact, "^([a-z]+)([0-9]+)$", 2)
    letter = F.substring(prefix, 1, 1)
    padded = [F.when(F.length(number) < n, F.lpad(number, n, "0")).otherwise(number) for n in (3, 4)]
    forms = [F.concat(prefix, number), F.concat(prefix, F.lit(" "), number), F.concat(letter, number), F.concat(prefix, F.lit("+year/"), number)]
    forms += [F.concat(p, F.lit(gap), n) for n in padded for p in (letter, prefix) for gap in ("", " ")]
    names = F.create_map(*(F.lit(x) for item in SPELLED_OUT.items() for x in item))
    forms.append(F.concat(F.try_element_at(names, prefix), F.lit(" "), number))
    return F.when(prefix != "", F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull()))).when(compact != "", F.array(compact)).otherwise(F.array().cast("array<string>"))


def surface_candidates(text) -> Column:
    """Array of what in a text could be a form of an identifier, from one pass over it: words and a number behind them, from each of the last words on, with a year in front of the number, and whole words that hold a digit.

    A number's digits are taken whole and a word never begins inside another, so "hb 105" isn't found in "hb 1057" nor in "shb 105".
    """
    key = page_key(text)
    found = F.regexp_extract_all(key, F.lit(rf"(?<![a-z0-9])(?:[a-z]++ ){{0,{MOST_WORDS - 1}}}[a-z]++ ?[0-9]++"), F.lit(0))

    def each(run: Column) -> Column:
        head, number = F.regexp_extract(run, "^(.*?)([0-9]+)$", 1), F.regexp_extract(run, "^(.*?)([0-9]+)$", 2)
        words = F.split(F.rtrim(head), " ")
        gap = F.when(head.endswith(" "), " ").otherwise("")
        names = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.array_join(F.slice(words, k + 1, F.size(words)), " "))
        rest = F.regexp_replace(F.substring(number, F.lit(3), F.length(number)), "^0+(?=[0-9])", "")
        years = F.when((gap == "") & (F.length(number) > 2), F.array(F.concat(F.element_at(words, -1), F.lit("+year/"), rest))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(names, lambda w: F.concat(w, gap, number)), years)

    whole = F.regexp_extract_all(key, F.lit("(?<![a-z0-9])[a-z0-9]*[0-9][a-z0-9]*(?![a-z0-9])"), F.lit(0))
    return F.array_distinct(F.concat(F.flatten(F.transform(found, each)), whole))


def mentions(pages: DataFrame, page: str, text: str, records: DataFrame, key: str, identifier: str) -> DataFrame:
    """(page, key): which pages name which records in any surface form. Each text is read once; forms meet by equality, so neither side is compared with all of the other."""
    seen = pages.select(F.col(page).alias("page"), F.explode(surface_candidates(text)).alias("form"))
    named = records.select(F.col(key).alias("key"), F.explode(surface_forms(identifier)).alias("form"))
    return seen.join(named, "form").select("page", "key").distinct()


def cross_source_leg(sample: DataFrame, key: str, identifier: str, text: str) -> DataFrame:
    """(key, outcome): whether a record's official page names it; unverifiable without one."""
    hit = F.arrays_overlap(surface_forms(identifier), surface_candidates(text))
    return sample.select(key, F.when(F.coalesce(F.trim(text), F.lit("")) == "", UNVERIFIABLE).when(hit, "pass").otherwise("fail").alias("outcome"))
