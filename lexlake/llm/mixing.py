"""Mixing documents to target weights of domains, in DataFrame operations only.

A document belongs to every domain in part: a naive Bayes model over hashed words, learnt from labelled rows, gives
posteriors. Projected gradient descent finds document rates, none below a least rate, such that the expected tokens of
each domain, sum of rate * tokens * posterior, come as close as possible to the targets in least squares. A step needs
one sum for each domain over all documents; a document's rate follows from its posteriors and the steps' gradients
alone, so no state but those few numbers passes through the driver.

Null and blank texts have no tokens, get the domains' shares as posteriors and take part with weight zero. Rows with
null or repeated ids get a rate each. An empty table has no rows. Domains without labelled rows have posterior zero.
Columns of the input named like the operator's own are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, materialise, text_of

#: Target shares of the registered query and of the pipeline.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


@dataclass(frozen=True)
class Settings:
    """max_rows: about so many labelled documents teach, picked by a hash of their id. least_rate: 0 lets documents go, 1 keeps each and repeats some."""

    buckets: int = 4096
    max_rows: int = 20_000
    least_rate: float = 0.0
    steps: int = 48
    tolerance: float = 1e-4
    targets: dict = field(default_factory=lambda: dict(TARGETS))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def learn(labelled: DataFrame, settings: Settings) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Shares of the domains and log-probabilities of word buckets in each. labelled: (doc_id, text, domain)."""
    domains = sorted(settings.targets)
    labelled = labelled.where(F.col("domain").isin(domains))
    share = min(1.0, settings.max_rows / max(labelled.count(), 1))
    rows = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    words = rows.select("domain", F.explode(words_of(text_of())).alias("w"))
    counts = words.groupBy("domain", F.pmod(F.xxhash64("w"), F.lit(settings.buckets)).cast("int").alias("b")).count().collect()  # domains * buckets numbers
    table = {d: [0.5] * settings.buckets for d in domains}
    for d, b, n in counts:
        table[d][b] += n
    totals = {d: sum(table[d]) for d in domains}
    seen = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    shares = {d: seen.get(d, 0) / max(sum(seen.values()), 1) for d in domains}
    return shares, {d: [math.log(x / totals[d]) for x in table[d]] for d in domains}


def posteriors(docs: DataFrame, model, settings: Settings) -> DataFrame:
    """docs with n_tokens and a column p_<domain> for each domain. The evidence of n words counts as that of sqrt(n): words of a text depend on each other."""
    shares, logs = model
    domains = sorted(settings.targets)
    own = ["n_tokens", "_buckets", *(f"p_{d}" for d in domains), *(f"_s_{d}" for d in domains)]
    buckets = F.transform(words_of(text_of()), lambda w: F.pmod(F.xxhash64(w), F.lit(settings.buckets)).cast("int"))
    out = docs.drop(*own).withColumn("_buckets", buckets).withColumn("n_tokens", F.size("_buckets").cast("long"))

    def evidence(d: str) -> Column:
        table = F.lit(logs[d])
        total = F.aggregate("_buckets", F.lit(0.0), lambda a, b: a + F.get(table, b))
        prior = math.log(shares[d]) if shares[d] else -math.inf
        return total / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1))) + F.lit(prior)

    sums = {d: evidence(d) for d in domains}
    out = out.withColumns({f"_s_{d}": s for d, s in sums.items()}).withColumn("_most", F.greatest(*(F.col(f"_s_{d}") for d in domains), F.lit(-1e300), F.lit(-1e300)))
    out = out.withColumns({f"_s_{d}": F.exp(F.col(f"_s_{d}") - F.col("_most")) for d in domains})
    total = sum((F.col(f"_s_{d}") for d in domains), F.lit(0.0))
    out = out.withColumns({f"p_{d}": F.when(total > 0, F.col(f"_s_{d}") / total).otherwise(0.0) for d in domains})
    return out.drop("_buckets", "_most", *(f"_s_{d}" for d in domains))


@dataclass(frozen=True)
class Fit:
    """gradients: of each step, already times its length, and the step's momentum. expected: tokens of each domain at the rates found; wanted: the targets."""

    least_rate: float
    gradients: list[tuple[dict[str, float], float]]
    expected: dict[str, float]
    wanted: dict[str, float]


def stepped(rows: DataFrame, gradients, least_rate: float) -> DataFrame:
    """rows, with _x and _y moved along the gradients: a projected step from _y, then momentum."""
    for g, momentum in gradients:
        move = sum((F.col(f"p_{d}") * F.lit(float(v)) for d, v in g.items()), F.lit(0.0))
        rows = rows.withColumn("_new", F.greatest(F.lit(float(least_rate)), F.col("_y") - move))
        rows = rows.withColumn("_y", F.col("_new") + F.lit(momentum) * (F.col("_new") - F.col("_x"))).drop("_x").withColumnRenamed("_new", "_x")
    return rows


def fit(rows: DataFrame, settings: Settings) -> Fit:
    """Accelerated projected gradient from rate 1, in the metric of the documents' tokens. rows: (n_tokens, p_<domain>...), stored."""
    import numpy as np

    domains = sorted(settings.targets)
    t = F.col("n_tokens")
    pairs = [(a, b) for a in domains for b in domains if a <= b]
    sums = rows.agg(*(F.sum(t * F.col(f"p_{d}")).alias(f"n_{d}") for d in domains), *(F.sum(t * F.col(f"p_{a}") * F.col(f"p_{b}")).alias(f"m_{a}_{b}") for a, b in pairs)).first()
    natural = {d: sums[f"n_{d}"] or 0.0 for d in domains}
    whole, shares = sum(natural.values()), {d: settings.targets[d] / sum(settings.targets.values()) for d in domains}
    if not whole:
        return Fit(settings.least_rate, [], natural, natural)
    # with a least rate, the targets are as small as they can be for no domain to have too many tokens
    scale = max([natural[d] * settings.least_rate / shares[d] for d in domains if shares[d]] + [whole if settings.least_rate < 1 else 0.0])
    wanted = {d: shares[d] * scale for d in domains}
    m = np.array([[sums[f"m_{min(a, b)}_{max(a, b)}"] for b in domains] for a in domains])
    step = 1 / float(np.linalg.eigvalsh(m)[-1])
    state = rows.select("n_tokens", *(f"p_{d}" for d in domains), F.lit(1.0).alias("_x"), F.lit(1.0).alias("_y"))
    gradients, recent, k = [], [], 1.0
    expected = natural
    for _ in range(settings.steps):
        now = stepped(state, recent, settings.least_rate)
        at = now.agg(*(F.sum(t * F.col(f"p_{d}") * F.col("_y")).alias(d) for d in domains), *(F.sum(t * F.col(f"p_{d}") * F.col("_x")).alias(f"x_{d}") for d in domains)).first()
        expected = {d: at[f"x_{d}"] for d in domains}
        if max(abs(expected[d] - wanted[d]) for d in domains) <= settings.tolerance * scale:
            break
        after = (1 + math.sqrt(1 + 4 * k * k)) / 2
        g = ({d: step * (at[d] - wanted[d]) for d in domains}, (k - 1) / after)
        k = after
        gradients.append(g)
        recent.append(g)
        if len(recent) == 8:  # short plans: the state goes to the shared folder now and then
            state, recent = materialise(stepped(state, recent, settings.least_rate), "rates"), []
    return Fit(settings.least_rate, gradients, expected, wanted)


def with_rates(rows: DataFrame, found: Fit) -> DataFrame:
    """rows with their posteriors, and the rate that the steps lead to."""
    out = stepped(rows.withColumn("_x", F.lit(1.0)).withColumn("_y", F.lit(1.0)), found.gradients, found.least_rate)
    return out.withColumn("rate", F.col("_x")).drop("_x", "_y")


def labelled_rows(docs: DataFrame, marks: DataFrame, domain_col: str = "lang") -> DataFrame:
    """Documents that the labelled table has, with their domain."""
    ids = marks.where("doc_id is not null").select("doc_id").distinct()
    return docs.where(F.col(domain_col).isNotNull()).select("doc_id", "text", F.col(domain_col).alias("domain")).join(ids, "doc_id", "left_semi")


def mix(docs: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, Fit, tuple]:
    """(docs without text, with n_tokens, p_<domain> and rate; the fit; the classifier)."""
    model = learn(labelled, settings)
    rows = materialise(posteriors(docs, model, settings).drop("text"), "posteriors")
    found = fit(rows, settings)
    return with_rates(rows, found), found, model


def repeated(docs: DataFrame, model, found: Fit, settings: Settings) -> DataFrame:
    """docs, each as often as its rate says: the whole part, and one more if a hash of the row falls below the fraction. No join and no shuffle: rates follow from the texts."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text")  # no column can clash
    rates = with_rates(posteriors(rows, model, settings), found)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rates.select("_row", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's posteriors and rate for the target shares of languages."""
    docs = documents(spark, sf_dir)
    rows, _, _ = mix(docs.select("doc_id", "text"), labelled_rows(docs, labels(spark, sf_dir)))
    return rows.select("doc_id", "n_tokens", *(f"p_{d}" for d in sorted(TARGETS)), "rate")
