"""Toxicity: a logistic classifier of hashed words, regularised by swapped identity terms.

Null texts count as empty and get the score of the bias; equal texts get equal scores; repeated labels of a document
count as toxic if one of them is; rows without a label, and documents without one, teach nothing. Without any labelled
row every score is 0. Extra columns of the input pass through `score`, which adds two under names that the caller can choose.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, materialise, text_of

#: Terms that name a group of people; those of one line are swapped for each other (fixed values).
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische", "flüchtlinge"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "immigrés", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "inmigrantes", "refugiados"),
)


@dataclass(frozen=True)
class Settings:
    """max_rows: about so many labelled documents are learnt from, picked by a hash of their id. penalty: weight of a swap's squared change of score."""

    bits: int = 18
    max_rows: int = 20_000
    least_documents: int = 3
    l1: float = 2e-5
    l2: float = 1e-6
    penalty: float = 1.0
    steps: int = 80


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


STRIP = ".,;:!?\"'()[]{}«»„“”‘’…-–—*_#|<>/\\"


def word_features(token: str, bits: int) -> list[int]:
    """Buckets of a token: its word, and the beginnings of it, which inflected and compound words share."""
    from zlib import crc32

    word, mask = token.strip(STRIP), (1 << bits) - 1
    if not word:
        return []
    return [crc32(f"{n}{word[:n] if n else word}".encode()) & mask for n in (0, 4, 5, 6) if len(word) >= n]


def swapped(token: str) -> str | None:
    """The next term of its group, if the token is one."""
    word = token.strip(STRIP)
    return SWAPS.get(word)


SWAPS = {term: group[(k + 1) % len(group)] for group in IDENTITY_GROUPS for k, term in enumerate(group)}


def training_rows(docs: DataFrame, marks: DataFrame, settings: Settings, keep=None) -> DataFrame:
    """(toxic, features, swap, part): buckets of each distinct token, those that swapping all identity terms takes away or adds, as sign * (bucket + 1), and a hash of the row."""
    marks = marks.where("doc_id is not null and toxic is not null")
    marks = marks.where(keep) if keep is not None else marks
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marks.count()
    share = min(1.0, settings.max_rows / max(total, 1))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about max_rows small rows
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.hash("doc_id", "text").alias("part"))
    bits = settings.bits

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            plain, swap = [], []
            for text in batch.column(1).to_pylist():
                tokens = sorted(set(text.lower().split()))
                plain.append([f for t in tokens for f in word_features(t, bits)])
                pairs = [(t, s) for t in tokens if (s := swapped(t))]
                swap.append([-f - 1 for t, _ in pairs for f in word_features(t, bits)] + [f + 1 for _, s in pairs for f in word_features(s, bits)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(plain, pa.list_(pa.int32())), pa.array(swap, pa.list_(pa.int32())), batch.column(2)], ["toxic", "features", "swap", "part"])

    return rows.mapInArrow(run, "toxic int, features array<int>, swap array<int>, part int")


#: Features of one pass of the fit, and about so many that the driver takes from the executors at once; they bound its memory.
PART, FETCH = 1 << 20, 1 << 22


def fetched(rows: DataFrame):
    """The training rows as pyarrow tables of about FETCH features."""
    rows = materialise(rows, "toxicity-rows")
    n = max(1, -(-(rows.agg(F.sum(F.size("features") + F.size("swap"))).first()[0] or 0) // FETCH))
    for k in range(n):
        yield rows.where(F.pmod("part", F.lit(n)) == k).select("toxic", "features", "swap").toArrow()


class Lists:
    """Lists of buckets, in the runs that they came in. A run has its values, one list behind another, and its lists' lengths."""

    def __init__(self):
        self.runs = []

    def add(self, column) -> None:
        """column: an Arrow array of lists."""
        self.runs.append((np.array(column.flatten(), np.int32), np.array(column.value_lengths(), np.int64)))

    def keep(self, held) -> None:
        """Drops the buckets that aren't held, run by run, so that the values are never there twice."""
        for k, (values, n) in enumerate(self.runs):
            own = held[values]
            self.runs[k] = values[own], np.diff(np.append(0, np.cumsum(own))[np.append(0, np.cumsum(n))])

    def passes(self):
        """(first list, end, values, place of each value's list from the first) of some of a run's lists with about PART values."""
        first = 0
        for run, lengths in self.runs:
            starts, at = np.append(0, np.cumsum(lengths)), 0
            while at < len(lengths):
                end = min(len(lengths), max(at + 1, int(np.searchsorted(starts, starts[at] + PART, "right")) - 1))
                yield first + at, first + end, run[starts[at] : starts[end]], np.repeat(np.arange(end - at), lengths[at:end])
                at = end
            first += len(lengths)


def fit(tables, settings: Settings) -> Model:
    """Accelerated proximal gradient over the bounded sample. tables: pyarrow tables of training_rows, one at a time."""
    size = 1 << settings.bits
    features, swap, marks, in_documents = Lists(), Lists(), [], np.zeros(size, np.int64)
    for table in tables:
        marks.append(np.asarray(table["toxic"]).astype(float))
        features.add(table["features"].combine_chunks())
        swap.add(table["swap"].combine_chunks())
        del table
    y = np.concatenate(marks)
    if not len(y):
        return Model(np.zeros(size, np.float32), -np.inf, settings.bits)
    # buckets of few documents say nothing that carries over
    for _, _, values, of in features.passes():
        in_documents += np.bincount(np.unique(of * size + values) % size, minlength=size)
    features.keep(in_documents >= settings.least_documents)
    swaps_of, swap_lengths = (np.concatenate(x) for x in zip(*swap.runs))
    sign, s = np.sign(swaps_of), np.abs(swaps_of) - 1
    of = np.repeat(np.arange(len(y)), swap_lengths)
    swaps = max(len(np.unique(of)), 1)
    w, v, momentum = np.zeros(size), np.zeros(size), 1.0
    bias = bias_v = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    common = sum((np.bincount(x, minlength=size) for _, _, x, _ in features.passes()), np.zeros(size))
    scale = 1 / np.sqrt(1 + common / len(y) * 4)  # common words get smaller steps
    step = 8.0
    loss_before = np.inf
    for _ in range(settings.steps):
        x = scale * v
        g, loss, miss = np.zeros(size), 0.0, 0.0
        for at, end, values, row in features.passes():
            z = np.bincount(row, x[values], end - at) + bias_v
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            loss += float(np.sum(np.logaddexp(0, z) - y[at:end] * z)) / len(y)
            g += np.bincount(values, (p - y[at:end])[row], size)
            miss += float(np.sum(p - y[at:end])) / len(y)
        change = np.bincount(of, sign * x[s], len(y)) if len(s) else np.zeros(len(y))
        loss += float(settings.penalty * np.square(change).sum() / swaps / 2 + settings.l1 * np.abs(v).sum())
        if loss > loss_before * 1.02:  # too long a step
            step, momentum, v, bias_v, loss_before = step / 2, 1.0, w.copy(), bias, np.inf
            continue
        loss_before = loss
        g = scale * g / len(y) + settings.l2 * v
        if len(s):
            g += settings.penalty * scale * np.bincount(s, sign * change[of], size) / swaps
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * settings.l1, 0)
        new_bias = bias_v - min(step, 1.0) * miss
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, bias_v = new + (momentum - 1) / after * (new - w), new_bias + (momentum - 1) / after * (new_bias - bias)
        w, bias, momentum = new, new_bias, after
    return Model((scale * w).astype(np.float32), bias, settings.bits)


def train(docs: DataFrame, marks: DataFrame, settings: Settings = Settings(), keep=None) -> Model:
    """keep: a condition on the rows of marks that may teach."""
    return fit(fetched(training_rows(docs, marks, settings, keep)), settings)


_weights: dict[str, dict[str, float]] = {}
#: Words whose weight a worker holds, and rows that it takes at once; they bound its memory, not results.
CACHE_WORDS, ROWS = 100_000, 256


def score(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5), under the given names. Columns of the input with such a name are replaced; the others pass through."""
    nonzero = np.flatnonzero(model.weights).astype(np.int32)
    packed, bias, bits = (nonzero, model.weights[nonzero]), model.bias, model.bits
    tag = f"{hash((bias, len(nonzero), packed[1].tobytes()))}"

    def run(batches):
        import pyarrow as pa

        weight = dict(zip(packed[0].tolist(), packed[1].tolist()))
        if tag not in _weights:
            _weights.clear()
        known = _weights.setdefault(tag, {})
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, z = batch.slice(at, ROWS), []
                for text in part.column(part.schema.get_field_index(text_col)).to_pylist():
                    total = bias
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    for token in sorted(set((text or "").lower().split())):
                        if (x := known.get(token)) is None:
                            x = known[token] = sum(weight.get(b, 0.0) for b in word_features(token, bits))
                        total += x
                    z.append(total)
                p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -700, 700)))
                p = np.where(np.isneginf(np.array(z, float)), 0.0, p)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*part.schema.names, *names])

    kept = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{names[0]}` double, `{names[1]}` int")


def teaches() -> Column:
    """Whether a label row is outside the held-out fifth."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels whose crc32(doc_id) mod 5 isn't 0."""
    docs = documents(spark, sf_dir)
    model = train(docs, labels(spark, sf_dir), keep=teaches())
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted")
