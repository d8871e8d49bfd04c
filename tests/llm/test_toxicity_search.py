"""The toxicity classifier against a plain search over dense arrays, and the registered query's rules."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.llm import toxicity


def test_fit_and_scores(rows):
    r = random.Random(7)
    texts = [(k, " ".join([f"w{r.randrange(25)}" for _ in range(12)] + (["vile"] if k % 3 == 0 else []) + (["women"] if k % 4 == 0 else []))) for k in range(80)] + [(80, None), (81, "")]
    marks = [(k, int(k % 3 == 0)) for k in range(82)]
    settings = toxicity.Settings(bits=10, l1=1e-3, steps=400)
    model = toxicity.train(rows("doc_id bigint, text string", *texts), rows("doc_id bigint, toxic int", *marks), settings)
    size, y = 1 << settings.bits, np.array([m for _, m in marks], float)
    x, swaps = np.zeros((len(texts), size)), np.zeros((len(texts), size))
    for k, (_, text) in enumerate(texts):
        for t in set((text or "").lower().split()):
            for f in toxicity.word_features(t, settings.bits):
                x[k, f] += 1
            if other := toxicity.swapped(t):
                for f in toxicity.word_features(t, settings.bits):
                    swaps[k, f] -= 1
                for f in toxicity.word_features(other, settings.bits):
                    swaps[k, f] += 1
    held = (x > 0).sum(0) >= settings.least_documents
    n_swaps = max(int(np.abs(swaps).any(1).sum()), 1)
    x = x * held
    # steps are scaled by how common a feature is, and so is what the penalty on weights counts
    scale = 1 / np.sqrt(1 + x.sum(0) / len(y) * 4)
    z_x, z_s = x * scale, swaps * scale

    def objective(v, bias):
        z = z_x @ v + bias
        return float(np.mean(np.logaddexp(0, z) - y * z) + settings.penalty * np.square(z_s @ v).sum() / n_swaps / 2 + settings.l1 * np.abs(v).sum() + settings.l2 * np.square(v).sum() / 2)

    v, bias = np.zeros(size), 0.0
    for _ in range(6000):  # plain proximal gradient with short steps
        p = 1 / (1 + np.exp(-(z_x @ v + bias)))
        g = z_x.T @ (p - y) / len(y) + settings.penalty * z_s.T @ (z_s @ v) / n_swaps + settings.l2 * v
        v = v - 0.5 * g
        v = np.sign(v) * np.maximum(np.abs(v) - 0.5 * settings.l1, 0)
        bias -= 0.5 * float(np.mean(p - y))
    assert objective(model.weights / scale, model.bias) <= objective(v, bias) + 2e-3
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows("doc_id bigint, text string", *texts), model).collect()}
    for k, (i, text) in enumerate(texts):
        total = model.bias + sum(float(model.weights[f]) for t in set((text or "").lower().split()) for f in toxicity.word_features(t, settings.bits))
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-6


def test_driver_takes_rows_part_by_part(rows, monkeypatch):
    monkeypatch.setattr(toxicity, "FETCH", 400)
    r = random.Random(3)
    texts = rows("doc_id bigint, text string", *((k, " ".join(f"word{r.randrange(40)}" for _ in range(20)) if k % 7 else None) for k in range(60)))
    marks = rows("doc_id bigint, toxic int", *((k, k % 2) for k in range(60)))
    settings = toxicity.Settings(bits=10)
    tables = list(toxicity.fetched(toxicity.training_rows(texts, marks, settings)))
    assert len(tables) > 3 and sum(t.num_rows for t in tables) == 60 and max(t.num_rows for t in tables) < 30
    parts = toxicity.train(texts, marks, settings)
    monkeypatch.setattr(toxicity, "FETCH", 1 << 30)
    whole = toxicity.train(texts, marks, settings)
    assert np.abs(whole.weights).max() > 0.1 and np.abs(parts.weights - whole.weights).max() < 1e-6 and abs(parts.bias - whole.bias) < 1e-6


def test_names(rows):
    df = rows("doc_id bigint, text string, score string", (1, "a", "own"))
    model = toxicity.train(df, rows("doc_id bigint, toxic int"))
    out = toxicity.score(df, model, names=("x", "y"))
    assert out.columns == ["doc_id", "text", "score", "x", "y"] and out.first()["score"] == "own"


def test_registered_query(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    got = toxicity.op10_toxicity(spark, d).collect()
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").where(F.col("toxic").isNotNull()).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.9 * len(held)
