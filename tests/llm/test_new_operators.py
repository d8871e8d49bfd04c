"""Packing, token alignment and ranked search against brute force, on small tables and on the registered queries."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexlake.llm import packing, ranking, token_alignment

P = pytest.importorskip("public_tokenizers")
BPE, SPM = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LONG = " ".join(f"word{k % 997}" for k in range(9000))
TEXTS = [
    (1, "The cat sat on the mat, and looked at the dog."), (2, "The cat sat on the mat, and looked at the dog."), (3, "the CAT sat\nagain on a mat-like dog's bed 42"), (4, None), (5, ""), (6, "  \n\n \t"), (7, "one"),
    (8, LONG), (8, LONG), (None, "no id here: the cat"), (9, LONG + " end"), (10, "Ünïcode 日本語 text and ñandú"), (11, "a\x00b cat\x00"), (12, "a  b   c\r\n\td<|endoftext|>e f</s>"), (13, "odd ▁ bar cat"),
    (14, " led"), (15, "tail "), (16, "\nnew"), (17, "=" * 300 + "🙂🙂 " + "-" * 77), (18, "x\n y\n\nz"),
]


@pytest.fixture
def docs(rows):
    return rows("doc_id bigint, text string", *TEXTS).withColumns({c: F.lit("own") for c in ("ids", "start", "length", "block", "shard", "term", "item", "score", "n_a")})


@pytest.fixture
def folder(docs, rows, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/in/documents.parquet")
    rows("item_id bigint, text string", (1, "the cat, the DOG"), (2, None), (3, ""), (4, "nothing-of-this-xyz"), (None, "word1 word2 mat"), (5, "日本語 cat"), (5, "42 one"), (1, "the cat, the DOG")).write.parquet(f"file://{tmp_path}/in/benchmark.parquet")
    return f"file://{tmp_path}/in"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs, folder, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    want = []
    for i, x in TEXTS:
        ids, at = [*t.encode(x or "", add_special_tokens=False).ids, 1], 0
        while at < len(ids):
            n = min(2048, 1 << ((len(ids) - at).bit_length() - 1))
            want.append((i, at, n, crc(ids[at : at + n]), len(ids)))
            at += n
    got = packing.op12_packing(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = got.collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    path = str(tmp_path / "sequences")
    packing.write_sequences(docs.coalesce(1), path, BPE, settings=packing.Settings(longest=64))
    bucket = packing.read_sequences(spark, path, 64).collect()
    assert bucket and all(len(r["ids"]) == r["length"] == 64 for r in bucket)
    meta = [pq.read_table(os.path.join(path, f))["length"].to_pylist() for f in os.listdir(path) if f.endswith(".parquet")]
    assert all(x == sorted(x, reverse=True) for x in meta)  # a bucket is a run of rows
    packing.write_sequences(docs.where("doc_id = -1"), path + "0", BPE)
    assert packing.read_sequences(spark, path + "0").count() == 0
    with pytest.raises(ValueError):
        packing.Settings(longest=1000)


def brute_alignment(texts):
    import json

    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=SPM)
    a.encode_special_tokens = True
    names = {i: s for s, i in json.load(open(BPE))["model"]["vocab"].items()}
    # which byte a character of the vocabulary stands for, from the library itself
    letters, alphabet = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for c in [*range(2000), *range(0x800, 0xD800, 61), *range(0x10000, 0x110000, 4001), *range(0x10000, 0x10100)]:
        alphabet |= zip(letters.pre_tokenize_str(chr(c))[0][0], chr(c).encode())
    a_bytes = lambda k: bytes(alphabet[c] for c in names[k])
    b_bytes = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    out, held = [], Counter()
    for x in texts:
        led = (" " + (x or "")).encode()
        ia, ib = (a.encode(" " + x, add_special_tokens=False).ids, b.encode(x)) if x else ([], [])
        if not x or b"".join(map(a_bytes, ia)) != led or b"".join(map(b_bytes, ib)) != led:
            out.append(([], Counter()))
            continue
        ends = []
        for ids, f in ((ia, a_bytes), (ib, b_bytes)):
            at, mine = 0, []
            for k in ids:
                at += len(f(k))
                mine.append(at)
            ends.append(mine)
        cuts = {e: k for k, e in enumerate(sorted(set(ends[0]) & set(ends[1])))}
        parts = [([], []) for _ in cuts]
        for side, (ids, own) in enumerate(zip((ia, ib), ends)):
            at = 0
            for k, e in zip(ids, own):
                parts[at][side].append(k)
                at = cuts[e] + 1 if e in cuts else at
        links = Counter((p, q) for g in parts for p in g[0] for q in g[1])
        out.append((parts, links))
        held.update(links.keys())
    best = {}
    for (p, _), n in held.items():
        best[p] = max(best.get(p, 0), n)
    digest = lambda parts: hashlib.sha256(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in parts).encode()).hexdigest() if parts else ""
    return [(sum(len(g[0]) for g in p), sum(len(g[1]) for g in p), len(p), sum(n.values()), sum(m for k, m in n.items() if held[k] == best[k[0]]), sum(m * held[k] for k, m in n.items()), digest(p)) for p, n in out]


def test_token_alignment(spark, docs, folder, monkeypatch):
    texts = [(i, x if x is None or len(x) < 5000 else x[:5000]) for i, x in TEXTS]
    want = Counter((i, *r) for (i, _), r in zip(texts, brute_alignment([x for _, x in texts])))
    cut = docs.withColumn("text", F.substring("text", 1, 5000))
    for settings in (token_alignment.Settings(), token_alignment.Settings(block_bytes=6000, align_bytes=500)):
        got = token_alignment.align(cut, BPE, SPM, settings).drop("n_overlaps")
        assert Counter(map(tuple, got.collect())) == want
    got = token_alignment.op11_token_alignment(spark, folder)
    assert got.dtypes[:8] == [*((c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    assert got.count() == len(TEXTS)
    assert token_alignment.align(docs.where("doc_id = -1"), BPE, SPM).count() == 0
    assert token_alignment.align(docs.select(F.col("doc_id").cast("string"), "text"), BPE, SPM).where("doc_id = '7' and n_a > 0").count() == 1


def test_alignment_counts_large_groups_by_their_ids(monkeypatch):
    """Groups above the bound give the pairs that plain pairing gives."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 280)
    of_a, of_b = np.sort(np.append(rng.integers(0, 5, 295), np.arange(5))), np.sort(np.append(rng.integers(0, 5, 275), np.arange(5)))
    docs = np.array([0, 0, 1, 3, 3])
    want = token_alignment.linked(a, b, of_a, of_b, docs, 100)
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 50)
    got = token_alignment.linked(a, b, of_a, of_b, docs, 100)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and want[1].sum() == sum((of_a == g).sum() * (of_b == g).sum() for g in range(5))


def brute_ranking(texts, items, most=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (x or "").translate(lower))
    own = [(i, Counter(terms(x))) for i, x in texts]
    n, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, x in items:
        scored = []
        for i, c in own:
            m = 100 - 90 + (90 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(x)) if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(item, k, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(scored)[:most], 1)]
    return out


def test_ranking(spark, docs, folder):
    items = [(1, "the cat, the DOG"), (2, None), (3, ""), (4, "nothing-of-this-xyz"), (None, "word1 word2 mat"), (5, "日本語 cat"), (5, "42 one")]
    want = Counter(brute_ranking(TEXTS, items))
    got = ranking.op13_ranking(spark, folder)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == want
    asked = spark.read.parquet(f"{folder}/benchmark.parquet")
    small = ranking.Settings(most=3, shard_bytes=200, batch_terms=4, first_range=1, last_range=2)
    assert Counter(map(tuple, ranking.ranked(ranking.index(docs, small), asked, small).collect())) == Counter(brute_ranking(TEXTS, items, 3))
    assert ranking.ranked(ranking.index(docs.where("doc_id = -1")), asked).count() == 0
    assert ranking.ranked(ranking.index(docs), asked.where("item_id = -1")).count() == 0
    assert ranking.ranked(ranking.index(docs.select(F.col("doc_id").cast("string"), "text")), asked).count() == sum(want.values())


def test_max_score_reads_less_than_everything():
    """Random lists: the best are those of full scoring, and long lists of light terms are only probed."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(20, 400, 20_000)
    part = 10 + 90 * lengths // int(lengths.mean())
    terms, total = [], 0
    for df, weight in ((19_000, 3), (15_000, 20), (9_000, 700), (300, 4_000), (150, 4_800)):
        docs = np.sort(rng.choice(20_000, df, replace=False)).astype(np.int32)
        tf = rng.integers(1, 6, df).astype(np.int32)
        bound = weight * (1_000_000_000 * int(tf.max()) // (1000 * int(tf.max()) + 8 * int(part[docs].min())))
        terms.append(ranking.Postings(docs, tf, weight, bound))
        total += df
    full = np.zeros(20_000, np.int64)
    for t in terms:
        full[t.docs] += t.weight * (1_000_000_000 * t.occurrences.astype("i8") // (1000 * t.occurrences.astype("i8") + 8 * part[t.docs]))
    seen = []
    docs, scores = ranking.best_of_shard(terms, part, 10, seen=seen)
    best = np.lexsort((np.arange(20_000), -full))[:10]
    assert docs.tolist() == best.tolist() and scores.tolist() == full[best].tolist()
    assert sum(seen) < total / 4


def test_terms_of_slices():
    texts = pa.array(["zero One", "", "two,THREE…3", "Ärger"]).slice(1)
    found, counts = ranking.terms_in(texts)
    assert found.to_pylist() == ["two", "three…3", "Ärger"] and counts.tolist() == [0, 2, 1]


def test_a_blocks_pairs_take_few_bytes():
    """Pairs and links of a block are held in as few bytes as they need, part by part."""
    import numpy as np
    import pyarrow as pa

    aligner = token_alignment.aligner_of(BPE, SPM)
    texts = pa.array(["some words here", "", "more words, and more"] * 20)
    facts, counts, pairs, links = token_alignment.aligned_by_parts(aligner, texts, 100)
    assert len(pairs) > 1 and {x.dtype.itemsize for x in pairs} == {4} and max(x.dtype.itemsize for x in links) == 1
    whole, keys, many = token_alignment.aligned(aligner, texts)
    assert np.array_equal(np.concatenate(pairs), keys & ((1 << 40) - 1)) and np.array_equal(np.concatenate(links), many)
    assert np.array_equal(counts, np.bincount(keys >> 40, minlength=60)) and np.array_equal(facts["n_links"], whole["n_links"])
