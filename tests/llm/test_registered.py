"""The registered queries of operators 1 to 8 on a small folder, with their contracts' columns and types, against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"word{k % 997}" for k in range(6000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " end"), (4, None), (5, ""), (6, " \n\n \t"), (7, "one"), (8, LONG), (8, LONG), (9, LONG + " end"), (10, "Ünïcode 日本語 text\nand ñandú"), (11, "The cat sat"), (12, "the CAT\tsat"),
    (13, "quite another text of several words that nobody else has written down so far"), (14, "a\x00b"), (15, "x" * 63), (16, "x" * 64),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("registered")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, x, ("en", "de", "fr", "es")[(i or 0) % 4], "s", len(x or "")) for i, x in TEXTS]
    marks = [(i, i % 2, i % 3 % 2) for i in range(1, 17)]
    for name, docs, labels in (("full", rows, marks), ("none", [], [])):
        clash = {c: F.lit("own") for c in ("ids", "start", "block", "part", "rate", "trains", "key", "file")}
        spark.createDataFrame(docs, schema).withColumns(clash).write.parquet(f"file://{root}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{root}/{name}/labels.parquet")
    return f"file://{root}/full", f"file://{root}/none"


def typed(df, **types):
    found = dict(df.dtypes)
    assert {c: found[c] for c in types} == types
    return sorted(df.select(*types).collect(), key=lambda r: (r["doc_id"], *map(str, r)))


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 9)])
def test_every_row_once_and_empty_tables(spark, folders, name):
    query = next(q for n, q in QUERIES.items() if n.startswith(name))
    assert Counter(r["doc_id"] for r in query(spark, folders[0]).collect()) == Counter(i for i, _ in TEXTS)
    assert query(spark, folders[1]).count() == 0


def test_op1(spark, folders):
    df = QUERIES["op1_mixing"](spark, folders[0])
    shares = [c for c in df.columns if c.startswith("p_")]
    got = df.collect()
    assert all(abs(sum(r[c] for c in shares) - 1) < 1e-9 and r["rate"] >= 0 for r in got) and len({r["rate"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_op2(spark, folders):
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for i, x in sorted(TEXTS, key=lambda r: r[0]):
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = typed(QUERIES["op2_token_output"](spark, folders[0]), doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    assert sorted(map(tuple, got)) == sorted(want)


def test_op3(spark, folders):
    got = {r["doc_id"]: r for r in QUERIES["op3_line_dedup"](spark, folders[0]).collect()}
    assert got[1]["n_dropped"] == 0 and got[2]["dropped"] == [0] and got[3]["dropped"] == [0] and got[13]["n_dropped"] == 0
    assert all(r["n_lines"] == (dict(TEXTS)[i] or "").count("\n") + 1 for i, r in got.items())


def test_op4(spark, folders):
    types = dict(doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    got = typed(QUERIES["op4_media_columns"](spark, folders[0]), **types)
    by_text = {}
    for r, (i, x) in zip(got, sorted(TEXTS, key=lambda r: r[0])):
        raw = (x or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert by_text.setdefault(payload, tuple(r)[4:]) == tuple(r)[4:] and r["media_bytes"] > len(payload)


def test_op5(spark, folders):
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    import re

    def shingles(x):
        words = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(lower))
        return {tuple(words[k : k + 4]) for k in range(len(words) - 3)} or ({tuple(words)} if words else set())

    sets = [(i, shingles(x)) for i, x in TEXTS]
    least = {k: i for k, (i, _) in enumerate(sets)}
    for _ in sets:
        for a, (_, s) in enumerate(sets):
            for b, (_, t) in enumerate(sets):
                if s and t and 100 * len(s & t) >= 80 * len(s | t):
                    least[a] = min(least[a], least[b])
    want = sorted((i, len(s), least[k], i == least[k]) for k, (i, s) in enumerate(sets))
    got = typed(QUERIES["op5_near_dedup"](spark, folders[0]), doc_id="bigint", n_shingles="bigint", component_id="bigint", kept="boolean")
    assert sorted(map(tuple, got)) == want and want[2][2] == 1


def test_op6(spark, folders):
    types = dict(doc_id="bigint", held_out="boolean", n_tokens="bigint", n_known="bigint", train_tokens="bigint", base_score="double", score="double")
    got = typed(QUERIES["op6_lm_scoring"](spark, folders[0]), **types)
    tokens = lambda x: (x or "").encode().lower().split() + [b""]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in TEXTS}
    counts = Counter(t for i, x in TEXTS if not held[i] for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for r, (i, x) in zip(got, sorted(TEXTS, key=lambda r: r[0])):
        t = tokens(x)
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9) and r["score"] < 0
    assert any(held.values())


def test_op7(spark, folders):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = QUERIES["op7_token_counts"](spark, folders[0]).select("doc_id", "n_tokens").collect()
    want = Counter((i, len(tokenizer.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS)
    assert Counter(map(tuple, got)) == want  # without the end


def test_op8(spark, folders):
    got = QUERIES["op8_sentencepiece"](spark, folders[0]).collect()
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got) and len({tuple(r["ids"]) for r in got if r["doc_id"] in (1, 2)}) == 1
