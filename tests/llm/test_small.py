"""The ten operators on small tables: nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlake.llm import fingerprints, line_dedup, lm_scoring, matroska, mixing, near_dedup, pieces, token_counts, token_output, toxicity
from lexlake.llm.graph import components

P = pytest.importorskip("public_tokenizers")
BPE, SPM = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LONG = " ".join(f"word{k % 997}" for k in range(9000))
TEXTS = [
    (1, "the cat sat on the mat and looked at the dog for a while\nshared line of several words here"), (2, "the cat sat on the mat and looked at the dog for a while\nshared line of several words here"),
    (3, "the cat sat on the mat and looked at the dog for a while\nshared line of several words here now"), (4, None), (5, ""), (6, "  \n\n \t"), (7, "one"), (8, LONG), (8, LONG), (None, "no id here"), (9, LONG + " end"),
    (10, "Ünïcode 日本語 text\nshared line of several words here"), (11, "shared line of several words here!"), (12, "a  b   c\r\n\td<|endoftext|>e f"),
]


@pytest.fixture
def docs(rows):
    return rows("doc_id bigint, text string", *TEXTS).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("own"), "ids": F.lit("own"), "rate": F.lit(0), "part": F.lit("own")})


@pytest.fixture
def empty(docs):
    return docs.where("doc_id = -1")


def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_token_output(spark, docs, empty, tmp_path):
    for layout in (token_output.TokenFileFormat(), token_output.TokenFileFormat("delta", row_group_bytes=1 << 16)):
        path = str(tmp_path / layout.encoding)
        token_output.write_token_files(docs, path, BPE, layout)
        got = [tuple(r) for r in token_output.token_index(spark, path).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
        want, start, t = [], 0, bpe()
        for i, x in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = t.encode(x or "", add_special_tokens=False).ids + [0]
            want.append((i, start, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids))))
            start += len(ids)
        assert got == want
        assert token_output.read_token_files(spark, path, ("doc_id",)).columns == ["doc_id"]
    import glob

    import pyarrow.parquet as pq

    meta = pq.read_metadata(glob.glob(str(tmp_path / "delta/*.parquet"))[0]).row_group(0).column(2)
    assert meta.has_offset_index and meta.has_column_index and any("DELTA" in e for e in meta.encodings)
    token_output.write_token_files(empty, str(tmp_path / "none"), BPE)
    assert token_output.token_index(spark, str(tmp_path / "none")).count() == 0


def test_token_counts(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/flat"
    order = token_counts.write_flat_files(docs, path, BPE)
    files = order.groupBy("file").agg(F.max("n_ids").alias("n_ids"))
    t = bpe()
    t.encode_special_tokens = True
    for block in (7, 1000, 1 << 20):
        counts = token_counts.count_tokens(files, path, block_ids=block)
        got = order.join(counts, ["file", "place"]).select("doc_id", "n_tokens").collect()
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        want = [(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS]
        assert sorted(((r[0], r[1]) for r in got), key=key) == sorted(want, key=key)
    order = token_counts.write_flat_files(empty, f"file://{tmp_path}/none", BPE)
    assert token_counts.count_tokens(order.groupBy("file").agg(F.max("n_ids").alias("n_ids")), f"file://{tmp_path}/none").count() == 0


def test_token_counts_over_files(rows, tmp_path):
    """Documents that cross files, and ids behind the last end."""
    import numpy as np

    end = token_counts.END_ID
    ids = [1, 2, end, 3, 4, 5, 6, 7, end, end, 8, 9]
    for k, part in enumerate((ids[:5], ids[5:7], ids[7:])):
        np.array(part, "<u2").tofile(tmp_path / f"{k}.bin")
    files = rows("file string, n_ids bigint", ("0.bin", 5), ("1.bin", 2), ("2.bin", 5))
    for block in (1, 2, 3, 100):
        got = token_counts.count_tokens(files, str(tmp_path), block_ids=block).orderBy("ordinal").select("ordinal", "start", "n_tokens", "closed").collect()
        assert [tuple(r) for r in got] == [(0, 0, 2, True), (1, 3, 5, True), (2, 9, 0, True), (3, 10, 2, False)]


def test_matroska_store(docs, empty):
    got = matroska.payload_digests(matroska.media_columns(matroska.store_texts(docs))).collect()
    assert len(got) == len(TEXTS)
    for r, (i, x) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))):
        raw = (x or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert matroska.media_columns(matroska.store_texts(empty)).count() == 0


def test_matroska_lacing_and_defects(rows):
    m = matroska
    frames = [b"a" * 300, b"b" * 20, b"", b"c" * 700]
    laced = [m.element(m.SIMPLE_BLOCK, m.block(2, -3, frames, k)) for k in (m.XIPH_LACING, m.EBML_LACING)]
    fixed = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(1, 4, [b"xy", b"zw"], m.FIXED_LACING)))
    unknown = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + m.uint(m.CLUSTER_TIMESTAMP, 10)
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm"))
    segment = b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff"
    data = head + segment + unknown + b"".join(laced) + m.element(m.CLUSTER, m.uint(m.CLUSTER_TIMESTAMP, 50) + fixed)
    media = m.parse(data)
    assert media.error is None and media.clusters == 2 and media.doc_type == "webm"
    assert [data[p[3] : p[3] + p[4]] for p in media.packets] == frames + frames + [b"xy", b"zw"]
    assert media.packets[0][:3] == (2, 7_000_000, 0) and media.packets[-1][1] == 54_000_000 and media.packets[-1][5] == "fixed"
    whole = m.pcm_file(bytes(range(256)) * 400)
    good = m.parse(whole)
    assert b"".join(whole[p[3] : p[3] + p[4]] for p in good.packets) == bytes(range(256)) * 400
    assert all(whole[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in good.cues) and len(good.cues) == good.clusters == 2
    df = rows("media binary, packets string", (None, "own"), (b"", "own"), (b"junk", "own"), (whole[:-5000], "own"))
    got = m.media_columns(df).collect()
    assert [len(r["packets"]) for r in got[:3]] == [0, 0, 0] and got[2]["error"] and got[3]["error"]


def shingle_set(x, w):
    t = (x or "").encode().lower().split()
    return {tuple(t[k : k + w]) for k in range(max(len(t) - w + 1, 1))} if t else set()


def brute_components(texts, w, percent=80):
    ids = sorted({i for i, _ in texts if i is not None})
    sets = [(i, shingle_set(x, w)) for i, x in texts]
    up = {i: i for i in ids}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("settings", [near_dedup.Settings(words=4), near_dedup.Settings(words=4, node=2)])
def test_near_dedup(docs, empty, settings):
    want = brute_components(TEXTS, 4)
    got = near_dedup.near_duplicates(docs, settings).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"])
    kept = [r["doc_id"] for r in near_dedup.deduplicate(docs, settings).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(i for i, c in want.items() if i == c) and kept.count(None) == 1
    assert near_dedup.near_duplicates(empty, settings).count() == 0


def test_near_dedup_families(rows):
    """Families of near copies, larger than a node, with links of every similarity about the threshold."""
    import random

    r = random.Random(5)
    texts = []
    for f in range(6):
        base = [f"w{r.randrange(400)}" for _ in range(60)]
        for _ in range(25):
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(60)] = f"x{r.randrange(9)}"
            texts.append((len(texts), " ".join(t)))
    df = rows("doc_id bigint, text string", *texts)
    want = brute_components(texts, 4)
    for node in (256, 6):
        assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(df, near_dedup.Settings(words=4, node=node)).collect()} == want


def test_components(rows):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (100, 95), (7, 7), (None, 1)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["component"] for r in components(rows("a bigint, b bigint", *edges)).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 95: 90, 100: 90} | {k: 500 for k in range(500, 540)}
    assert components(rows("a bigint, b bigint")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def test_line_dedup(docs, empty, rows):
    gone = {r["doc_id"]: r["dropped"] for r in line_dedup.dropped_lines(docs).collect()}
    assert gone[2] == [0, 1] and gone[3][0] == 0 and 1 in gone[10] and gone[11] == [0] and 1 not in gone and 8 not in gone
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(docs).collect()}
    assert 2 not in out and 11 not in out and out[10] == "Ünïcode 日本語 text" and out[1] == TEXTS[0][1] and out[4] is None and out[6] == "  \n\n \t" and out[None] == "no id here"
    assert line_dedup.deduplicate_lines(docs).columns == docs.columns
    assert line_dedup.dropped_lines(empty).count() == 0


def near_lines(a, b):
    """The definition, by brute force: lengths, then the shortest edit of words, or that of characters if three fifths of the words are left."""
    most = lambda x, y: int(max(len(x), len(y)) * 0.2 + 1e-9)
    words = edit_distance(a.split(), b.split())
    if abs(len(a) - len(b)) > most(a, b) or words > max(len(a.split()), len(b.split())) * 2 // 5:
        return False
    return words <= most(a.split(), b.split()) or edit_distance(a, b) <= most(a, b)


def line_groups(lines):
    """{place: smallest place} of connected near lines. lines: {place: text}"""
    norm = {k: re.sub("[^a-z0-9]+", " ", x.lower()).strip() for k, x in lines.items()}
    up = {k: k for k in lines}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in lines:
        for b in lines:
            if a < b and find(a) != find(b) and near_lines(norm[a], norm[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in lines}


def test_line_dedup_fuzzy(rows):
    import random

    r = random.Random(3)
    texts = []
    for f in range(4):
        base = [f"{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{r.randrange(50)}" for _ in range(60)]
        for _ in range(8):
            t = list(base)
            for _ in range(r.randrange(5)):
                t[r.randrange(60)] = "zz"
            texts.append((len(texts), "\n".join([" ".join(t), f"own line {len(texts)} of {r.random()}"])))
    groups = line_groups({(i, k): line for i, x in texts for k, line in enumerate(x.split("\n"))})
    want = {}
    for (i, k), least in groups.items():
        if least != (i, k):
            want.setdefault(i, []).append(k)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.dropped_lines(rows("doc_id bigint, text string", *texts)).collect()}
    assert got == {i: sorted(k) for i, k in want.items()} and len(want) > 20


def test_line_dedup_rows(rows):
    """Rows that repeat an id but not the text are documents of their own; columns may have any names."""
    line = "one line of several words that occurs more than once"
    df = rows("doc_id bigint, text string, dropped string, row int, `left` int, n_chars bigint", (2, line + "\nonly here", "a", 1, 2, 3), (2, "quite another text of the same id", "b", 1, 2, 3), (1, line, "c", 1, 2, 3), (None, line, "d", 1, 2, 3), (3, line.upper() + "!", "e", 1, 2, 3))
    out = line_dedup.deduplicate_lines(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["dropped"], r["n_chars"]) for r in out.collect()) == [(0, line, "d", 3), (1, line, "c", 3), (2, "only here", "a", 9), (2, "quite another text of the same id", "b", 3)]


def test_lm_scoring(docs, empty):
    trains = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    for settings in (lm_scoring.Settings(1), lm_scoring.Settings(2, 5.0, 0.0), lm_scoring.Settings(3), lm_scoring.Settings(3, 2.0, 0.5, block_bytes=20_000), lm_scoring.Settings(4, block_bytes=100)):
        order = settings.order
        got = lm_scoring.score(docs, trains, settings).collect()
        tok = lambda x: (x or "").encode().lower().split() + [b""]
        counts, context, n = Counter(), Counter(), 0
        for i, x in TEXTS:
            if i is not None and i % 2 == 1:
                t = tok(x)
                n += len(t)
                for k in range(len(t)):
                    for m in range(order):
                        h = tuple(t[j] if j >= 0 else None for j in range(k - m, k))
                        counts[(*h, t[k])] += 1
                        context[h] += 1
        v = sum(1 for g in counts if len(g) == 1)

        def p(h, w, counts=counts, context=context, n=n, v=v):
            if not h:
                return (counts[(w,)] + 1) / (n + v + 1)
            strength = settings.pseudo_count(context[h])
            return (counts[(*h, w)] + strength * p(h[1:], w)) / (context[h] + strength)

        want = sorted((i or -1, len(tok(x)), round(sum(math.log10(p(tuple((tok(x)[j] if j >= 0 else None) for j in range(k - order + 1, k)), w)) for k, w in enumerate(tok(x))), 6)) for i, x in TEXTS)
        assert sorted((r["doc_id"] or -1, r["n_tokens"], round(r["score"], 6)) for r in got) == want and {r["train_tokens"] for r in got} == {n}
    assert lm_scoring.score(empty, trains).count() == 0


def test_pieces(docs, empty, rows):
    m = pieces.pieces(SPM)
    for settings in (pieces.Settings(), pieces.Settings(giant=20, chunk=40, fan=3)):
        got = pieces.decode(pieces.encode(docs, SPM, settings), SPM).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            assert r["decoded"] == (r["text"] or "")
            import numpy as np

            best = m.library.encode(m.normalised(r["text"] or "").replace(pieces.SPACE, " "))
            assert abs(m.total(np.array(r["ids"], int)) - m.total(np.array(best, int))) < 1e-6
            assert r["ids"] == best  # ties and all, however the text is cut
    assert pieces.encode(empty, SPM).count() == 0
    clash = docs.withColumns({"uid": F.lit("own"), "chunk": F.lit(1), "row": F.lit("own")})
    assert {r["uid"] for r in pieces.encode(clash, SPM, pieces.Settings(giant=20, chunk=40, fan=3)).collect()} == {"own"}
    block = "x" * 3000  # no cut at all
    a, b = (pieces.encode(rows("doc_id bigint, text string", (1, block)), SPM, s).first() for s in (pieces.Settings(), pieces.Settings(giant=100, chunk=64, fan=4)))
    assert b["chunks"] > 40 and a["ids"] == b["ids"] and m.decode(b["ids"]) == block


CELLS = re.compile(r"[^.,;:!?\n]{1,64}[.,;:!?\n]*|[.,;:!?\n]+")


def test_fingerprints(spark, docs, empty):
    got = fingerprints.with_next(docs).collect()
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    order.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = sorted((str(a), b or "", c or "") for (a, b), (_, c) in zip(order, order[1:] + order[:1]))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got) == want
    assert fingerprints.with_next(empty).count() == 0
    f = fingerprints
    df = spark.createDataFrame([(x or "", y or "") for _, x in TEXTS for _, y in TEXTS[::3]], "a string, b string").select("a", "b", F.expr(f.sketch(f.digests("a"))).alias("x"), F.expr(f.sketch(f.digests("b"))).alias("y"))
    df = df.select("a", "b", "x", "y", F.expr(f.as_string("x")).alias("f"), F.expr(f.as_string("y")).alias("g"))
    # of the sketches, and of nothing but the strings
    df = df.select("*", F.expr(f.likeness("x", "y")).alias("by_sketch")).select("*", F.expr(f.from_string("f")).alias("p"), F.expr(f.from_string("g")).alias("q"))
    for r in df.select("a", "b", "f", "g", "by_sketch", F.expr(f.likeness("p", "q")).alias("by_string")).collect():
        a, b = set(CELLS.findall(r["a"])), set(CELLS.findall(r["b"]))
        true = len(a & b) / len(a | b) if a | b else 1
        assert r["by_sketch"] == r["by_string"] and abs(r["by_sketch"] - true) < (1e-9 if len(a ^ b) < 8 else 0.3)
        assert (r["f"] == r["g"]) == (a == b)


def test_fingerprint_query(spark):
    """The registered query against its contract, and likeness from the returned fingerprints alone."""
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    texts = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()), reverse=True)
    out = fingerprints.op9_fingerprints(spark, d)
    f = fingerprints
    own = out.select("doc_id", F.expr(f.from_string("fingerprint")).alias("p"), F.expr(f.from_string("edited_fingerprint")).alias("q")).select("doc_id", F.expr(f.likeness("p", "q")).alias("again"))
    got = {r["doc_id"]: r for r in out.join(own, "doc_id").collect()}
    assert len(got) == len(texts)
    off = []
    for (i, x), (_, after) in zip(texts, texts[1:] + texts[:1]):
        k = len(x) // 3
        edited = x[: len(x) - k] + after[:k]
        assert got[i]["n_chars"] == len(x) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, seen in ((edited, got[i]["near_edited"]), (after, got[i]["near_next"])):
            a, b = set(CELLS.findall(x)), set(CELLS.findall(other))
            true = len(a & b) / len(a | b) if a | b else 1
            assert abs(seen - true) < 1e-9
            if other is edited:
                off.append(abs(got[i]["again"] - true))
    # fingerprints alone: exact where all strata peel, else an estimate
    assert sum(off) / len(off) < 0.05 and sum(x < 1e-9 for x in off) > len(off) // 4


def test_peeling_needs_larger_sketches(spark):
    """A small sketch gets stuck on many differing digests, and a larger one recovers exactly those."""
    df = spark.createDataFrame([(list(range(k, k + 400)), list(range(k + 150, k + 520))) for k in range(0, 3000, 1000)], "a array<bigint>, b array<bigint>").select(*(F.transform(c, lambda x: F.shiftrightunsigned(F.xxhash64(x), 32)).alias(c) for c in "ab"))
    small, large = (df.select("a", "b", F.expr(fingerprints.difference("a", "b", s)).alias("d")).collect() for s in (64, 1 << 28))
    assert all(r["d"] is None for r in small)
    exact = df.select("a", "b", F.expr(fingerprints.remaining("a", "b", "1")).alias("m")).collect()  # however wrong the first size is
    assert [r["m"] for r in exact] == [len(set(r["a"]) ^ set(r["b"])) for r in exact]
    for r in large:
        assert {(x["c"], x["k"]) for x in r["d"]} == {(1, k) for k in set(r["a"]) - set(r["b"])} | {(-1, k) for k in set(r["b"]) - set(r["a"])}


def test_mixing(rows, docs, empty):
    import numpy as np

    texts = [(k, " ".join(np.random.default_rng(k).choice(["uno", "dos", "tres", "ya"] if k % 4 == 0 else ["one", "two", "three", "yes"], 5 + k % 11))) for k in range(120)] + [(500, None), (501, " "), (None, "one dos")]
    df = rows("doc_id bigint, text string", *texts)
    labelled = df.where("doc_id < 60").withColumn("domain", F.when(F.col("doc_id") % 4 == 0, "es").otherwise("en"))
    for least in (0.0, 1.0):
        settings = mixing.Settings(least_rate=least, targets={"en": 0.5, "es": 0.5})
        out, fit, model = mixing.mix(df, labelled, settings)
        got = out.toPandas()
        assert len(got) == len(texts) and (got.rate >= least).all()
        p, t = got[["p_en", "p_es"]].to_numpy(), got.n_tokens.to_numpy()
        assert np.allclose(p.sum(1), 1)
        # the same problem, by plain projected gradient with many steps
        w, want = np.ones(len(t)), np.array([fit.wanted["en"], fit.wanted["es"]])
        step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
        for _ in range(4000):
            w = np.maximum(least, w - step * p @ (p.T @ (w * t) - want))
        loss = lambda w: np.square(p.T @ (w * t) - want).sum() / np.square(want).sum()
        assert loss(got.rate.to_numpy()) <= loss(w) + 1e-6
        copies = mixing.repeated(df, model, fit, settings)
        assert copies.columns == df.columns and (least == 0 or copies.select("doc_id").distinct().count() == df.select("doc_id").distinct().count())
    none = mixing.mix(empty, labelled, mixing.Settings(targets={"en": 1.0}))[0]
    assert none.count() == 0
    assert mixing.mix(docs, labelled, mixing.Settings(targets={"en": 1.0}))[0].count() == len(TEXTS)


def test_toxicity(rows, docs, empty):
    import random

    r = random.Random(1)
    texts, marks = [], []
    for k in range(400):
        words = [f"w{r.randrange(200)}" for _ in range(30)]
        if k % 5 == 0:
            words[r.randrange(30)] = r.choice(["vileness", "vilest", "scumbag"])
            if k % 10 == 0:
                words[3] = "women"
        texts.append((k, " ".join(words)))
        marks.append((k, int(k % 5 == 0)))
    df, labels = rows("doc_id bigint, text string", *texts), rows("doc_id bigint, toxic int", *marks, (None, 1), (3, None), (5, 1))
    fair, plain = (toxicity.train(df, labels, toxicity.Settings(penalty=p)) for p in (3.0, 0.0))
    got = toxicity.score(df, fair).collect()
    assert sum(x["predicted"] == m[1] for x, m in zip(sorted(got), marks)) > 390
    probe = rows("doc_id bigint, text string", (1, "women w1 w2"), (2, "men w1 w2"), (3, None), (4, ""))
    gap = lambda m: (lambda s: abs(math.log(s[1] / (1 - s[1])) - math.log(s[2] / (1 - s[2]))))({x["doc_id"]: x["score"] for x in toxicity.score(probe, m).collect()})
    assert gap(fair) < 0.5 * gap(plain)
    assert {x["score"] for x in toxicity.score(rows("doc_id bigint, text string", (3, None), (4, "")), fair).collect()}.__len__() == 1
    out = toxicity.score(docs, fair)
    assert out.count() == len(TEXTS) and out.columns.count("score") == 1
    assert toxicity.score(empty, fair).count() == 0
    untaught = toxicity.score(probe, toxicity.train(df, labels.where("doc_id = -5")))
    assert {x["score"] for x in untaught.collect()} == {0.0}


def test_pipeline(spark, tmp_path):
    import os

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    out = corpus_pipeline.run(spark, d).collect()
    ids = {r["doc_id"] for r in out}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    assert out and all(r["round_trip"] for r in out) and len(ids & toxic) <= 0.2 * len(toxic)


def edited_lines(r, n_words, kind, share):
    """A line of random words and a copy, edited in about that share of its words or characters."""
    line = [f"{''.join(chr(97 + r.randrange(26)) for _ in range(r.randrange(2, 10)))}" for _ in range(n_words)]
    a = " ".join(line)
    if kind == "words":
        for k in r.sample(range(n_words), max(1, round(n_words * share))):
            line[k] = "".join(chr(97 + r.randrange(26)) for _ in range(len(line[k])))
        return a, " ".join(line)
    b = list(a)
    for k in r.sample(range(len(b)), max(1, round(len(b) * share))):
        b[k] = r.choice(["", b[k] + chr(97 + r.randrange(26)), chr(97 + r.randrange(26))])
    return a, " ".join("".join(b).split())


@pytest.mark.parametrize("kind, lo, hi, least", [("words", 0.0, 0.1, 0.98), ("words", 0.1, 0.25, 0.95), ("characters", 0.0, 0.03, 0.95), ("characters", 0.03, 0.06, 0.65), ("characters", 0.06, 0.1, 0.2)])
def test_line_dedup_recall(rows, kind, lo, hi, least):
    """Lines of 10 to 50 words that have the edit similarity by characters, without any other bound, against how many are found. Edits of scattered characters touch many words and cost more."""
    import random

    r, texts = random.Random(11), []
    while len(texts) < 400:
        a, b = edited_lines(r, r.randrange(10, 51), kind, r.uniform(lo, hi))
        if a != b and edit_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
            texts += [(len(texts), a), (len(texts) + 1, b)]
    gone = {x["doc_id"] for x in line_dedup.dropped_lines(rows("doc_id bigint, text string", *texts)).collect()}
    print(kind, lo, hi, len(gone), len(texts) // 2)
    assert all(k % 2 for k in gone) and len(gone) >= least * len(texts) / 2
