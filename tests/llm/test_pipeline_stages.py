"""The pipeline's stages against brute force on a small table of awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexlake.llm import toxicity

from test_small import brute_components, line_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    base = [[" ".join(word() for _ in range(14)) for _ in range(3)] for _ in range(10)]
    shared = " ".join(word() for _ in range(20))
    texts = ["\n".join(b) for b in base] + [base[0][0] + " x\n" + "\n".join(base[0][1:]), "\n".join([shared, *base[1]]), "\n".join([shared, "own " * 3])]
    texts += ["vile scum " + "\n".join(b) for b in base[:4]] + [None, "", "  \n ", "one", "\n".join(base[2])]
    docs = [(k, x, "en" if k % 3 else "fr", f"s{k % 4}", len(x or "")) for k, x in enumerate(texts)]
    docs += [(None, "no id here", "en", "s1", 10), (3, "another text of three", None, None, None), docs[4]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    marks = [(k, 1, int("vile" in (x or ""))) for k, x in enumerate(texts)] + [(900, 1, 1), (None, 0, 1)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def row_key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["lang"] or "", r["source"] or "")


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "MinHash near-dedup", "mixing to target weights", "SentencePiece encoding"]
    toxic, lines, near, mixed, encoded = (f for _, f in corpus_pipeline.STAGES)

    clean = toxic(spark, docs, folder)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), keep=toxicity.teaches())
    bad = {row_key(r) for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert clean.columns == docs.columns and sorted(map(row_key, clean.collect())) == sorted(k for k in map(row_key, docs.collect()) if k not in bad)

    # lines, on all documents
    got = sorted(map(row_key, lines(spark, docs, folder).collect()))
    rows, places = docs.collect(), {}
    named = sorted({(r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None})
    for k, (_, x) in enumerate(named):
        places |= {(k, j): line for j, line in enumerate(x.split("\n")) if any(c.isalnum() for c in line)}
    # the first of a doc_id's texts is decided by their hash, so both texts of id 3 are unlike all others
    gone = {p for p, least in line_groups(places).items() if p != least}
    want = []
    for r in rows:
        if r["doc_id"] is None:
            want.append(row_key(r))
            continue
        k = named.index((r["doc_id"], r["text"] or ""))
        left = [line for j, line in enumerate((r["text"] or "").split("\n")) if (k, j) not in gone]
        if not any(p[0] == k for p in gone):
            want.append(row_key(r))
        elif "".join(left).strip():
            want.append(row_key(r.asDict() | {"text": "\n".join(left)}))
    assert got == sorted(want) and len(gone) > 10

    kept = near(spark, docs, folder).collect()
    component = brute_components([(r["doc_id"], r["text"]) for r in rows], 5)
    ids = [r["doc_id"] for r in kept if (r["text"] or "").strip() and r["doc_id"] is not None]
    assert {component[i] for i in ids} == set(component[i] for i in {r["doc_id"] for r in rows if r["doc_id"] is not None and (r["text"] or "").strip()})
    assert ids.count(3) == 2 and ids.count(4) == 1 and all(component[i] == i for i in ids)
    assert sum(1 for r in kept if not (r["text"] or "").strip()) == sum(1 for r in rows if not (r["text"] or "").strip())

    more = mixed(spark, docs, folder)
    assert more.columns == docs.columns and {row_key(r) for r in more.collect()} == {row_key(r) for r in rows}
    out = encoded(spark, docs, folder).collect()
    assert len(out) == len(rows) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in out)


def test_whole_run_and_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r["round_trip"] for r in out)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    extra = docs.withColumns({c: F.lit("own") for c in ("score", "predicted", "dropped", "row", "uid", "rate", "n_tokens", "class", "of", "key")})
    for name, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, extra, folder)
        assert got.columns == extra.columns and {r["rate"] for r in got.collect()} == {"own"}, name
