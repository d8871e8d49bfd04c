"""Blocks of many lines: every link between two of their lines counts, as in brute force."""

import random

from lexlake.llm import line_dedup

SETTINGS = line_dedup.Settings()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    bound = lambda x, y: int(max(len(x), len(y)) * 0.2 + 1e-9)
    if abs(len(a) - len(b)) > bound(a, b):
        return False
    p, q = a.split(" "), b.split(" ")
    d = distance(p, q)
    return d <= bound(p, q) or (d <= max(len(p), len(q)) * 2 // 5 and distance(a, b) <= bound(a, b))


def test_crowded_blocks_lose_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE", 16, raising=False)  # several tiles
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(5, 10)))
    shared, texts = [word() for _ in range(12)], []
    for _ in range(60):
        own = [word() for _ in range(14)]
        texts.append(" ".join(shared + own))
        for k in r.sample(range(14), 5):
            own[k] = word()
        texts.append(" ".join(shared + own))
    docs = rows("doc_id bigint, text string", *enumerate(texts))
    sketches = {x["doc_id"]: set(x["sketch"]) for x in line_dedup.lines_of(docs).collect()}
    group = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sketches[a] & sketches[b]) >= 2 and near(texts[a], texts[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    want = {k for k, g in enumerate(group) if k != g}
    got = {x["doc_id"] for x in line_dedup.dropped_lines(docs).collect()}
    assert len(want) >= 40 and got == want


def test_two_lines_are_compared_once(spark, rows, monkeypatch):
    """Lines whose sketches are equal share 15 blocks; counting their edits is dear, so one of the blocks does it."""
    from pyspark.sql import functions as F

    kept = {}
    real = line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: kept.setdefault(name, real(df, name)))
    texts = rows("line bigint, norm string, codes string", *((k, f"{'abcdefgh'[k] * 30} x", "".join(chr(0x1000 + 8 * k + i) for i in range(10))) for k in range(6)))
    blocks = rows("block bigint, line bigint, n int, place int", *((b, k, 32, k + 1) for b in range(15) for k in range(6)))
    groups = rows("node bigint, component bigint", (0, 0))
    met = line_dedup.links_left(blocks, groups, texts, SETTINGS)
    assert met.count() == 0
    crowds = kept["line-crowds"]
    assert crowds.where(F.size("blocks") == 15).count() == 90
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min(array_intersect(" in plan and plan.index("array_min(") < plan.index("levenshtein(")


def test_lines_of_other_words_are_told_before_edits_are_counted(spark, rows, monkeypatch):
    """Distinct words that only one line has bound the edits of words, so most unlike lines of a block need no count of edits; no link is lost by it."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    lines = [[word() for _ in range(20)] for _ in range(3)]
    for k in range(3):  # 4, 8 and 9 of 20 words are others; repeated words
        lines += [lines[k][:at] + [word() for _ in range(n)] + lines[k][at + n :] for at, n in ((3, 4), (5, 8), (6, 9))] + [lines[k][:10] + lines[k][:10]]
    norms = [" ".join(x) for x in lines]
    texts = rows("line bigint, norm string", *enumerate(norms)).selectExpr("line", "norm", f"{line_dedup.word_codes('norm')} as codes")
    order = sorted(range(len(norms)), key=lambda k: (len(norms[k]), k))
    blocks = rows("block bigint, line bigint, n int, place int", *((1, k, len(norms[k]), place) for place, k in enumerate(order, 1)))
    met = line_dedup.links_left(blocks, rows("node bigint, component bigint", (99, 99)), texts, SETTINGS)
    want = {(a, b) for b in range(len(norms)) for a in range(b) if near(norms[a], norms[b])}
    assert len(want) >= 3 and {(x["a"], x["b"]) for x in met.collect()} == want
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_intersect(words") < plan.index("levenshtein(")
