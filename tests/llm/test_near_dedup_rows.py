"""Near copies without an id or with the same one, and recall at the threshold where nodes have to branch."""

import random

from pyspark.sql import functions as F

from lexlake.llm import graph, near_dedup

from test_small import brute_components, shingle_set


def words(r, n):
    return [f"w{r.randrange(10_000)}" for _ in range(n)]


def test_null_and_repeated_ids(rows):
    r = random.Random(1)
    base, other = words(r, 101), words(r, 60)
    texts = [(5, base), (None, [*base[:-1], "end"]), (None, ["begin", *base]), (7, other), (7, [*other[:-1], "x"]), (7, words(r, 30)), (9, other), (None, words(r, 20)), (None, [])]
    df = rows("doc_id bigint, text string, class string", *((i, " ".join(t), f"row {k}") for k, (i, t) in enumerate(texts)))
    settings = near_dedup.Settings(words=4)
    got = near_dedup.near_duplicates(df.drop("class"), settings).collect()
    assert sorted((x["component_id"] or 0, x["kept"]) for x in got if x["doc_id"] is None) == [(0, True), (0, True), (5, False), (5, False)]
    assert {(x["doc_id"], x["component_id"]) for x in got if x["doc_id"]} == {(5, 5), (7, 7), (9, 7)}
    kept = near_dedup.deduplicate(df, settings)
    assert kept.columns == df.columns
    # one row of each group: two texts of id 7 are in groups of their own
    left = sorted(x["class"] for x in kept.collect())
    assert left[:1] == ["row 0"] and "row 5" in left and "row 7" in left and "row 8" in left and len(left) == 5 and ("row 3" in left) != ("row 4" in left)


def test_recall_at_the_threshold(rows):
    """Documents that all share a passage, so that nodes are large, and pairs of them just above the threshold."""
    r = random.Random(3)
    passage, texts = words(r, 40), []
    while len(texts) < 240:
        a = words(r, 60)
        b = [x if r.random() > 0.035 else f"y{r.randrange(10_000)}" for x in a]
        a, b = [*passage, *a], [*passage, *b]
        s, t = shingle_set(" ".join(a), 4), shingle_set(" ".join(b), 4)
        if 80 <= 100 * len(s & t) / len(s | t) < 90:
            texts += [(len(texts), " ".join(a)), (len(texts) + 1, " ".join(b))]
    want = brute_components(texts, 4)
    assert sum(i != c for i, c in want.items()) >= 120
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(rows("doc_id bigint, text string", *texts), near_dedup.Settings(words=4, node=30)).collect()}
    found = sum(got[i] == c for i, c in want.items() if i != c)
    print("found", found, "of", sum(i != c for i, c in want.items()))
    assert all(got[i] in (i, c) for i, c in want.items()) and found >= 0.97 * sum(i != c for i, c in want.items())


def test_candidates_grow_with_the_copies_alone(rows):
    """A large group of near copies is in all nodes of all trees: an edge for a member, not one for each node."""
    r = random.Random(4)
    base, texts = words(r, 200), []
    for k in range(300):
        own = list(base)
        own[r.randrange(200)] = f"n{k}"
        texts.append((k, " ".join(own)))
    settings = near_dedup.Settings(words=4, node=30)
    df = rows("doc_id bigint, text string", *texts)
    classes = near_dedup.shingled(df, settings).select("class", F.col("signature"))
    edges = near_dedup.candidates(classes, settings)
    assert edges.distinct().count() < 2 * 300
    groups = graph.components(edges).groupBy("component").count().collect()
    assert [g["count"] for g in groups] == [300]
