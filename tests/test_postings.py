"""Stored postings: analysis, phrases, blocks, caps, segments, ranks and fragments, against plain Python over the texts."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lexlake.functions import english
from lexlake.operators import postings, search

# The sample vocabulary with stems that was published with the stemmer.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()

WORDS = "the tax on water and fields was raised by an act of taxes raising new waters in old field".split()
TEXTS = [(k, " ".join(WORDS[(k * 7 + j * j) % len(WORDS)] for j in range(k % 23)), " ".join(WORDS[(k + j * 3) % len(WORDS)] for j in range(1 + k % 9))) for k in range(300)] + [(300, None, "tax"), (301, "", None)]


def words(text):
    return [t for t in re.split("[^a-z0-9]+", (text or "").lower()) if t]


def test_published_stems():
    assert {w: english.stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    assert len(english.STOP_WORDS) == 127 and english.lexeme("the") is None and english.lexeme("hopping") == "hop"
    assert [english.stem(w) for w in ("relational", "geology", "dying", "news", "by", "agreed", "controlling", "sensational", "")] == ["relat", "geolog", "die", "news", "by", "agre", "control", "sensat", ""]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = spark.createDataFrame(TEXTS, "id bigint, title string, body string").repartition(3)
    path = "file://" + str(tmp_path_factory.mktemp("index"))
    return {a: postings.build(spark, rows, "id", ["title", "body"], f"{path}/{a}", postings.Layout(4, 16, a)) for a in ("simple", "english")}


def brute(query, texts=TEXTS, lexeme=lambda w: w):
    parsed, out = search.parse_query(query), {}
    for k, *fields in texts:
        own = [[lexeme(w) for w in words(f)] for f in fields]
        has = lambda t: any(lexeme(t) in f for f in own)
        run = lambda p: any(all(lexeme(w) is None or f[i + j] == lexeme(w) for j, w in enumerate(p)) for f in own for i in range(len(f) - len(p) + 1))
        for a in parsed.alternatives:
            must, phrases = [t for t in a["must"] if lexeme(t)], [p for p in a["phrases"] if any(map(lexeme, p))]
            if (must or phrases) and all(map(has, must)) and all(map(run, phrases)) and not any(lexeme(t) and has(t) for t in a["not"]):
                out[k] = own
    return out


@pytest.mark.parametrize("query", ["tax", "tax water -old", '"the tax"', '"tax on" or fields -act', '"water and fields" or "new waters"', "missing", "", "-tax", 'tax "missing words"'])
def test_matches(made, query):
    assert sorted(r["key"] for r in postings.matches(made["simple"], query).collect()) == sorted(brute(query))


@pytest.mark.parametrize("query", ["taxes", "raised -field", '"raising a new water"', "the and of", "taxed or acts"])
def test_english(made, query):
    want = brute(query, lexeme=english.lexeme)
    if '"' not in query:  # plain Python above doesn't let a stop word at a phrase's edge stand for nothing
        assert sorted(r["key"] for r in postings.matches(made["english"], query).collect()) == sorted(want)
    else:
        assert {r["key"] for r in postings.matches(made["english"], query).collect()} >= set(want)


def test_caps(made):
    want = sorted(brute("tax"))
    for cap, blocks in ((5, 1), (len(want), 2), (len(want) - 1, 1), (1000, 1)):
        got = postings.first_matches(made["simple"], "tax", cap, blocks).collect()
        assert sorted(r["key"] for r in got) == want[:cap] and {r["saturated"] for r in got} == {len(want) > cap}
    assert postings.first_matches(made["simple"], "missing", 5).count() == 0


def test_only_the_terms_blocks_are_read(spark, made):
    """The scan is of the term's folders and row groups; a conjunction's heads leave blocks out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = made["simple"].rows(["tax"])
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        text = df._jdf.queryExecution().toString()
        assert "PartitionFilters" in text and "In(term" in text or "EqualTo(term,tax)" in text
        leaf = plan.collectLeaves().head()
        files = leaf.metrics().apply("numFiles").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert files == 1  # of one bucket of four
    query = postings.analysed_query("act old", made["simple"].layout)
    every = made["simple"].heads(["act", "old"]).select("segment", "block").distinct().count()
    own = postings.candidates(made["simple"], query)
    assert own.count() <= every and "/data" not in " ".join(own.inputFiles()) and "/heads" in own.inputFiles()[0]


def brute_scores(query, texts, weights):
    own = {k: [words(f) for f in fields] for k, *fields in texts}
    n, total = len(own), sum(len(f) for fs in own.values() for f in fs)
    terms = {t for a in search.parse_query(query).alternatives for t in a["must"]}
    df = {t: sum(any(t in f for f in fs) for fs in own.values()) for t in terms}
    out = {}
    for k in brute(query, texts):
        length, score = sum(map(len, own[k])), 0
        for t in terms:
            tf = sum(w * f.count(t) for w, f in zip(weights, own[k]))
            if tf:
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((2200000 * tf) // (1000 * tf + 300 + (900 * length * n) // total))
        out[k] = score
    return out


def test_bm25_and_segments(spark, made):
    index = made["simple"]
    score = lambda i, q: {r["key"]: r["score"] for r in postings.bm25(i, postings.matches(i, q), q, [4, 1]).collect()}
    for q in ("tax water", "tax or old"):
        assert score(index, q) == brute_scores(q, TEXTS, [4, 1])
    more = [(5, "tax tax", "replaced"), (400, "old tax", "new water"), (401, None, None)]
    added = postings.add(index, spark.createDataFrame(more, "id bigint, title string, body string"), "id", ["title", "body"], deleted=spark.createDataFrame([(7,), (9,)], "id bigint"))
    now = [t for t in TEXTS if t[0] not in (5, 7, 9)] + more
    merged = postings.merge(added)
    assert len(added.segments) == 2 and len(merged.segments) == 1
    for i in (added, merged, postings.open_index(spark, index.path, index.layout)):
        assert score(i, "tax water") == brute_scores("tax water", now, [4, 1])
        assert sorted(r["key"] for r in postings.matches(i, '"old tax"').collect()) == sorted(brute('"old tax"', now))
        assert i.records().count() == len(now)
    assert score(index, "tax water") == brute_scores("tax water", TEXTS, [4, 1])  # a reader of the old version
    assert postings.open_index(spark, index.path + "none").segments == ()
    assert postings.matches(postings.open_index(spark, index.path + "none"), "tax").count() == 0


def test_best_window_and_fragments(spark, made, rows):
    df = rows("id int, hits array<struct<term:string,field:int,position:int>>", (1, [("a", 0, 3), ("b", 0, 40), ("a", 0, 44), ("c", 0, 60), ("b", 0, 61), ("a", 0, 70)]), (2, []), (3, [("b", 0, 9)]))
    got = {r["id"]: r["w"] and tuple(r["w"]) for r in df.select("id", postings.best_window("hits", ["a", "b", "c"]).alias("w")).collect()}
    assert got == {1: (3, 60, 70), 2: None, 3: (1, 9, 9)}
    table = spark.createDataFrame(TEXTS, "id bigint, title string, body string")
    found = postings.matches(made["simple"], "tax water")
    out = {r["key"]: (r["field"], r["snippet"]) for r in postings.fragments(made["simple"], found, "tax water", table, "id", ["title", "body"], most=8, least=5).collect()}
    fields = {k: [words(a), words(b)] for k, a, b in TEXTS}
    assert set(out) == set(brute("tax water"))
    for k, (field, snippet) in out.items():
        assert field == (0 if {"tax", "water"} & set(fields[k][0]) else 1)
        plain = re.sub("⟦/?H⟧", "", snippet).split()
        t = fields[k][field]
        assert any(t[i : i + len(plain)] == plain for i in range(len(t))) and len(plain) >= min(5, len(t)) and len(plain) <= 8
        best = max(len({"tax", "water"} & set(t[i : i + 8])) for i in range(len(t)))
        assert len(set(re.findall("⟦H⟧(.*?)⟦/H⟧", snippet))) >= best
