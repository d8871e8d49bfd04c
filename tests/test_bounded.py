"""Work that stays bounded: differences of large texts, and turns of groups whose items have a row each."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from lexlake.functions import linediff
from lexlake.operators import paging, records, schedule


def applied(old, new, ops):
    out, i, j = [], 0, 0
    for op, i1, i2, j1, j2 in ops:
        assert (i1, j1) == (i, j) and (i2 > i1) == (op in ("equal", "replace", "delete")) and (j2 > j1) == (op in ("equal", "replace", "insert"))
        assert op != "equal" or old[i1:i2] == new[j1:j2]
        out += new[j1:j2]
        i, j = i2, j2
    assert (i, j) == (len(old), len(new))
    return out


@pytest.mark.parametrize("bits", [1, 50, 1 << 25])
def test_opcodes_are_edits_and_longest(monkeypatch, bits):
    monkeypatch.setattr(linediff, "TRACED_BITS", bits)
    r = random.Random(7)
    for _ in range(150):
        old, new = ([r.choice("abcde") for _ in range(r.randrange(14))] for _ in range(2))
        ops = linediff.opcodes(old, new)
        assert applied(old, new, ops) == new
        table = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i, x in enumerate(old):
            for j, y in enumerate(new):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert sum(i2 - i1 for op, i1, i2, *_ in ops if op == "equal") == table[-1][-1]
        assert all(a[0] != b[0] for a, b in zip(ops, ops[1:]) if a[0] == "equal")


def test_same_as_the_library_where_there_is_one_answer():
    """Edited texts of distinct lines have one longest common subsequence."""
    r = random.Random(3)
    for _ in range(40):
        old = [f"line {k}" for k in range(r.randrange(60))]
        new = [x for k, x in enumerate(old) if r.random() > 0.1]
        for k in range(r.randrange(5)):
            new.insert(r.randrange(len(new) + 1), f"new {k}")
        assert linediff.opcodes(old, new) == difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
        for n in (0, 1, 3):
            assert [x for _, x in linediff.unified(old, new, n)] == list(difflib.unified_diff(old, new, lineterm="", n=n))


def test_large_pairs(rows):
    r = random.Random(1)
    words = ["be it enacted", "section", "shall not apply", "repealed", ""]
    old, new = ("\n".join(r.choice(words) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(60_000))[:740_000] for _ in range(2))
    began = time.perf_counter()
    ops = linediff.opcodes(old.split("\n"), new.split("\n"))
    took = time.perf_counter() - began
    assert applied(old.split("\n"), new.split("\n"), ops) == new.split("\n") and took < 60
    giant = "\n".join(r.choice("ab") for _ in range(500_000))
    df = rows("k int, n int, text string", (1, 1, giant), (1, 2, giant[::-1]), (2, 1, "a\nb"), (2, 2, "a\nc"), (3, 1, None), (3, 2, "x"))
    began = time.perf_counter()
    got = {x["k"]: x for x in records.opcodes(df, "k", "n", "text").collect()}
    assert got[1]["too_large"] and got[1]["ops"] is None and [tuple(o) for o in got[2]["ops"]] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2)] and 3 not in got
    lines = {x["k"]: x for x in records.diffs(df, "k", "n", "text").collect()}
    assert lines[1]["too_large"] and lines[1]["lines"] is None and [x["type"] for x in lines[3]["lines"]] == ["meta", "meta", "meta", "remove", "add"]
    assert time.perf_counter() - began < 30


def brute_turns(data):
    items, out = {}, {}
    for g, i, c, n in sorted(data, key=lambda x: x[3]):
        items[g, i] = items.get((g, i), 0) + 1
        out.setdefault(g, []).append((c, items[g, i], n))
    return {n: k for g in out for k, (_, _, n) in enumerate(sorted(out[g]), 1)}


@pytest.mark.parametrize("many", [None, 7, 50])
def test_turns(rows, many):
    r = random.Random(2)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([0, 0, 0, *range(60)]), r.randrange(2), n) for n in range(400)]
    covered = {}
    data = [(g, i, covered.setdefault((g, i), c), n) for g, i, c, n in data]
    got = schedule.fair_order(rows("g string, i int, c int, n int", *data), "g", "i", "c", ["n"], many).collect()
    assert {x["n"]: x["turn"] for x in got} == brute_turns(data)
    assert schedule.fair_order(rows("g string, i int, c int, n int"), "g", "i", "c", ["n"]).count() == 0


def test_a_million_items_of_one_row_each(spark, monkeypatch):
    """No window holds more than a range: the greatest cell that is sorted has a range's rows."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.lit(0).alias("c"), F.col("id").alias("n"))
    part = paging.range_of(df, "n", 1 << 16)
    assert df.groupBy(part.alias("p")).count().agg(F.max("count")).first()[0] < 1 << 17
    out = schedule.fair_order(df, "g", "i", "c", ["n"], 1 << 16)
    assert out.where("turn != n + 1 or in_item != 1").count() == 0
