"""Cells of long texts."""

import random

from pyspark.sql import functions as F

from lexlake.llm import fingerprints as f


def test_few_edits_of_a_long_line(spark):
    r = random.Random(2)
    a = "".join(r.choice("abcdefgh ") for _ in range(200_000))
    b = list(a)
    for k in range(8):
        b[25_000 * k + 77] = "#"
    df = spark.createDataFrame([(a, "".join(b))], "a string, b string").select(F.expr(f.sketch(f.digests("a"))).alias("a"), F.expr(f.sketch(f.digests("b"))).alias("b"))
    got = df.select("a.n", F.expr(f.likeness("a", "b")).alias("x"), F.expr(f.as_string("a")).alias("s")).first()
    assert got["n"] == 200_000 // 64 and abs(got["x"] - (got["n"] - 8) / (got["n"] + 8)) < 1e-9 and len(got["s"]) < 7_000


def test_insertions_and_blank_lines(spark):
    clauses = [f"clause number {k} of this text, which ends here." for k in range(40)]
    a = "\n".join(clauses)
    texts = [a, a.replace("number 7 ", "number  7 "), a.replace("\n", "\n\n", 1), "x" + a]
    df = spark.createDataFrame([(a, b) for b in texts], "a string, b string").select("b", F.expr(f.sketch(f.digests("a"))).alias("x"), F.expr(f.sketch(f.digests("b"))).alias("y"))
    got = [r[0] for r in df.select(F.expr(f.likeness("x", "y"))).collect()]
    assert got[0] == 1 and all(0.9 < x < 1 for x in got[1:])
