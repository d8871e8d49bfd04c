"""What the index stores and moves: a row for each term of a block, not one for each word."""

import pyarrow as pa
import pytest

from lexlake.operators import postings


def test_a_row_for_each_term_of_a_block(spark, tmp_path):
    rows = spark.range(0, 64, 1, 2).selectExpr("id", "repeat('tax on water ', 50) as title", "if(id % 2 = 0, 'water tax', null) as body")
    index = postings.build(spark, rows, "id", ["title", "body"], f"file://{tmp_path}/index", postings.Layout(4, 16))
    stored = spark.read.parquet(f"{index.path}/data")
    assert stored.count() == 4 * 4  # three words and the empty term, four blocks
    assert {(r["term"], r["s"]) for r in stored.selectExpr("term", "size(keys) as s").collect()} == {(t, 16) for t in ("", "tax", "on", "water")}
    found = {r["key"]: r for r in postings.matches(index, '"water tax" -missing').collect()}
    assert sorted(found) == list(range(64)) and [tuple(h)[1:] for h in found[2]["hits"][-2:]] == [(1, 1), (1, 2)] and len(found[2]["hits"]) == 102 and len(found[3]["hits"]) == 100
    assert sorted(r["key"] for r in postings.matches(index, '"water water"').collect()) == []  # not from the title's last word to the body's first
    with pytest.raises(ValueError):
        postings.hits(rows, "id", ["title"] * 17, index.layout)


def test_batches_may_hold_nulls_and_slices():
    one = pa.RecordBatch.from_arrays([pa.array([0, 0, 1], pa.int64()), pa.array([7, None, 5], pa.int64()), pa.array([["b", "a", "b"], [], ["b"]], pa.list_(pa.string()))], ["block", "key", "_0"])
    want = {("", 0): ([7, None], [3, 0], [[0], [0]]), ("", 1): ([5], [1], [[0]]), ("a", 0): ([7], [3], [[2]]), ("b", 0): ([7], [3], [[1, 3]]), ("b", 1): ([5], [1], [[1]])}
    for batch in (one, pa.concat_tables([pa.Table.from_batches([one.slice(2)]), pa.Table.from_batches([one])]).combine_chunks().to_batches()[0].slice(1)):
        got = postings.grouped(batch, "simple").to_pylist()
        assert {(r["term"], r["block"]): (r["keys"], r["lengths"], r["spots"]) for r in got} == want
