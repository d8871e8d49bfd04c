"""Branches of a search lose no hits where the query states no cap."""

from lexlake.operators import search
from lexlake.plans import catalogue


def test_fts_branches_beyond_a_hundred_thousand_hits(spark, tmp_path):
    n = 100_050
    part = spark.range(n).selectExpr("id as p_partkey", "'blue' as p_name", "if(id % 2 = 0, 'ECONOMY', 'OTHER') as p_type")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.QUERIES["fts_branches"](spark, str(tmp_path))
    assert tuple(got.selectExpr("count(*)", "min(total)", "max(total)", "min(rank)", "max(rank)").first()) == (n, n, n, 4, 4)


def test_cap_is_the_callers(spark, rows):
    hits = rows("id bigint, rank bigint", (1, 2), (2, 5), (3, 9))
    out = lambda cap: sorted(map(tuple, search.branches([(hits, 4), (hits, 1)], "id", cap).collect()))
    assert out(None) == [(1, 8, 3), (2, 20, 3), (3, 36, 3)] and out(2) == [(1, 8, 2), (2, 20, 2)]
