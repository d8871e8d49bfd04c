"""Scopes of all kinds against plain Python, with hot scopes in several ranges."""

from pyspark.sql import functions as F

from lexlake.operators import scopes


def test_events_for_all_scopes(rows):
    people = [(k, ["aa", "bb", None][k % 3], k % 4 == 0) for k in range(12)]
    log = [(n, n * 5 % 13, ["x", "y"][n % 2]) for n in range(1, 90)]
    subs = [("s1", "jurisdiction", "aA", 10, None), ("s2", "topic", "four", None, "x"), ("s3", "topic", "four:BB", 3, ""), ("s4", "bills", "1, 2,2,,9", 20, "y,z"), ("s5", "bills", " , ", 0, ""), ("s6", "topic", "none", 0, ""), ("s7", "jurisdiction", "zz", 0, ""), ("s8", "topic", "four:zz", 0, ""), ("s9", "other", "a", 0, ""), ("s10", "topic", "four:", 70, "")]
    keyed = scopes.scope_keys(rows("id bigint, code string, four boolean", *people), "id", "code", {"four": F.col("four")})
    table = rows("subscription string, kind string, target string, cursor bigint, kinds string", *subs)
    of = {"s1": lambda p: p[1] == "aa", "s2": lambda p: p[2], "s3": lambda p: p[2] and p[1] == "bb", "s4": lambda p: p[0] in (1, 2, 9), "s10": lambda p: p[2]}
    want = sorted((s[0], n, k, e) for s in subs if s[0] in of for n, k, e in log for p in people if p[0] == k and (s[3] or 0) < n <= 80 and of[s[0]](p) and (not s[4] or e in s[4].split(",")))
    for width in (1, 7, 1 << 20):
        got = scopes.events_for(rows("seq bigint, entity_id bigint, kind string", *log), keyed, "id", table, 80, width)
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(r["subscription"] for r in scopes.unknown_scopes(table, rows("code string", ("AA",), ("bb",)), ["four"]).collect()) == ["s5", "s6", "s7", "s8", "s9"]
    assert scopes.events_for(rows("seq bigint, entity_id bigint, kind string", *log), keyed, "id", table, 0).count() == 0
