"""Surface forms of identifiers against a search for each form in each text."""

import random
import re

from lexlake.operators import validation

SPELLED = validation.SPELLED_OUT


def patterns(identifier):
    compact = re.sub("[^a-z0-9]", "", identifier.lower())
    m = re.fullmatch("([a-z]+)([0-9]+)", compact)
    if not m:
        return [rf"(?<![a-z0-9]){compact}(?![a-z0-9])"] if compact else []
    prefix, number = m.groups()
    out = {f"{p}{gap}{n}" for p in (prefix, prefix[0]) for gap in ("", " ") for n in (number.zfill(3), number.zfill(4))} | {prefix + number, f"{prefix} {number}", prefix[0] + number}
    out |= {f"{SPELLED[prefix]} {number}"} if prefix in SPELLED else set()
    return [rf"(?<![a-z0-9]){f}(?![0-9])" for f in sorted(out)] + [rf"(?<![a-z0-9]){prefix}[0-9]{{2}}0*{number}(?![0-9])"]


def test_forms_in_texts(rows):
    r = random.Random(4)
    records = ["HB 12", "SB 24", "S 537", "HJR 5", "HB 1057", "H 7", "SR 14", "HB 12A", "SCR 100", "", None, "AB 3", "HB 2612"]
    bits = ["HB", "H.B.", "hb", "SB", "S*", "senate", "bill", "Senate Bill", "House Joint Resolution", "the", "shb", "graph", "H", "12", "012", "0012", "00012", "24", "26-024", "2624", "26-1057", "1057", "10571", "0537", "537", "5", "05", "7", "14", "100", "HB12A", "HB 12a", "-", " ", "\n", ",", "3", "x"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(1, 9))) for _ in range(1500)] + ["", None, "hb 1057", "shb 105", "h09140"]
    want = set()
    for n, text in enumerate(texts):
        key = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", (text or "").lower())).strip()
        want |= {(n, k) for k, i in enumerate(records) if i and any(re.search(p, key) for p in patterns(i))}
    pages, named = rows("page int, text string", *enumerate(texts)), rows("id int, number string", *enumerate(records))
    got = {tuple(x) for x in validation.mentions(pages, "page", "text", named, "id", "number").collect()}
    assert got == want, (sorted(got - want)[:3], sorted(want - got)[:3], [texts[n] for n, _ in sorted(got ^ want)[:3]])
    leg = validation.cross_source_leg(rows("id int, number string, text string", (1, "HB 12", "see H.B. 012"), (2, "HB 12", "hb 121"), (3, "HB 12", None), (4, None, "hb 12")), "id", "number", "text")
    assert {x["id"]: x["outcome"] for x in leg.collect()} == {1: "pass", 2: "fail", 3: "unverifiable", 4: "fail"}
