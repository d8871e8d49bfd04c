"""Ids against an independent best-path search over the whole text."""

import random

import pytest

from lexlake.llm import pieces

P = pytest.importorskip("public_tokenizers")
SPM = P.path("piece_bpe_32k.model")


def best_path(m, text):
    """Of equal scores the longer last piece: starts are tried from the earliest on."""
    score, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - m.longest), end):
            arc = m.arcs.get(text[begin:end]) or ((-1, m.unknown) if end - begin == 1 else None)
            if arc and score[begin] + arc[1] > score[end]:
                score[end], back[end] = score[begin] + arc[1], (begin, arc[0])
    out, at = [], len(text)
    while at:
        begin, k = back[at]
        out.append([k] if k >= 0 else [m.byte_ids[b] for b in text[begin:at].encode()])
        at = begin
    return [k for part in reversed(out) for k in part]


def test_against_a_plain_search(rows):
    r, m = random.Random(4), pieces.pieces(SPM)
    texts = ["".join(r.choice("aabbcnt e.  \n日Z0") for _ in range(n)) for n in (1, 2, 30, 200, 700, 1500)]
    texts += ["".join(r.choice("abab") for _ in range(900)), "na" * 400, "the theory of these " * 40, "", None]
    want = {k: best_path(m, m.normalised(x or "")) for k, x in enumerate(texts)}
    df = rows("doc_id bigint, text string", *enumerate(texts))
    for settings in (pieces.Settings(), pieces.Settings(giant=60, chunk=50, fan=3), pieces.Settings(giant=100, chunk=97, fan=64)):
        assert {x["doc_id"]: x["ids"] for x in pieces.encode(df, SPM, settings).collect()} == want
