"""NUL characters in texts that are encoded in chunks."""

import numpy as np
import pytest

from lexlake.llm import pieces

P = pytest.importorskip("public_tokenizers")
SPM = P.path("piece_bpe_32k.model")


def test_nul_in_giant_texts(rows):
    m = pieces.pieces(SPM)
    texts = ["one two\0three\0 four \0five\nsix " * 40, "\0" * 300, "a\0b" * 200, "x y\0\0  z " * 100 + "\0"]
    df = rows("doc_id bigint, text string", *enumerate(texts))
    a, b = (sorted(pieces.decode(pieces.encode(df, SPM, s), SPM).collect(), key=lambda r: r["doc_id"]) for s in (pieces.Settings(), pieces.Settings(giant=100, chunk=64, fan=4)))
    for x, r, g in zip(texts, a, b):
        assert r["chunks"] == 1 and g["chunks"] > 1 and r["decoded"] == x and g["decoded"] == x
        whole = m.library.encode(m.normalised(x))
        assert abs(m.total(np.array(r["ids"])) - m.total(np.array(whole))) < 1e-6 and abs(m.total(np.array(g["ids"])) - m.total(np.array(whole))) < 1e-6


def test_decoding_needs_no_search(spark):
    """A worker that decodes holds what ids spell alone, and none of another operator's caches."""
    from lexlake.llm import common

    other = {"word": 1}
    common.take_worker("other", other)
    light, m = pieces.loaded(pieces.Spelling, SPM), pieces.pieces(SPM)
    assert not other and not hasattr(light, "library") and pieces.loaded(pieces.Spelling, SPM) is light
    ids = np.frombuffer(m.encode([" a  b\n\0é漢"])[0], "<i4").tolist()
    assert light.decode(ids) == m.decode(ids) == " a  b\n\0é漢" and light.raw == m.raw
