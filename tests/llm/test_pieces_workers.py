"""Texts that are encoded and decoded at once."""

import pytest

import corpus_pipeline
from lexlake.llm import pieces

P = pytest.importorskip("public_tokenizers")
SPM = P.path("piece_bpe_32k.model")
TEXTS = ["one two  three\n four", "", None, "é漢\0x " * 30, "abc def " * 9000, "\n\n", " x"]


def test_one_worker_encodes_and_decodes_a_text(rows, monkeypatch):
    """The pipeline's last stage held two Python workers for each task, one that encodes and one that decodes; only giant texts go through another operation now."""
    given, real = [], pieces.decode
    monkeypatch.setattr(pieces, "decode", lambda df, *a, **b: given.append(df) or real(df, *a, **b))
    docs = rows("doc_id bigint, text string, lang string, source string, n_chars bigint", *((k, x, "en", "s", len(x or "")) for k, x in enumerate(TEXTS)))
    out = corpus_pipeline.encoded(docs.sparkSession, docs, "")
    assert sorted((r["doc_id"], r["round_trip"], r["n_ids"] > 0) for r in out.collect()) == [(k, True, bool(x)) for k, x in enumerate(TEXTS)]
    assert [r["doc_id"] for df in given for r in df.collect()] == [4]


@pytest.mark.parametrize("settings", [pieces.Settings(), pieces.Settings(giant=40, chunk=16, fan=4)])
def test_decoding_at_once_is_decoding_after(rows, settings):
    docs = rows("doc_id bigint, text string, decoded string", *((k, x, "old") for k, x in enumerate(TEXTS) if len(x or "") < 1000))
    once = pieces.encode(docs, SPM, settings, decoded=True)
    after = pieces.decode(pieces.encode(docs, SPM, settings), SPM)
    assert sorted(once.columns) == sorted(after.columns)
    key = lambda r: r["doc_id"]
    assert [r.asDict() for r in sorted(once.collect(), key=key)] == [r.asDict() for r in sorted(after.collect(), key=key)]
