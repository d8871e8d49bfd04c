"""Special tokens and white space in the byte-level BPE encoder."""

import pytest
from pyspark.sql import functions as F

from lexlake.llm import bpe, token_counts

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")


def test_end_token_within_a_file(rows, tmp_path):
    """A text that spells the end token neither splits its document nor moves the counts of those behind it."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    texts = [(1, "one two"), (2, "a <|endoftext|> b<|endoftext|>"), (3, "three"), (4, "four five six seven"), (5, "")]
    path = f"file://{tmp_path}/flat"
    order = token_counts.write_flat_files(rows("doc_id bigint, text string", *texts).coalesce(1), path, BPE)
    counts = token_counts.count_tokens(order.groupBy("file").agg(F.max("n_ids").alias("n_ids")), path)
    got = {r["doc_id"]: r["n_tokens"] for r in order.join(counts, ["file", "place"]).collect()}
    assert counts.count() == len(texts) and got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts}


def test_white_space_as_the_library_has_it():
    import itertools

    import numpy as np
    import pyarrow as pa

    e = bpe.WordEncoder(BPE)
    texts = ["a\n\n\nb\u00a0c\u00a0d", *("a".join(x) for x in itertools.product(["", " ", "\n", "  ", "\n\n", " \n", "\t", "\u00a0", "\u00a0\u00a0"], repeat=4)), "", "x\0 y", "it's 12 Ünïcode 日本\nnew line <|endoftext|> z", "a\u200bb c", *(f"w{k} of {k * k} don't" for k in range(3000))]
    for _ in range(2):
        at = 0
        for first, n, ids, counts in e.slices(pa.array(texts)):
            assert first == at and len(counts) == n
            for x, own in zip(texts[at : at + n], np.split(ids, np.cumsum(counts)[:-1])):
                assert own.tolist() == e.whole(x).tolist(), repr(x)
            at += n
        assert at == len(texts)
        bpe.SLICE_BYTES = 1000


def test_new_words_go_to_the_library_without_newlines(monkeypatch):
    """Words that a blank leads need nothing between them; a newline before each was a word more for the library."""
    import pyarrow as pa

    e, calls = bpe.WordEncoder(BPE), []
    real = e.whole
    monkeypatch.setattr(e, "whole", lambda text: calls.append(text) or real(text))
    texts = ["Start don't it's 12,5 x-y Ünïcode\nSecond 日本 (a) \u0120b c\u0120", "one", "a\nb c"]
    (_, _, ids, counts), = e.slices(pa.array(texts))
    assert ids.tolist() == [k for x in texts for k in real(x).tolist()] and counts.tolist() == [len(real(x)) for x in texts]
    assert len(calls) == 1 and calls[0].count("\n") == 5
