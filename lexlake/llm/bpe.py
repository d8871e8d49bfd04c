"""Byte-level BPE encoding that calls the tokenizers library once for each new word of a worker."""

from __future__ import annotations

import os

#: Words that a worker's cache holds before it starts anew, bytes of text that are encoded at once, and words of one call; they bound memory, not results.
CACHE_WORDS = 300_000
SLICE_BYTES = 4 << 20
CALL_WORDS = 20_000
#: Places of the table that tells which words have come up before; only those are worth keeping.
SEEN = 1 << 23
NEWLINE_ID = 198
#: Texts with any of these go to the library whole: edges and runs of white space, white space other than blanks and newlines, NUL, special tokens.
WHOLE = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|<\|"


class WordEncoder:
    """Encodes columns of whole texts.

    The pre-tokeniser never joins characters across an isolated blank or newline, so such a text is the concatenation of
    its blank-led words, each encoded once; Arrow cuts and numbers them, and their ids are gathered from one table.
    literal: special tokens in a text are encoded as the characters that they are, so none of their ids occurs.
    """

    newline, uncut = NEWLINE_ID, WHOLE

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[k for token, k in vocabulary.items() if token.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        """An empty cache: words[w] is the row of starts and counts that says where the word's ids are in the table."""
        import numpy as np

        self.words: dict[str, int] = {"\n": 0}
        self.table, self.used = np.empty(1 << 20, "<u4"), 1
        self.starts, self.counts = np.zeros(CACHE_WORDS, np.int64), np.ones(CACHE_WORDS, np.int32)
        self.table[0], self.seen = self.newline, np.zeros(SEEN, bool)

    def whole(self, text: str):
        import numpy as np

        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def ids_of(self, words: list[str]) -> tuple:
        """(ids, number of ids of each). One call serves all: a word that a blank leads begins with an id that has the blank, another one gets a newline before it."""
        import numpy as np

        bare = [w[:1] != " " for w in words]
        ids = self.whole("".join(["\n" + w if b else w for w, b in zip(words, bare)]))
        newline = ids == NEWLINE_ID
        begins = np.flatnonzero(newline | self.leads[ids])
        if np.array_equal(newline[begins], bare):
            return ids[~newline], np.diff(begins, append=len(ids)) - newline[begins]
        parts = [self.whole(w) for w in words]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def learn(self, words: list[str], first: int) -> None:
        """Writes the words' ids behind those that the cache keeps, as rows from `first`."""
        import numpy as np

        for at in range(0, len(words), CALL_WORDS):
            ids, counts = self.ids_of(words[at : at + CALL_WORDS])
            while self.used + len(ids) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            while first + len(counts) > len(self.starts):
                self.starts, self.counts = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.counts))
            self.starts[first : first + len(counts)], self.counts[first : first + len(counts)] = self.used + np.cumsum(counts) - counts, counts
            self.table[self.used : self.used + len(ids)] = ids
            self.used, first = self.used + len(ids), first + len(counts)

    def rows_of(self, words: list[str]):
        """Row of each distinct word. New ones are encoded; those that have come up before are kept, the others' rows hold until the next call."""
        from itertools import repeat

        import numpy as np

        if len(self.words) > CACHE_WORDS:
            self.clear()
        kept = len(self.words)
        self.used = int(self.starts[kept - 1] + self.counts[kept - 1])
        rows = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        marks = np.fromiter(map(hash, map(words.__getitem__, new.tolist())), np.int64, len(new)) & (SEEN - 1)
        again = self.seen[marks]
        self.seen[marks] = True
        new = np.concatenate([new[again], new[~again]])
        rows[new] = np.arange(kept, kept + len(new))
        own = [words[k] for k in new]
        self.learn(own, kept)
        self.words.update(zip(own[: int(again.sum())], range(kept, kept + int(again.sum()))))
        return rows

    def by_words(self, texts):
        """(ids, number of ids of each text) of texts that can be cut into words."""
        import numpy as np
        import pyarrow.compute as pc

        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(cut, "\0")
        numbered = lists.flatten().dictionary_encode()
        rows = self.rows_of(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(numbered.indices)]
        counts = self.counts[rows]
        ends = np.cumsum(counts, dtype=np.int32)
        at = np.repeat((self.starts[rows] - (ends - counts)).astype(np.int32), counts)
        at += np.arange(len(at), dtype=np.int32)
        of_text = np.diff(np.append(0, ends)[np.asarray(lists.offsets) - lists.offsets[0].as_py()]).astype(np.int64)
        return self.table[at], of_text

    def encode_slice(self, texts):
        """(ids, number of ids of each text) of an Arrow array of texts without nulls."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = np.asarray(pc.match_substring_regex(texts, self.uncut)) | (np.asarray(pc.binary_length(texts)) == 0)
        ids, counts = self.by_words(texts.filter(pa.array(~whole))) if not whole.all() else (np.empty(0, "<u4"), np.empty(0, np.int64))
        if not whole.any():
            return ids, counts
        parts = [self.whole(x) for x in texts.filter(pa.array(whole)).to_pylist()]
        all_counts = np.empty(len(texts), np.int64)
        all_counts[~whole], all_counts[whole] = counts, [len(x) for x in parts]
        out, of_whole = np.empty(all_counts.sum(), "<u4"), np.repeat(whole, all_counts)
        out[~of_whole], out[of_whole] = ids, np.concatenate(parts)
        return out, all_counts

    def slices(self, texts):
        """(first row, number of rows, ids, number of ids of each text) over an Arrow array of texts without nulls, in slices of bounded size (or one text)."""
        import numpy as np
        import pyarrow.compute as pc

        ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
        at = 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")) - at)
            yield at, n, *self.encode_slice(texts.slice(at, n))
            at += n


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, literal: bool = False) -> WordEncoder:
    """This worker's encoder; workers are reused, and so is its cache."""
    if (path, literal) not in _encoders:
        _encoders[path, literal] = WordEncoder(path, literal)
    return _encoders[path, literal]


def with_end(ids, counts, end: int | None):
    """ids and counts with the end id behind each text's ids."""
    import numpy as np

    if end is None:
        return ids, counts
    counts = counts + 1
    out, ends = np.empty(len(ids) + len(counts), ids.dtype), np.cumsum(counts) - 1
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own], out[ends] = ids, end
    return out, counts
