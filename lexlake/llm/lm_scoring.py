"""Language-model scores by a weighted backoff automaton.

Smoothed n-grams become states (contexts) with weighted arcs; a failure arc leads from each context to its shorter one.
Counts come from all training texts: blocks of documents send their distinct n-grams, as sorted keys, to shards of the
key space; a shard adds up the counts and answers each block with those of its own n-grams; a block builds its part of
the automaton from the answer. One left-to-right traversal carries a state for each document, all documents of a block in
step, and accumulates log-probabilities. Blocks and shards hold so many bytes, so their number grows with the corpus and
no task does; nothing that grows with the corpus is broadcast or collected.

A context that was followed h times backs off with the pseudo-count strength + h ** growth: it has about h ** growth
different followers (Heaps' law), while a rare one is trusted soon, so texts that the corpus repeats stand out.

Null texts count as empty: one end token. Rows with null or repeated doc_id are scored each. An empty table gives no rows.
Equal texts get equal scores; without training text every token has the same probability.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, text_of


@dataclass(frozen=True)
class Settings:
    """order: the longest n-gram. strength, growth: of the pseudo-count. block_bytes: of text in a block, and of n-grams in a shard."""

    order: int = 3
    strength: float = 4.0
    growth: float = 0.8
    block_bytes: int = 12 << 20

    def pseudo_count(self, h):
        return self.strength + h**self.growth


END = ""
START_STATE = 0x9E3779B97F4A7C15
#: Bits of an n-gram's key that are not sent.
SPARED = 8


def words_of(texts):
    """(numbers of all tokens, 64-bit key of each number, tokens of each text): ASCII lower case, split at ASCII white space, one end each. texts: an Arrow array without nulls."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat = lists.flatten()
    held = np.asarray(pc.binary_length(flat)) > 0  # an empty text has one empty word
    counts = np.diff(np.append(0, np.cumsum(held))[np.asarray(lists.offsets) - lists.offsets[0].as_py()])
    numbered = flat.filter(pa.array(held)).dictionary_encode()
    keys = np.array([*map(xxhash.xxh64_intdigest, numbered.dictionary.to_pylist()), xxhash.xxh64_intdigest(END)], np.uint64)
    lengths = counts + 1
    tokens, ends = np.empty(lengths.sum(), np.int32), np.cumsum(lengths) - 1
    words = np.ones(len(tokens), bool)
    words[ends] = False
    tokens[words], tokens[ends] = np.asarray(numbered.indices), len(keys) - 1
    return tokens, keys, lengths


def extended(context, keys):
    """Key of the n-gram that a context's key and the next token's make."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (context * np.uint64(0xBF58476D1CE4E5B9) + keys) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def ngrams_of(texts, order: int):
    """(for n from 1 to order: sorted keys of the distinct n-grams and the number of the one that ends at each token; tokens of each text).

    Contexts before a text's start are one start state.
    """
    import numpy as np
    import pandas as pd

    tokens, word_keys, lengths = words_of(texts)
    keys = word_keys[tokens]
    first = np.cumsum(lengths) - lengths
    before, shifted = [keys], keys
    for _ in range(order - 1):  # shifted by one more token each time
        shifted = np.roll(shifted, 1)
        shifted[first] = START_STATE
        before.append(shifted)
    out = []
    for n in range(1, order + 1):
        gram = before[n - 1]
        for k in range(n - 2, -1, -1):
            gram = extended(gram, before[k])
        place, distinct = pd.factorize(gram >> np.uint64(SPARED))
        by_key = np.argsort(distinct)
        rank = np.empty(len(distinct), np.int32)
        rank[by_key] = np.arange(len(distinct), dtype=np.int32)
        out.append((distinct[by_key], rank[place]))
    return out, lengths


def pack(values) -> bytes:
    """Whole numbers as byte planes, compressed: leading zero bytes cost nothing."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def texts_in(table):
    """The texts of a table as one Arrow array."""
    import pyarrow as pa

    return pa.concat_arrays(table["text"].chunks) if table.num_rows else pa.array([], pa.string())


def requests(blocks: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """(shard, block, n, keys, counts): each block's distinct n-grams with their counts in its training texts."""
    order = settings.order

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        grams, lengths = ngrams_of(texts_in(table), order)
        weight = np.repeat(np.asarray(table["trains"]).astype(np.float64), lengths)
        rows = []
        for n, (distinct, place) in enumerate(grams, 1):
            counts = np.bincount(place, weight, len(distinct)).astype(np.int64)
            cuts = np.searchsorted(distinct, shard_edges(shards)[1:-1])
            for shard, (ks, cs) in enumerate(zip(np.split(distinct, cuts), np.split(counts, cuts))):
                if len(ks):
                    rows.append((shard, n, pack(np.diff(ks, prepend=np.uint64(0))), pack(cs)))
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()), "n": pa.array(cols[1], pa.int32()), "keys": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})

    return blocks.groupBy("block").applyInArrow(run, "shard int, block int, n int, keys binary, counts binary")


def shard_edges(shards: int):
    """Bounds of equal ranges of the key space."""
    import numpy as np

    return np.array([(k << 64 - SPARED) // shards for k in range(shards + 1)], np.uint64)


def answers(asked: DataFrame) -> DataFrame:
    """(block, n, shard, counts, total, distinct): the corpus's counts of the n-grams that each block asked for; total and distinct are the shard's."""

    def run(key, table):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
        counts = np.concatenate([unpack(x) for x in table["counts"].to_pylist()]).astype(np.float64)
        place, distinct = pd.factorize(np.concatenate(keys))
        sums = np.bincount(place, counts, len(distinct)).astype(np.int64)
        found = [pack(x) for x in np.split(sums[place], np.cumsum([len(x) for x in keys])[:-1])]
        many = table.num_rows
        return pa.table({"block": table["block"], "n": table["n"], "shard": table["shard"], "counts": pa.array(found, pa.binary()), "total": pa.array([int(sums.sum())] * many, pa.int64()), "distinct": pa.array([int((sums > 0).sum())] * many, pa.int64())})

    return asked.groupBy("n", "shard").applyInArrow(run, "block int, n int, shard int, counts binary, total bigint, distinct bigint")


class Automaton:
    """A block's part of the model.

    States are contexts of 0 to order - 1 tokens: that of the k-gram with number g is base[k] + g; base[k + 1] - 1 is the
    start of a text, and state 0 the empty context. Arcs are the seen n-grams: weight, and the state that each leads to.
    Each state but the empty one has a failure arc to the context that is a token shorter.
    """

    def __init__(self, places: list, counts: list, first, texts: int, total: int, distinct: int, settings: Settings):
        """places, counts: by order, the number of the n-gram that ends at each token, and the corpus's count of each number. first: where texts start."""
        import numpy as np

        order = self.order = len(places)
        self.places, self.base = places, [0, 1]
        for c in counts[:-1]:
            self.base.append(self.base[-1] + len(c) + 1)
        self.fail, self.fall = np.zeros(self.base[-1], np.int64), np.zeros(self.base[-1])
        self.arc, self.to = [], []
        starts = np.zeros(len(places[0]), bool)
        starts[first] = True
        p = (counts[0] + 1) / (total + distinct + 1)
        self.root = np.log10(p)
        for n in range(1, order + 1):
            c, place = counts[n - 1], places[n - 1]
            if n > 1:
                # of each n-gram: its context's state and the probability that the shorter n-gram has
                context = np.empty(len(c), np.int64)
                context[place] = self.context_of(starts, n - 1)
                shorter = np.empty(len(c))
                shorter[place] = p[places[n - 2]]
                h = self.follows[context - self.base[n - 1]]
                s = settings.pseudo_count(h)
                p = (c + s * shorter) / (h + s)
            self.arc.append(np.where(c > 0, np.log10(p), np.nan))
            k = min(n, order - 1)  # a seen n-gram leads to the longest context that it ends with
            to = np.zeros(len(c), np.int64)
            to[place] = self.base[k] + places[k - 1] if k else 0
            self.to.append(to)
            if n < order:
                self.follows = np.append(c, texts).astype(float)
                s = settings.pseudo_count(self.follows)
                own = slice(self.base[n], self.base[n + 1])
                self.fall[own] = np.log10(s / (self.follows + s))
                if n > 1:
                    self.fail[self.base[n] + place] = self.base[n - 1] + places[n - 2]
                    self.fail[self.base[n + 1] - 1] = self.base[n] - 1

    def context_of(self, starts, k: int):
        """State of the k tokens before each token."""
        import numpy as np

        state = np.roll(self.base[k] + self.places[k - 1].astype(np.int64), 1)
        state[starts] = self.base[k + 1] - 1
        return state

    def traverse(self, first, lengths):
        """log10 probability of each text, left to right, a token of each at a time."""
        import numpy as np

        by_length = np.argsort(-lengths, kind="stable")
        at, left = first[by_length], lengths[by_length]
        score = np.zeros(len(at))
        state = np.full(len(at), self.base[self.order] - 1 if self.order > 1 else 0)
        more = np.searchsorted(-left, -np.arange(1, left[0] + 1 if len(left) else 1), "right")  # texts that have a step's token
        for step, n_texts in enumerate(more):
            here, now, gain = at[:n_texts] + step, state[:n_texts], np.zeros(n_texts)
            open_ = np.arange(n_texts)
            for n in range(self.order, 0, -1):
                try_ = open_[now[open_] >= self.base[n - 1]] if n > 1 else open_
                gram = self.places[n - 1][here[try_]]
                weight = self.arc[n - 1][gram]
                fits = ~np.isnan(weight)
                took = try_[fits]
                gain[took] += weight[fits]
                fallen = try_[~fits]
                if n > 1:
                    gain[fallen] += self.fall[now[fallen]]
                    now[fallen] = self.fail[now[fallen]]
                    now[took] = self.to[n - 1][gram[fits]]
                    open_ = np.setdiff1d(open_, took, assume_unique=True) if len(try_) < len(open_) else fallen
                else:  # the empty context has a weight for any token
                    gain[fallen] += self.root[gram[~fits]]
                    now[took], now[fallen] = self.to[0][gram[fits]], 0
            score[:n_texts] += gain
            state[:n_texts] = now
        out = np.empty(len(at))
        out[by_length] = score
        return out


def score(docs: DataFrame, trains: Column, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, trains, n_tokens, n_known, train_tokens, base_score, score) of every row. trains: which rows the model learns from."""
    rows = docs.select("doc_id", text_of().alias("text"), trains.alias("trains"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count_if("trains")).first()
    parts, texts = 1 + int(size[0] or 0) // settings.block_bytes, int(size[1] or 0)
    blocks = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("block"), "doc_id", "text", "trains")
    answered = materialise(answers(requests(blocks, parts, settings)), "lm-counts")
    sums = answered.where("n = 1").groupBy("shard").agg(F.max("total").alias("total"), F.max("distinct").alias("distinct")).agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = int(sums[0] or 0), int(sums[1] or 0)

    def run(key, table, found):
        import numpy as np
        import pyarrow as pa

        out = pa.schema([("doc_id", table.schema.field("doc_id").type), ("trains", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
        if not table.num_rows:
            return out.empty_table()
        grams, lengths = ngrams_of(texts_in(table), settings.order)
        parts_of = {}
        for n, shard, data in zip(found["n"].to_pylist(), found["shard"].to_pylist(), found["counts"].to_pylist()):
            parts_of.setdefault(n, []).append((shard, data))
        counts = [np.concatenate([unpack(x) for _, x in sorted(parts_of[n])]).astype(np.float64) for n in range(1, settings.order + 1)]
        places, first = [place for _, place in grams], np.cumsum(lengths) - lengths
        scores = Automaton(places, counts, first, texts, total, distinct, settings).traverse(first, lengths)
        in_training = counts[0][places[0]]
        base = np.add.reduceat(np.log10((in_training + 1) / (total + distinct + 1)), first)
        known = np.add.reduceat((in_training > 0).astype(np.int64), first)
        return pa.table([table["doc_id"], table["trains"], pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), total)), pa.array(base), pa.array(scores)], schema=out)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, trains boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, learning from those whose crc32(doc_id) mod 7 isn't 2."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    scored = score(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
