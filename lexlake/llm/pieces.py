"""SentencePiece encoding and decoding as best paths over the pieces' lattice, with a max-plus parallel scan for giant texts.

The score of a segmentation is the sum of its pieces' log-probabilities. A BPE vocabulary holds merge ranks instead;
they become log-probabilities by Zipf's law, so ids are those of a unigram model over the same pieces and not those of
the merges. A giant text is cut in chunks. A chunk's transfer matrix holds the best score from each state at its begin to
each at its end; a state is the number of characters by which the piece that crosses the boundary reaches over it.
Matrices combine associatively under (max, +), in blocks of bounded size. Down the same tree each chunk learns the best
score from the text's begin to each of its first states; that tells for each state at its end the one at its begin,
and these maps combine in the same way. So each chunk learns its two boundary states and is traced back alone.

Of paths with equal scores the one with the longer last piece is taken, on that of the rest, and so on: ids are the same
however a text is cut, and those of the library. Ids decode to the text they came from. Null and empty texts have no
ids. Rows with null or repeated ids are encoded each. Extra columns pass through; columns named ids, chunks or decoded are replaced by those that the functions add.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, take_worker, text_of

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
#: What the library takes off the least score for a character that no piece has (fixed value).
UNKNOWN_PENALTY = 10.0
#: Chunks of a giant text that are sent at once.
CUT = 256
#: Words whose ids a worker holds; bounds its memory, not results.
CACHE_UNITS = 200_000


@dataclass(frozen=True)
class Settings:
    """giant: characters above which a text is cut in chunks of `chunk`; a shorter one is a chunk of its own. fan: matrices that one task combines."""

    giant: int = 1 << 16
    chunk: int = 1 << 14
    fan: int = 64


# --- the model file


def fields(data: bytes):
    """(number, wire type, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, 0, varint()
            continue
        n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        at += n
        yield key >> 3, key & 7, data[at - n : at]


def message(parts) -> bytes:
    """The reverse of fields()."""

    def varint(value: int) -> bytes:
        out = bytearray()
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        return bytes([*out, value])

    return b"".join(varint(n << 3 | wire) + (varint(v) if wire == 0 else varint(len(v)) + v if wire == 2 else v) for n, wire, v in parts)


class Spelling:
    """What ids spell; all that decoding needs of a vocabulary."""

    def __init__(self, path: str):
        self.read(path)

    def read(self, path: str) -> tuple:
        """The model's fields, its pieces' and its normaliser's."""
        with open(path, "rb") as f:
            top = list(fields(f.read()))
        own = [{n: v for n, _, v in fields(v)} for n, _, v in top if n == 1]
        normaliser = next(({n: v for n, _, v in fields(v)} for n, _, v in top if n == 3), {})
        names, kinds = [p[1].decode() for p in own], [p.get(3, NORMAL) for p in own]
        self.prefix = bool(normaliser.get(3, 1))
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind != NORMAL else p.replace(SPACE, " ").encode() for p, kind in zip(names, kinds)]
        return top, own, names, kinds, normaliser

    def decode(self, ids) -> str:
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


class Pieces(Spelling):
    """A vocabulary with log-probabilities, and the library's best-path search over it."""

    def __init__(self, path: str):
        import sentencepiece

        top, own, self.pieces, self.kinds, normaliser = self.read(path)
        raw = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in own]
        trainer = next(({n: v for n, _, v in fields(v)} for n, _, v in top if n == 2), {})
        if normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only models that leave characters and white space as they are")
        if trainer.get(3, UNIGRAM) == BPE:
            normal = [k for k, kind in enumerate(self.kinds) if kind == NORMAL]
            rank = {k: r for r, k in enumerate(sorted(normal, key=lambda k: -raw[k]), 2)}
            total = math.log(sum(1 / (r + 2.7) for r in rank.values()))
            raw = [-math.log(rank[k] + 2.7) - total if k in rank else 0.0 for k in range(len(raw))]
        self.scores = [round(s * 64) / 64 for s in raw]  # so that sums are exact in the library's floats, in any order
        self.byte_ids = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == BYTE}
        self.arcs = {p: (k, self.scores[k]) for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == NORMAL}
        self.longest = max(map(len, self.arcs))
        self.unknown = min(s for _, s in self.arcs.values()) - UNKNOWN_PENALTY
        self.known = set("".join(self.arcs))
        #: No piece goes from another character on to a space: a path is cut before each word.
        self.cuts = not any(a != SPACE and b == SPACE for p in self.arcs for a, b in zip(p, p[1:]))
        at, rebuilt = 0, []
        for n, wire, v in top:
            if n == 1:
                v = message([(f, w, x) for f, w, x in fields(v) if f != 2] + [(2, 5, struct.pack("<f", self.scores[at]))])
                at += 1
            elif n == 2:
                v = message([(f, w, UNIGRAM if f == 3 else x) for f, w, x in fields(v)])
            elif n == 3:
                v = message([(f, w, x) for f, w, x in fields(v) if f != 3] + [(3, 0, 0)])
            rebuilt.append((n, wire, v))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=message(rebuilt))
        self.units: dict[str, bytes] = {}
        self.seen = bytearray(1 << 22)

    def normalised(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def unit_ids(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of texts between cuts, from the cache or the library."""
        import numpy as np

        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        new = sorted(set(units).difference(self.units))
        if new:
            for u, ids in zip(new, self.library.encode(new, num_threads=1)):
                self.units[u] = np.array(ids, "<i4").tobytes()
        out = list(map(self.units.__getitem__, units))
        for u in new:  # those that come up for the first time aren't worth keeping
            mark = hash(u) & (len(self.seen) - 1)
            if not self.seen[mark]:
                self.seen[mark] = 1
                del self.units[u]
        return out

    def split(self, text: str) -> list[str]:
        """A normalised text's units: each begins at a cut."""
        if not self.cuts:
            return [text] if text else []
        if SPACE * 2 in text or "\0" in text:
            import re

            return re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+", text) if "\n" not in self.known else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
        text = text.replace(SPACE, "\0" + SPACE)
        if "\n" not in self.known:
            text = text.replace("\n", "\0\n\0")
        return [u for u in text.split("\0") if u]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(self.normalised(x)) for x in texts]
        flat = iter(self.unit_ids([u for s in split for u in s]))
        return [b"".join(next(flat) for _ in s) for s in split]

    # --- chunks

    def relax(self, text: str, begin: int, end: int, best, back=None):
        """Best scores along the lattice, in place: pieces begin from `begin` to before `end` and may reach over it. best: row p is what leads to position p."""
        import numpy as np

        for p in range(begin, end):
            here = best[p]
            if not (here > -np.inf).any():
                continue
            found = [(n, arc[1], arc[0]) for n in range(1, min(self.longest, len(text) - p) + 1) if (arc := self.arcs.get(text[p : p + n]))]
            if not found or found[0][0] != 1:
                found.append((1, self.unknown, -1))
            for n, s, k in found:
                if back is None:
                    np.maximum(best[p + n], here + s, out=best[p + n])
                elif here[0] + s > best[p + n, 0]:
                    best[p + n, 0] = here[0] + s
                    back[p + n] = (p, k)

    def cut_span(self, text: str, n: int) -> tuple[int, int] | None:
        """The first and the last forced cut between the states at a chunk's begin and its end, or None."""
        if not self.cuts:
            return None
        cut = lambda p: text[p] == SPACE and text[p - 1] != SPACE
        first = next((p for p in range(self.longest, n) if cut(p)), None)
        last = next((p for p in range(n - 1, self.longest - 1, -1) if cut(p)), None)
        return None if first is None else (first, last)

    def transfer(self, text: str, n: int):
        """Transfer matrix of a chunk: text[:n], followed by what pieces may reach into. Row: state at its begin, column: at its end."""
        import numpy as np

        w = self.longest
        best = np.full((n + w + 1, w), -np.inf)
        best[np.arange(w), np.arange(w)] = 0.0
        span = self.cut_span(text, n)
        if span is None:
            self.relax(text, 0, n, best)
        else:
            first, last = span
            self.relax(text, 0, first, best)
            ids = np.frombuffer(b"".join(self.unit_ids(self.split(text[first:last]))), "<i4")
            best[last] = best[first] + self.total(ids)
            self.relax(text, last, n, best)
        return best[n : n + w].T

    def total(self, ids) -> float:
        """Score of ids; bytes count by the character that they spell."""
        import numpy as np

        if not hasattr(self, "score_array"):
            self.score_array = np.array(self.scores)
            lead = {b: self.unknown if b < 0x80 or b >= 0xC0 else 0.0 for b in self.byte_ids}
            for b, k in self.byte_ids.items():
                self.score_array[k] = lead[b]
        return float(self.score_array[ids].sum())

    def entries(self, text: str, n: int, prefix):
        """For each state at a chunk's end the one at its begin, -1 if none leads there. prefix: best score from the text's begin to each state at the chunk's."""
        import numpy as np

        w, span = self.longest, self.cut_span(text, n)
        stop = span[0] if span else n
        best, back = np.full((stop + w + 1, 1), -np.inf), {}
        best[:w, 0] = prefix
        self.relax(text, 0, stop, best, back)

        def entry(at):
            while at in back:
                at = back[at][0]
            return at

        if span:  # all paths meet at the cut
            reached = self.transfer(text, n).max(0) > -np.inf
            return np.where(reached, entry(stop), -1).astype("<i4")
        return np.array([entry(n + e) if best[n + e, 0] > -np.inf else -1 for e in range(w)], "<i4")

    def trace(self, text: str, n: int, begin: int, end: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the best path between the two states."""
        import numpy as np

        span = self.cut_span(text, n)
        first, last = span if span else (n, n)
        ids = self.path(text, begin, first if span else n, first if span else n + end)
        if span:
            ids += np.frombuffer(b"".join(self.unit_ids(self.split(text[first:last]))), "<i4").tolist()
            ids += self.path(text, last, n, n + end)
        return ids

    def path(self, text: str, begin: int, stop: int, end: int) -> list[int]:
        import numpy as np

        best, back = np.full((max(stop, end) + self.longest + 1, 1), -np.inf), {}
        best[begin] = 0.0
        self.relax(text, begin, stop, best, back)
        out = []
        while end > begin:
            p, k = back[end]
            out.append([k] if k >= 0 else [self.byte_ids[b] for b in text[p].encode()])
            end = p
        return [k for part in reversed(out) for k in part]


_loaded: dict[tuple[type, str], Spelling] = {}


def loaded(kind: type, path: str):
    take_worker("pieces", _loaded)
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def pieces(path: str) -> Pieces:
    return loaded(Pieces, path)


def combined(a, b):
    """Max-plus product: best over the states between."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def prefixes(matrices: list, prefix) -> list:
    """Best scores to the states at the begin of each of consecutive matrices."""
    out = [prefix]
    for m in matrices[:-1]:
        out.append((out[-1][:, None] + m).max(0))
    return out


def chained(maps: list):
    """One map from the states at the end of consecutive parts to those at their begin."""
    import numpy as np

    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = np.where(out >= 0, m[out], -1)
    return out


# --- Spark


def encode_short(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """docs with ids: each text in one piece. With `decoded`, the same worker decodes them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = model.encode([x or "" for x in part.column(part.schema.get_field_index("text")).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                texts = [pa.array([model.decode(np.frombuffer(x, "<i4").tolist()) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *texts], [*part.schema.names, "ids", *["decoded"] * decoded])

    fields_ = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields_}, ids array<int>" + ", decoded string" * decoded)


def giant_ids(texts: DataFrame, path: str, settings: Settings) -> DataFrame:
    """(uid, ids, chunks) of giant texts. texts: (uid, text), stored."""
    model = pieces(path)
    w, prefix, size, fan = model.longest, SPACE if model.prefix else "", settings.chunk, settings.fan
    whole = texts.select("uid", F.concat(F.lit(prefix), F.translate("text", " ", SPACE)).alias("s"))

    def cut(batches):
        """Each text's chunks in order, with what the longest piece may read beyond: slices, so that a text is walked once."""
        import pyarrow as pa

        for batch in batches:
            for uid, s in zip(batch.column(0), batch.column(1)):
                s = s.as_py()
                many = max(1, len(s) // size)
                for first in range(0, many, CUT):
                    own = [(k * size, len(s) if k == many - 1 else (k + 1) * size) for k in range(first, min(first + CUT, many))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid.as_py()] * len(own), batch.schema.field(0).type), pa.array(range(first, first + len(own)), pa.int32()), pa.array([many] * len(own), pa.int32()),
                         pa.array([y - x for x, y in own], pa.int32()), pa.array([s[x : y if y == len(s) else x + size + w] for x, y in own])],
                        ["uid", "chunk", "many", "n", "text"],
                    )

    chunks = whole.mapInArrow(cut, f"uid {texts.schema['uid'].dataType.simpleString()}, chunk int, many int, n int, text string")
    chunks = materialise(chunks.repartition("uid", "chunk"), "chunks")

    def matrices(batches):
        import pyarrow as pa

        m = pieces(path)
        for batch in batches:
            out = [m.transfer(t, n).tobytes() for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["uid", "k", "m"])

    def combine(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("k")
        ms = [np.frombuffer(x).reshape(w, w) for x in table["m"].to_pylist()]
        total = ms[0]
        for m in ms[1:]:
            total = combined(total, m)
        return pa.table({"uid": table["uid"][:1], "k": pa.array([table["k"][0].as_py() // fan], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    def chain(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("k")
        total = chained([np.frombuffer(x, "<i4") for x in table["m"].to_pylist()]).astype("<i4")
        return pa.table({"uid": table["uid"][:1], "k": pa.array([table["k"][0].as_py() // fan], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    def spread_prefix(key, table, above):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("k")
        found = prefixes([np.frombuffer(x).reshape(w, w) for x in table["m"].to_pylist()], np.frombuffer(above["prefix"][0].as_py()))
        return pa.table({"uid": table["uid"], "k": table["k"], "prefix": pa.array([x.tobytes() for x in found], pa.binary())})

    def spread_states(key, table, above):
        import numpy as np
        import pyarrow as pa

        table, ends = table.sort_by("k"), [above["end"][0].as_py()]
        for m in reversed(table["m"].to_pylist()):
            ends.append(int(np.frombuffer(m, "<i4")[ends[-1]]))
        ends.reverse()
        return pa.table({"uid": table["uid"], "k": table["k"], "begin": pa.array(ends[:-1], pa.int32()), "end": pa.array(ends[1:], pa.int32())})

    def entered(batches):
        import numpy as np
        import pyarrow as pa

        m = pieces(path)
        for batch in batches:
            out = [m.entries(t, n, np.frombuffer(x)).tobytes() for t, n, x in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["uid", "k", "m"])

    most = chunks.agg(F.max("many")).first()[0] or 1

    def tree(leaves, together, name):
        """The leaves, and above them blocks of ever more of them, up to one for each text."""
        levels, left = [materialise(leaves, name)], most
        while left > 1:
            levels.append(materialise(levels[-1].groupBy("uid", F.expr(f"k div {fan}").alias("block")).applyInArrow(together, "uid bigint, k int, m binary"), name))
            left = -(-left // fan)
        return levels

    def down(levels, top, spread, schema):
        rows = top
        for below in reversed(levels[:-1]):
            parts = below.withColumn("block", F.expr(f"cast(k div {fan} as int)")).groupBy("uid", "block")
            rows = parts.cogroup(rows.withColumnRenamed("k", "block").groupBy("uid", "block")).applyInArrow(spread, schema)
        return rows

    import numpy as np

    start = np.full(w, -np.inf)
    start[0] = 0.0
    levels = tree(chunks.select("uid", F.col("chunk").alias("k"), "text", "n").mapInArrow(matrices, "uid bigint, k int, m binary"), combine, "matrices")
    first = levels[-1].select("uid", "k", F.lit(bytearray(start.tobytes())).alias("prefix"))
    prefix = down(levels, first, spread_prefix, "uid bigint, k int, prefix binary").withColumnRenamed("k", "chunk")
    rows = chunks.join(prefix, ["uid", "chunk"]).select("uid", F.col("chunk").alias("k"), "text", "n", "prefix")
    levels = tree(rows.mapInArrow(entered, "uid bigint, k int, m binary"), chain, "entries")
    states = down(levels, levels[-1].select("uid", "k", F.lit(0).alias("begin"), F.lit(0).alias("end")), spread_states, "uid bigint, k int, begin int, end int")

    def traced(batches):
        import pyarrow as pa

        m = pieces(path)
        for batch in batches:
            uid, chunk, text, n, begin, end = (c.to_pylist() for c in batch.columns)
            ids = [m.trace(*x) for x in zip(text, n, begin, end)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.list_(pa.int32()))], ["uid", "chunk", "ids"])

    rows = chunks.join(states.withColumnRenamed("k", "chunk"), ["uid", "chunk"]).select("uid", "chunk", "text", "n", "begin", "end")
    parts = rows.mapInArrow(traced, "uid bigint, chunk int, ids array<int>")
    return parts.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda p: p["ids"])).alias("ids"), F.count("*").cast("int").alias("chunks"))


def encode(docs: DataFrame, path: str, settings: Settings = Settings(), decoded: bool = False) -> DataFrame:
    """docs with ids (of null and empty texts: none) and chunks, the number of parts in which the text was encoded.

    With `decoded` also as decode() has it; a short text is then encoded and decoded by one worker, where two operations
    in a row would have two at once for each task.
    """
    docs = docs.drop("ids", "chunks", *["decoded"] * decoded)
    long = F.length(text_of()) > settings.giant
    short = encode_short(docs.where(~long), path, decoded).withColumn("chunks", F.lit(1))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    giants = materialise(docs.where(long).select(F.monotonically_increasing_id().alias("uid"), whole), "giants")
    found = giant_ids(giants.select("uid", "row.text"), path, settings)
    giants = giants.join(found, "uid").select("row.*", "ids", "chunks")
    return short.unionByName(decode(giants, path) if decoded else giants)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with `decoded`, the text that their ids spell."""

    def run(batches):
        import pyarrow as pa

        model = loaded(Spelling, path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [model.decode(x or ()) for x in part.column(part.schema.get_field_index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    rows = rows.drop("decoded")
    fields_ = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields_}, decoded string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = encode(documents(spark, sf_dir).select("doc_id", "text"), path, decoded=True)
    return rows.select("doc_id", F.size("ids").alias("n_ids"), "chunks", "ids", (F.col("decoded") == text_of()).alias("round_trip"))
