"""Media columns: Matroska bytes parsed into packet tables, and payloads stored losslessly as 8-bit PCM.

A null text is stored as an empty one, an empty one as 64 zero samples. A null or malformed media value gives no
packets after the defect, and its `error` says what it was; equal bytes give equal rows. Extra columns pass through.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, text_of

# Element ids of the Matroska specification (fixed values).
EBML, DOC_TYPE, SEGMENT = 0x1A45DFA3, 0x4282, 0x18538067
INFO, TIMESTAMP_SCALE, DURATION = 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO = 0x9C, 0x23E383, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

SAMPLE_RATE = 8_000
FRAME_BYTES = 1_024  # 128 ms
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 8
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3
LACING_NAMES = ("none", "xiph", "fixed", "ebml")


# --- writing


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones value of a width means unknown and isn't used for known sizes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    """Body of a SimpleBlock with the frames laced as asked for."""
    head = vint(track) + struct.pack(">hB", relative, (0x80 if key else 0) | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    sizes = [len(x) for x in frames]
    table = bytes([len(frames) - 1])
    if lacing == XIPH_LACING:
        table += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        table += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(n - before) < 1 << 7 * w - 1)
            table += vint(n - before + (1 << 7 * width - 1) - 1, width)
    return head + table + b"".join(frames)


def pcm_file(payload: bytes) -> bytes:
    """A Matroska file whose one track holds the payload as unsigned 8-bit mono samples."""
    header = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", SAMPLE_RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(0x4D80, b"lexlake") + element(0x5741, b"lexlake"))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME_BYTES * 10**9 // SAMPLE_RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    clusters, cues, at = [], [], len(info) + len(tracks)
    span = FRAME_BYTES * FRAMES_A_BLOCK
    for begin in range(0, len(payload), span * BLOCKS_A_CLUSTER):
        start_ms = begin * 1000 // SAMPLE_RATE
        body = [uint(CLUSTER_TIMESTAMP, start_ms)]
        for b in range(begin, min(len(payload), begin + span * BLOCKS_A_CLUSTER), span):
            frames = [payload[i : i + FRAME_BYTES] for i in range(b, min(len(payload), b + span), FRAME_BYTES)]
            lacing = NO_LACING if len(frames) == 1 else FIXED_LACING if len(frames[-1]) == FRAME_BYTES else EBML_LACING
            body.append(element(SIMPLE_BLOCK, block(1, b * 1000 // SAMPLE_RATE - start_ms, frames, lacing)))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start_ms) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return header + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)))


# --- reading


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp_ns, cluster, offset, length, lacing, keyframe); cues: (time_ns, track, cluster offset in the file)."""

    doc_type: str = ""
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    clusters: int = 0
    error: str | None = None


class Malformed(ValueError):
    pass


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, place after it, whether all its bits are ones)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


#: Elements that may contain others read here, and the ids that end one of unknown size.
MASTERS = {SEGMENT, CLUSTER, TRACKS, TRACK_ENTRY, INFO, CUES, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP, AUDIO, EBML}
TOP_LEVEL = {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML}


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Malformed(f"empty lace at byte {at}")
    count, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        if (end - at) % count:
            raise Malformed(f"uneven fixed lace at byte {at}")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    while len(sizes) < count - 1:
        if lacing == XIPH_LACING:
            n = 0
            while at < end and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise Malformed(f"cut off lace at byte {at}")
            n, at = n + data[at], at + 1
        else:
            begin = at
            n, at, _ = read_vint(data, at)
            if sizes:
                n += sizes[-1] - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed(f"lace longer than its block at byte {at}")
    return sizes, at


def parse(data: bytes | None) -> Media:
    """Walks the elements once, in file order."""
    media = Media()
    scale, cluster_time, segment_at = 1_000_000, 0, 0
    entry: dict = {}
    cue: dict = {}
    open_: list[tuple[int, int]] = []  # (id, end) of the masters that stand open

    def number(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def blocks(at: int, end: int, simple: bool) -> None:
        track, at, _ = read_vint(data, at)
        if at + 3 > end:
            raise Malformed(f"cut off block at byte {at}")
        relative, flags = struct.unpack_from(">hB", data, at)
        lacing = flags >> 1 & 3
        sizes, at = lace_sizes(data, at + 3, end, lacing)
        time = (cluster_time + relative) * scale
        step = media.tracks.get(track, {}).get("default_duration_ns", 0)
        for k, n in enumerate(sizes):
            media.packets.append((track, time + k * step, media.clusters - 1, at, n, LACING_NAMES[lacing], bool(flags & 0x80) if simple else None))
            at += n

    def closed(name: int) -> None:
        nonlocal cue
        if name == TRACK_ENTRY and "number" in entry:
            media.tracks[entry["number"]] = dict(entry)
        elif name == CUE_POSITIONS:
            media.cues.append((cue.get("time", 0) * scale, cue.get("track", 0), segment_at + cue.get("cluster", 0)))

    at, size_of = 0, len(data or b"")
    try:
        while at < size_of:
            while open_ and at >= open_[-1][1]:
                closed(open_.pop()[0])
            name, after, _ = read_vint(data, at, True)
            size, body, unknown = read_vint(data, after)
            while open_ and open_[-1][1] == size_of and name in TOP_LEVEL and open_[-1][0] == CLUSTER:  # one of unknown size ends here
                closed(open_.pop()[0])
            end = size_of if unknown else body + size
            if end > size_of:
                raise Malformed(f"element {name:X} at byte {at} ends behind the file")
            if name in MASTERS:
                open_.append((name, end))
                if name == SEGMENT:
                    segment_at = body
                elif name == CLUSTER:
                    media.clusters += 1
                elif name == TRACK_ENTRY:
                    entry = {}
                elif name == CUE_POINT:
                    cue = {}
                at = body
                continue
            if name == SIMPLE_BLOCK or name == BLOCK:
                blocks(body, end, name == SIMPLE_BLOCK)
            elif name == CLUSTER_TIMESTAMP:
                cluster_time = number(body, end)
            elif name == TIMESTAMP_SCALE:
                scale = number(body, end)
            elif name == DOC_TYPE:
                media.doc_type = data[body:end].decode("ascii", "replace")
            elif name == TRACK_NUMBER:
                entry["number"] = number(body, end)
            elif name == TRACK_TYPE:
                entry["type"] = number(body, end)
            elif name == DEFAULT_DURATION:
                entry["default_duration_ns"] = number(body, end)
            elif name == CODEC_ID:
                entry["codec"] = data[body:end].decode("ascii", "replace")
            elif name == SAMPLING_FREQUENCY:
                entry["rate"] = struct.unpack(">d" if end - body == 8 else ">f", data[body:end])[0]
            elif name == CHANNELS:
                entry["channels"] = number(body, end)
            elif name == BIT_DEPTH:
                entry["bits"] = number(body, end)
            elif name == CUE_TIME:
                cue["time"] = number(body, end)
            elif name == CUE_TRACK:
                cue["track"] = number(body, end)
            elif name == CUE_CLUSTER:
                cue["cluster"] = number(body, end)
            at = end
        while open_:
            closed(open_.pop()[0])
    except (Malformed, struct.error) as defect:
        media.error = str(defect)
    if data and not media.doc_type and not media.error:
        media.error = "no EBML header"
    return media


# --- Spark


PACKETS = "array<struct<track:bigint,timestamp_ns:bigint,cluster:bigint,offset:bigint,length:bigint,lacing:string,keyframe:boolean>>"
CUE_ROWS = "array<struct<time_ns:bigint,track:bigint,cluster_offset:bigint>>"


def media_columns(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with packets, cues and error of its media column: the tables of one file in each row. explode() gives a flat packet table."""

    def run(batches):
        import pyarrow as pa

        packet = pa.list_(pa.struct([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("cluster", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("lacing", pa.string()), ("keyframe", pa.bool_())]))
        cue = pa.list_(pa.struct([("time_ns", pa.int64()), ("track", pa.int64()), ("cluster_offset", pa.int64())]))
        for batch in batches:
            parsed = [parse(x) for x in batch.column(batch.schema.get_field_index(media_col)).to_pylist()]
            rows = [[dict(zip(("track", "timestamp_ns", "cluster", "offset", "length", "lacing", "keyframe"), p)) for p in m.packets] for m in parsed]
            cues = [[dict(zip(("time_ns", "track", "cluster_offset"), c)) for c in m.cues] for m in parsed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, packet), pa.array(cues, cue), pa.array([m.error for m in parsed], pa.string())], [*batch.schema.names, "packets", "cues", "error"])

    kept = df.drop("packets", "cues", "error")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, packets {PACKETS}, cues {CUE_ROWS}, error string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 text, zero-padded to a positive multiple of 64, as a Matroska PCM file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            files = [pcm_file(x + bytes(-len(x) % 64 or (0 if x else 64))) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def payload_digests(media: DataFrame) -> DataFrame:
    """Digests and features of the samples that the packets' byte ranges hold. media: (doc_id, n_bytes, media, packets, cues, error)."""

    def run(batches):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for doc_id, n, data, packets, cues in zip(*(batch.column(k).to_pylist() for k in range(5))):
                payload = b"".join(data[p["offset"] : p["offset"] + p["length"]] for p in packets)
                x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
                crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
                span = (packets[-1]["timestamp_ns"] - packets[0]["timestamp_ns"]) // 1_000_000
                feature = f"pcm8 packets={len(packets)} clusters={packets[-1]['cluster'] + 1} cues={len(cues)} span_ms={span} energy={int(np.square(x, dtype=np.int64).sum())} crossings={crossings} peak={int(np.abs(x).max())}"
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = zip(*out) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media", "packets", "cues").mapInArrow(run, schema)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text through stored Matroska bytes and back."""
    stored = materialise(store_texts(documents(spark, sf_dir)), "media", **{"parquet.block.size": str(32 << 20)})
    return payload_digests(media_columns(stored))
