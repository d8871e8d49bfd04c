"""The change log as a stream: at-least-once delivery with cursors that only advance, and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG_SCHEMA = "seq bigint, changed_at timestamp_ntz, entity_id bigint, kind string, value double, detail string"


def read_log(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """The log's files as they arrive. No watermark: late rows are delayed by the reader's lag, never dropped."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls send(batch, number). The checkpoint advances after it returns; a repeated batch has the same number, so a sink keyed by seq drops repeats."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(availableNow=True) if once else writer).start()


def idempotent_sink(path: str, key: str = "seq") -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number: a repeat overwrites itself."""

    def send(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return send


def windowed_requests(stream: DataFrame, key: str, at: str, most: int, seconds: int = 60) -> DataFrame:
    """Requests by key and clock window, and how many of them are refused."""
    counts = stream.groupBy(key, F.window(F.col(at).cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("begin"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def token_buckets(stream: DataFrame, key: str, at: str, per_second: float, burst: float) -> DataFrame:
    """(key, at, allowed): each key's bucket refills with time and gives one token a request. Requests of a batch are taken in time order."""

    def run(group: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        level, last = state.get if state.exists else (burst, None)
        rows = pd.concat(frames).sort_values(at)
        allowed = []
        for t in rows[at]:
            now = t.timestamp()
            level = min(burst, level + (0 if last is None else max(0.0, now - last) * per_second))
            last = now if last is None else max(last, now)
            allowed.append(level >= 1)
            level -= level >= 1
        state.update((float(level), float(last)))
        yield pd.DataFrame({key: group[0], at: rows[at].to_numpy(), "allowed": allowed})

    kind = dict(stream.dtypes)
    return stream.select(key, at).groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {at} {kind[at]}, allowed boolean", "level double, last double", "append", "NoTimeout")


# What ends a subscription. So many skips take the same time at one every two minutes.
DISABLE_AFTER_SECONDS, HARD_FAILURES, SKIPS = 72 * 3600, 3, 2160


def failure_step(state: tuple, kind: str, now: float) -> tuple:
    """The next (failures, class, since, active) of a subscription after an attempt of a class (ok, soft, hard, gone, transport, skipped or any other).

    failures counts a run of one class; since is when the first of an unbroken run of failures of any class began. A skipped event
    says nothing of the receiver: it counts as a run of its own and stops the clock.
    """
    failures, before, since, active = state
    if kind == "ok":
        return 0, "ok", None, active
    failures = failures + 1 if kind == before else 1
    if kind == "skipped":
        return failures, kind, None, active and failures < SKIPS
    since = now if since is None else since
    ended = kind == "gone" or (kind == "hard" and failures >= HARD_FAILURES) or now - since >= DISABLE_AFTER_SECONDS
    return failures, kind, since, active and not ended


def delivery_states(attempts: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """(key, failures, class, active) after each batch of attempts, taken in time order."""

    def run(group: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        now = tuple(state.get) if state.exists else (0, "ok", None, True)
        for t, k in pd.concat(frames).sort_values(at)[[at, kind]].itertuples(index=False):
            now = failure_step(now, k, t.timestamp())
        state.update(now)
        yield pd.DataFrame({key: [group[0]], "failures": [now[0]], "class": [now[1]], "active": [now[3]]})

    types = dict(attempts.dtypes)
    return attempts.select(key, at, kind).groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, failures int, class string, active boolean", "failures int, class string, since double, active boolean", "update", "NoTimeout")


def drained(stream: DataFrame, key: str = "subscription", seq: str = "seq", size: str = "bytes", wanted: str | None = None, most: int = 100, most_bytes: int = 512 * 1024, hold_seconds: int = 0) -> DataFrame:
    """(key, number, outcome, first_seq, last_seq, n) of a stream of (key, seq, bytes): deliveries in order of seq, each event once.

    A delivery has at most `most` events and `most_bytes`; it is halved until it fits. An event too large by itself is skipped, one
    whose seq lies at or below the key's cursor came late or again: both are told as outcomes of their own, never dropped in
    silence. Events that `wanted`, a predicate, leaves out move the cursor and are in no delivery. What doesn't fill a
    delivery is pending in the key's state until more comes, or until hold_seconds have passed; with 0 it goes out with its batch.
    A restarted query goes on with the state of its checkpoint, so nothing is delivered twice.
    """
    from lexlake.operators.feed import halved

    def run(group: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        cursor, number, seqs, sizes = state.get if state.exists else (-1, 0, [], [])
        pending, out = list(zip(seqs, sizes)), []
        if not state.hasTimedOut:
            for s, b, good in sorted(pd.concat(frames)[[seq, size, "_wanted"]].itertuples(index=False)):
                if s <= cursor:
                    out.append((None, "late", s, s, 1))
                    continue
                cursor = s
                if good:
                    pending.append((s, b))
        while pending and (len(pending) >= most or not hold_seconds or state.hasTimedOut):
            n = halved([b for _, b in pending[:most]], most_bytes)
            if n:
                out.append((number, "delivered", pending[0][0], pending[n - 1][0], n))
                number += 1
            else:
                out.append((None, "too large", pending[0][0], pending[0][0], 1))
            pending = pending[max(n, 1) :]
        state.update((int(cursor), number, [int(s) for s, _ in pending], [int(b) for _, b in pending]))
        if hold_seconds and pending:
            state.setTimeoutDuration(hold_seconds * 1000)
        if out:
            rows = pd.DataFrame(out, columns=["number", "outcome", "first_seq", "last_seq", "n"]).astype({"number": "Int64"})
            rows.insert(0, key, group[0])
            yield rows

    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, F.col(seq).cast("bigint").alias(seq), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size), (F.coalesce(F.expr(wanted), F.lit(False)) if wanted else F.lit(True)).alias("_wanted"))
    out = f"{key} {kind}, number bigint, outcome string, first_seq bigint, last_seq bigint, n bigint"
    return rows.groupBy(key).applyInPandasWithState(run, out, "cursor bigint, number bigint, seqs array<bigint>, sizes array<bigint>", "append", "ProcessingTimeTimeout" if hold_seconds else "NoTimeout")


def upsert_stream(stream: DataFrame, snapshot: str, key: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key: every batch makes the next numbered snapshot out of the one before."""
    from lexlake.operators.joins import upsert

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*")
        if number:
            newest = upsert(newest, spark.read.schema(batch.schema).parquet(f"{snapshot}/version={number - 1}"), key)
        newest.write.mode("overwrite").parquet(f"{snapshot}/version={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
