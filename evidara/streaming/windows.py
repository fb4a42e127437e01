"""Structured Streaming twins of the batch operators: the same DataFrame code over a stream."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidara.plans.storage import shared_dir

#: Rows later than this behind the newest one are late.
LATENESS = "7 days"


def instant(column: str = "ts"):
    """A TIMESTAMP_NTZ column as an instant in UTC, whatever the session's time zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}))")


def chunks(samples: DataFrame, duration: str = "6 hours", stride: str = "3 hours") -> DataFrame:
    """(user_id, start_s, n, total) of fixed, possibly overlapping windows of arriving samples (user_id, at, value)."""
    w = samples.withWatermark("at", LATENESS) if samples.isStreaming else samples
    g = w.groupBy("user_id", F.window("at", duration, stride).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.unix_seconds("w.start").alias("start_s"), "n", F.round("total", 4).alias("total"))


def _summed(parts: list) -> tuple:
    """(starts, counts, sums) of several such triples, a start once, in order."""
    start, n, total = (np.concatenate(x) for x in zip(*parts, strict=True))
    start, at = np.unique(start, return_inverse=True)
    return start, np.bincount(at, n, len(start)).astype(np.int64), np.bincount(at, total, len(start))


class Chunks(StatefulProcessor):
    """The open windows of a user: a count and a sum for each, until the watermark passes its end.

    They are one value of the state, read and written once a batch, with a timer at the first end: a window by itself would be some calls of the state store.
    A row for a window that has been passed is late: it is written as such and changes nothing."""

    def __init__(self, length: int, stride: int):
        self.length, self.stride = length, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, ns array<long>, totals array<double>")

    def _rows(self, kind: str, key, windows: tuple) -> pd.DataFrame:
        start, n, total = windows
        return pd.DataFrame({"kind": kind, "user_id": pd.Series([key[0]] * len(start)), "start_s": start, "n": n, "total": total})

    def _split(self, windows: tuple, timerValues) -> tuple[tuple, tuple]:
        """The windows that the watermark has passed, and the others."""
        over = (windows[0] + self.length) * 1000 <= timerValues.getCurrentWatermarkInMs()
        return tuple(x[over] for x in windows), tuple(x[~over] for x in windows)

    def _known(self) -> tuple:
        return tuple(np.array(x, t) for x, t in zip(self.open.get() or ([], [], []), (np.int64, np.int64, float), strict=True))

    def _keep(self, windows: tuple) -> None:
        self.open.update(tuple(x.tolist() for x in windows))

    def handleInputRows(self, key, rows, timerValues):
        parts = []
        for f in rows:
            s, value = f["s"].to_numpy(), f["value"].to_numpy()
            for back in range(0, self.length, self.stride):
                start = s - s % self.stride - back
                inside = s < start + self.length
                parts.append((start[inside], np.ones(inside.sum(), np.int64), value[inside]))
        late, new = self._split(_summed(parts), timerValues)
        if len(new[0]):
            known = self._known()
            if not len(known[0]) or new[0][0] < known[0][0]:
                self.handle.registerTimer((int(new[0][0]) + self.length) * 1000)
            self._keep(_summed([known, new]))
        if len(late[0]):
            yield self._rows("late", key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        over, left = self._split(self._known(), timerValues)
        if not len(over[0]):  # an earlier timer has come first
            return
        if len(left[0]):
            self.handle.registerTimer((int(left[0][0]) + self.length) * 1000)
            self._keep(left)
        else:
            self.open.clear()
        yield self._rows("chunk", key, over)

    def close(self) -> None:
        pass


def chunks_and_late(samples: DataFrame, length: int = 6 * 3600, stride: int = 3 * 3600) -> DataFrame:
    """(kind, user_id, start_s, n, total) from a stream (user_id, at, value): 'chunk' for windows (of seconds) that the watermark has closed, 'late' for what came after that.

    Every row counts once for each of its windows: in a chunk, as late, or in the state of a window that is still open. The state of a user is its open windows. Needs the state store of RocksDB."""
    s = samples.withWatermark("at", LATENESS).select("user_id", F.unix_seconds("at").alias("s"), F.col("value").cast("double").alias("value"))
    kind = samples.schema["user_id"].dataType.simpleString()
    return s.groupBy("user_id").transformWithStateInPandas(Chunks(length, stride), f"kind string, user_id {kind}, start_s long, n long, total double", "Append", "EventTime")


#: Groups of keys, by their hash, whose figures are one value of the state. Python is called for each of them in a batch, and not for each key.
BUCKETS = 1024
KNOWN = pa.schema([("key", pa.string()), ("split", pa.string()), ("n", pa.int64()), ("newest", pa.int64())])


def _added(parts: list[pa.Table]) -> pa.Table:
    """One row for each key and split."""
    t = pa.concat_tables(parts).group_by(["key", "split"]).aggregate([("n", "sum"), ("newest", "max")])
    return t.select(["key", "split", "n_sum", "newest_max"]).rename_columns(KNOWN.names)


def _by_key(known: pa.Table) -> pa.Table:
    """(key, n_sum, newest_max, split_count) of rows for each key and split; no split is none."""
    return known.group_by("key").aggregate([("n", "sum"), ("newest", "max"), ("split", "count")])


def _seen(bucket, frames, state):
    """What has been seen of a bucket's keys: a row for each that has come again, or in another split; a key is forgotten when the watermark has passed its last row."""
    mark, known = state.getCurrentWatermarkMs(), KNOWN.empty_table()
    if state.exists:
        known = pa.ipc.open_stream(state.get[0]).read_all()
        old = _by_key(known)
        known = known.filter(pc.invert(pc.is_in(known["key"], old.filter(pc.less(old["newest_max"], mark))["key"])))
    found = None
    if not state.hasTimedOut:
        new = KNOWN.empty_table()
        for f in frames:
            arrived = pa.Table.from_pandas(f[["key", "split", "at_ms"]].assign(n=1)[["key", "split", "n", "at_ms"]], preserve_index=False).rename_columns(KNOWN.names).cast(KNOWN)
            new = _added([new, arrived])
        known = _added([known, new])
        k = _by_key(known)
        k = k.filter(pc.and_(pc.is_in(k["key"], new["key"]), pc.or_(pc.greater(k["n_sum"], 1), pc.greater(k["split_count"], 1))))
        found = pd.DataFrame({"key": k["key"].to_pylist(), "n": k["n_sum"].to_numpy(), "n_splits": k["split_count"].to_numpy()})
    if known.num_rows:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, KNOWN) as w:
            w.write_table(known.combine_chunks())
        state.update((out.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(pc.min(_by_key(known)["newest_max"]).as_py(), mark) + 1)
    elif state.exists:
        state.remove()
    if found is not None and len(found):
        yield found


def seen(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, n_splits) of keys that come more than once, from a stream (``key``, split, at); a row each time that a key's figures grow, so the last one counts.

    A key is kept until the watermark, LATENESS behind the newest row, has passed its last row: the state holds the keys of the last LATENESS. Late rows are dropped."""
    k = rows.withWatermark("at", LATENESS).select(F.col(key).cast("string").alias("key"), F.col("split").cast("string").alias("split"), F.unix_millis("at").alias("at_ms"), "at")
    k = k.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return k.groupBy("bucket").applyInPandasWithState(_seen, "key string, n long, n_splits long", "known binary", "append", "EventTimeTimeout")


def first_copies(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """The first row of each id within LATENESS of it."""
    return samples.withWatermark("at", LATENESS).dropDuplicatesWithinWatermark([key])


def settled(found: DataFrame) -> DataFrame:
    """The last word of ``seen`` on each key."""
    return found.groupBy("key").agg(F.max("n").alias("n"), F.max("n_splits").alias("n_splits"))


STATE = "reach double, starts array<double>, ends array<double>, ids array<long>"


def _released(key, frames, state):
    """Of one recording: windows that began before the watermark are decided in order, the others wait."""
    reach, starts, ends, ids = state.get if state.exists else (float("-inf"), [], [], [])
    rows = list(zip(starts, ends, ids, strict=True))
    for f in frames:
        rows += zip(f["start_s"].tolist(), f["end_s"].tolist(), f["event_id"].tolist(), strict=True)
    rows.sort()
    mark, kept, n = state.getCurrentWatermarkMs(), [], 0
    while n < len(rows) and rows[n][0] * 1000 < mark:
        if rows[n][0] >= reach:
            reach = rows[n][1]
            kept.append(rows[n][2])
        n += 1
    wait = rows[n:]
    state.update((reach, [r[0] for r in wait], [r[1] for r in wait], [r[2] for r in wait]))
    if wait:
        state.setTimeoutTimestamp(max(int(wait[0][0] * 1000), mark) + 1)
    yield pd.DataFrame({"event_id": pd.Series(kept, dtype="int64")})


def drop_later(windows: DataFrame) -> DataFrame:
    """(event_id) of the windows that the greedy choice keeps, from a stream of (recording_id, event_id, start_s, end_s, at), ``at`` being the instant of start_s.

    Windows wait until the watermark has passed their start, so that they are judged in order; the state of a recording is the end of its last kept window
    and what waits, which LATENESS bounds. The result is that of the batch form for windows that are not late."""
    w = windows.withWatermark("at", LATENESS).groupBy("recording_id")
    return w.applyInPandasWithState(_released, "event_id long", STATE, "append", "EventTimeTimeout")


def drain(stream: DataFrame, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run a stream over what is there now, and return what it wrote; ``progress`` gets Spark's report of each batch.

    Append streams go to Parquet; others, which revise rows, write each batch whole and the last one counts."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{base}/out")
    else:
        writer = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out"))
    run = writer.start()
    run.awaitTermination()
    if progress is not None:
        progress += run.recentProgress
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@contextlib.contextmanager
def rocks_db(spark: SparkSession):
    """The state store that processors with timers need, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The Parquet files at ``path``, a folder or one file, as a stream; a stream takes one file by a pattern only."""
    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = f"{folder}/[{name[0]}]{name[1:]}"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
