"""Timestamped windows of a recording: islands, coverage, and assembly of their texts.

A recording may hold any share of all windows, so nothing here orders one in a task: windows are cut into slices by range, a figure of each
slice is folded over the slices of its recording, and places are worked out inside slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.plans.slices import carried, sliced, tasks
from evidara.plans.storage import staged

ORDER = ["start_s", "end_s", "event_id"]


def _slices(windows: DataFrame) -> DataFrame:
    return sliced(windows, ["recording_id", *ORDER])


def _inside(last: int) -> Window:
    return Window.partitionBy("recording_id", "slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, last)


def _reached(windows: DataFrame) -> DataFrame:
    """Sliced windows with ``reach``, the latest end of all windows before each in its recording; null for the first."""
    w = carried(_slices(windows), "recording_id", before={"reach_0": (F.max("end_s"), F.max)})
    return w.withColumn("reach", F.greatest("reach_0", F.max("end_s").over(_inside(-1)))).drop("reach_0")


def islands(windows: DataFrame) -> DataFrame:
    """The windows with ``island``, numbered per recording: transitively overlapping ones share it; touching does not connect."""
    new = F.when(F.col("reach").isNull() | (F.col("start_s") >= F.col("reach")), 1).otherwise(0)
    w = carried(_reached(windows).withColumn("new_", new), "recording_id", before={"base_": (F.sum("new_"), F.sum)})
    return w.withColumn("island", F.coalesce("base_", F.lit(0)) + F.sum("new_").over(_inside(0))).drop("reach", "new_", "base_", "slice")


def coverage(windows: DataFrame) -> DataFrame:
    """Per recording: union length, total overlap, count and total length of gaps."""
    return _coverage(_reached(windows))


def _coverage(w: DataFrame) -> DataFrame:
    gap = F.when(F.col("start_s") > F.col("reach"), F.col("start_s") - F.col("reach"))
    overlap = F.when(F.col("start_s") <= F.col("reach"), F.least("reach", "end_s") - F.col("start_s")).otherwise(0.0)
    fresh = F.greatest(F.lit(0.0), F.col("end_s") - F.greatest("start_s", F.coalesce("reach", "start_s")))
    return w.groupBy("recording_id").agg(F.sum(fresh).alias("union_s"), F.sum(overlap).alias("overlap_s"), F.count(gap).alias("gaps"), F.coalesce(F.sum(gap), F.lit(0.0)).alias("gap_s"), F.count("*").alias("windows"))


def gaps(windows: DataFrame) -> DataFrame:
    """(recording_id, gap_start_s, gap_end_s) of every stretch between two windows that none covers."""
    return _reached(windows).where("start_s > reach").select("recording_id", F.col("reach").alias("gap_start_s"), F.col("start_s").alias("gap_end_s"))


def drop_earlier(windows: DataFrame) -> DataFrame:
    """A window stays if no later window overlaps it; the next row has the smallest later start."""
    w = carried(_slices(windows), "recording_id", after={"first_": (F.min("start_s"), F.lead)})
    nxt = F.coalesce(F.lead("start_s").over(Window.partitionBy("recording_id", "slice").orderBy(*ORDER)), "first_")
    return w.withColumn("nxt", nxt).where(F.col("nxt").isNull() | (F.col("nxt") >= F.col("end_s"))).drop("nxt", "first_", "slice")


def _ordered(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the row that follows each kept row: the first one that begins at or after its end."""
    start, end = p["start_s"].to_numpy(), p["end_s"].to_numpy()
    return start, end, np.maximum(np.searchsorted(start, end, side="left"), np.arange(len(p)) + 1)


def _steps(p: pd.DataFrame) -> pd.DataFrame:
    """A slice as a step function of the end of the last window kept before it: the end of the last one kept after it.

    Paths of kept windows soon meet, so it has few steps: one for each end that a path leaves the slice with."""
    p = p.sort_values(ORDER, ignore_index=True)
    start, end, follows = _ordered(p)
    leaves = end.copy()
    for i in range(len(p) - 1, -1, -1):
        if follows[i] < len(p):
            leaves[i] = leaves[follows[i]]
    first = np.concatenate([[True], start[1:] != start[:-1]])  # a path enters at the first of equal starts
    at, to = start[first], leaves[first]
    keep = np.concatenate([to[1:] != to[:-1], [True]])
    return pd.DataFrame({"recording_id": p["recording_id"].iloc[0], "slice": p["slice"].iloc[0], "until": [at[keep]], "leaves": [to[keep]]})


def _entries(p: pd.DataFrame) -> pd.DataFrame:
    """The slices of a recording, in order: the end of the last window kept before each."""
    p = p.sort_values("slice", ignore_index=True)
    reach, out = -np.inf, []
    for until, leaves in zip(p["until"], p["leaves"], strict=True):
        out.append(reach)
        k = np.searchsorted(until, reach, side="left")  # the first step that begins at or after it
        reach = leaves[k] if k < len(until) else reach
    return pd.DataFrame({"recording_id": p["recording_id"], "slice": p["slice"], "reach": out})


def _groups(batches):
    """Batches that end with a whole slice of a recording, and where its slices begin and end; rows come in order. A slice may lie in several batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        same = pc.and_(*(pc.equal(b.column(c)[1:], b.column(c)[:-1]) for c in ("recording_id", "slice"))).to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist()]
        held = b.slice(cuts[-1])
        if len(cuts) > 1:
            yield b.slice(0, cuts[-1]), cuts
    if held is not None:
        yield held, [0, held.num_rows]


def _kept(batches):
    """The windows kept of each slice, from the end of the last one kept before it; very many short recordings cost some calls of numpy each."""
    for b, cuts in _groups(batches):
        start, end, reach = (b.column(c).to_numpy(zero_copy_only=False) for c in ("start_s", "end_s", "reach"))
        kept = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = start[lo:hi]
            follows = np.maximum(np.searchsorted(s, end[lo:hi], side="left"), np.arange(1, hi - lo + 1)).tolist()
            i = int(np.searchsorted(s, reach[lo], side="left"))
            while i < hi - lo:
                kept.append(lo + i)
                i = follows[i]
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("recording_id", "event_id")], names=["recording_id", "event_id"])


def drop_later(windows: DataFrame) -> DataFrame:
    """(recording_id, event_id), greedy in order: a window stays if it starts at or after the end of the last that stayed.

    What a slice does to that end is a step function; a fold over the functions of a recording tells each slice where it begins. Only recordings that lie in
    several slices need this, at most one for each slice; the others begin with nothing kept."""
    id_, event = (windows.schema[c].dataType.simpleString() for c in ("recording_id", "event_id"))
    d = _slices(windows.where("recording_id is not null").select("recording_id", *[F.col(c).cast("double").alias(c) for c in ORDER[:2]], "event_id"))
    several = d.groupBy("recording_id").agg(F.min("slice").alias("low_"), F.max("slice").alias("high_")).where("low_ < high_").select("recording_id")
    steps = d.join(several, "recording_id", "left_semi").groupBy("recording_id", "slice").applyInPandas(_steps, f"recording_id {id_}, slice int, until array<double>, leaves array<double>")
    entries = staged(steps.groupBy("recording_id").applyInPandas(_entries, f"recording_id {id_}, slice int, reach double"), "entries")
    rows = d.join(entries, ["recording_id", "slice"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("-inf"))))
    order = ["recording_id", "slice", *[F.asc_nulls_last(c) for c in ORDER]]
    return rows.repartition(tasks(d), "recording_id", "slice").sortWithinPartitions(*order).mapInArrow(_kept, f"recording_id {id_}, event_id {event}")


def _texts(*columns: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda x: x[columns[-1]]), " ")


def concatenated(windows: DataFrame) -> DataFrame:
    """Texts of a recording in time order, slice by slice, with its span and coverage."""
    w = _reached(windows)
    t = w.groupBy("recording_id", "slice").agg(_texts(*ORDER, "prediction_text").alias("text"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    t = t.groupBy("recording_id").agg(_texts("slice", "text").alias("text"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    full = F.abs(F.col("union_s") - (F.col("end_s") - F.col("start_s"))) <= 1e-12 * F.greatest(F.lit(1.0), F.col("end_s"))
    return t.join(_coverage(w), "recording_id").withColumn("full", full)


def timing(windows: DataFrame) -> DataFrame:
    """Compute seconds (null unless every window is timed), real-time factor, latency mean and maximum."""
    t = windows.groupBy("recording_id").agg(
        F.when(F.count("inference_duration_s") == F.count("*"), F.sum("inference_duration_s")).alias("compute_s"),
        F.avg(F.col("emitted_at_s") - F.col("end_s")).alias("latency_mean_s"),
        F.max(F.col("emitted_at_s") - F.col("end_s")).alias("latency_max_s"),
    )
    return t.join(coverage(windows).select("recording_id", "union_s"), "recording_id").withColumn("real_time_factor", F.col("compute_s") / F.col("union_s"))


#: Pairs in a batch that leaves a sweep.
PAIRS = 1 << 16


def _swept(tolerance: float):
    """Rows of one slice after another, its own windows first and in order, then probes; each probe meets a run of the slice's windows.

    Only a slice's own windows are held; pairs leave as they are found."""

    def met(probe: pa.RecordBatch, own: pa.RecordBatch, low: np.ndarray):
        """Pairs of probes with the windows that lie from place ``low`` on and begin before the probe's end."""
        start = own.column("start_s").to_numpy()
        n = np.maximum(np.searchsorted(start, probe.column("end_s").to_numpy() + tolerance, side="left") - low, 0)
        upto = np.concatenate([[0], np.cumsum(n)])
        for at in range(0, int(upto[-1]), PAIRS):
            k = np.arange(at, min(at + PAIRS, int(upto[-1])))
            left = np.searchsorted(upto, k, side="right") - 1
            right = low[left] + k - upto[left]
            ok = probe.column("start_s").to_numpy()[left] < own.column("end_s").to_numpy()[right] + tolerance
            a, b = probe.take(pa.array(left[ok])), own.take(pa.array(right[ok]))
            yield pa.RecordBatch.from_arrays([a.column("recording_id"), *(x.column(c) for c in ("event_id", "split") for x in (a, b))], names=["recording_id", "left_id", "right_id", "left_split", "right_split"])

    def run(batches):
        held, own, key = [], None, None

        def seal():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return whole, met(whole, whole, np.arange(1, whole.num_rows + 1))

        for b in batches:
            if not b.num_rows:
                continue
            same = pc.and_(*(pc.equal(b.column(c)[1:], b.column(c)[:-1]) for c in ("recording_id", "slice")))
            same = pc.and_(same, pc.equal(b.column("probe")[1:], b.column("probe")[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), b.num_rows]
            for part in (b.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)):
                now = (part.column("recording_id")[0].as_py(), part.column("slice")[0].as_py())
                if now != key:
                    if held:
                        yield from seal()[1]
                    held, own, key = [], None, now
                if not part.column("probe")[0].as_py():
                    held.append(part)
                    continue
                if own is None:
                    own, found = seal()
                    held = []
                    yield from found
                yield from met(part, own, np.zeros(part.num_rows, dtype=np.int64))
        if held:
            yield from seal()[1]

    return run


def overlap_pairs(windows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(recording_id, left_id, right_id, left_split, right_split) of overlapping windows, left before right in (start, id) order.

    A sweep over sorted slices: the windows that a window meets later are a run of its slice, found by bisection, so what is compared is
    what is found (windows without length aside). A window that reaches beyond its slice is also sent to the later slices that it reaches. Slices
    are cut by range, so windows of any recording and hour may crowd. A window without a recording meets none."""
    names = ("recording_id", "event_id", "start_s", "end_s", "split")
    times = {c: F.col(c).cast("double") for c in ("start_s", "end_s")}
    d = sliced(windows.where("recording_id is not null").select(*names).withColumns(times), ["recording_id", "start_s", "event_id"])
    bounds = d.groupBy("recording_id", "slice").agg(F.min("start_s").alias("low_"), F.max("end_s").alias("high_"))  # a row for each slice of a recording
    beyond = F.lead("low_").over(Window.partitionBy("recording_id").orderBy("slice")) < F.col("high_") + tolerance
    reach = bounds.withColumn("beyond_", beyond).where("beyond_").select("recording_id", "slice")
    others = bounds.select("recording_id", F.col("slice").alias("other_"), "low_")
    far = d.join(reach, ["recording_id", "slice"]).join(others, "recording_id").where((F.col("other_") > F.col("slice")) & (F.col("low_") < F.col("end_s") + tolerance))
    rows = d.select(*names, "slice", F.lit(0).alias("probe")).unionByName(far.select(*names, F.col("other_").alias("slice"), F.lit(1).alias("probe")))
    rows = rows.repartition(tasks(d), "recording_id", "slice").sortWithinPartitions("recording_id", "slice", "probe", "start_s", "event_id")
    kind = {c: windows.schema[c].dataType.simpleString() for c in names}
    return rows.mapInArrow(_swept(tolerance), f"recording_id {kind['recording_id']}, left_id {kind['event_id']}, right_id {kind['event_id']}, left_split {kind['split']}, right_split {kind['split']}")
