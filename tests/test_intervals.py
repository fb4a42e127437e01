"""Interval operators on sliced recordings against plain loops, with all windows in one recording and most of them in one hour."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from evidara.operators import audit as A
from evidara.operators import intervals as I
from evidara.operators import splits as S
from evidara.plans import slices

SCHEMA = "recording_id long, event_id long, start_s double, end_s double, prediction_text string, inference_duration_s double, emitted_at_s double, split string"


def some(seed, n, recordings, crowded=0.9, length=4.0):
    """Windows of which most begin in a few of many seconds; some have no length, some are very long, starts repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = round(rng.uniform(500, 520) if rng.random() < crowded else rng.uniform(0, 100_000), 1)
        b = a + rng.choice((0.0, round(rng.uniform(0, length), 1), round(rng.uniform(0, length), 1), 40.0 if rng.random() < 0.05 else 0.3))
        rows.append((None if recordings > 1 and rng.random() < 0.03 else rng.randrange(recordings), i, a, b, f"t{i % 9}", 0.1, b + 1, rng.choice(("train", "test", None))))
    return rows


@pytest.fixture(params=[(1, 300, 1, 16, 0.3), (2, 400, 3, 7, 3.0), (3, 60, 20, 1 << 16, 3.0), (4, 250, 1, 3, 0.1)], ids=["one recording", "three", "small", "slices of three"])
def case(request, spark, monkeypatch):
    seed, n, recordings, size, length = request.param
    monkeypatch.setattr(slices, "SLICE_ROWS", size)
    rows = some(seed, n, recordings, length=length)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_recording(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        out[r[0]].append(r)
    return out


def test_pairs(case):
    rows, df = case
    for tolerance in (0.0, 0.5):
        want = set()
        for rec, ws in by_recording(rows).items():
            ws = sorted(ws, key=lambda r: (r[2], r[1]))
            want |= {(a[1], b[1]) for i, a in enumerate(ws) for b in ws[i + 1 :] if rec is not None and a[2] < b[3] + tolerance and b[2] < a[3] + tolerance}
        got = [(r["left_id"], r["right_id"]) for r in I.overlap_pairs(df, tolerance).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    split = {r[1]: r[7] for r in rows}
    assert all((r["left_split"], r["right_split"]) == (split[r["left_id"]], split[r["right_id"]]) for r in I.overlap_pairs(df).collect())


def test_islands_gaps_and_coverage(case):
    rows, df = case
    island, gaps, cover = {}, [], {}
    for rec, ws in by_recording(rows).items():
        reach, k, union, over = None, 0, 0.0, 0.0
        for r in ws:
            if reach is None or r[2] >= reach:
                k += 1
            if reach is not None and r[2] > reach:
                gaps.append((rec, reach, r[2]))
            if reach is not None and r[2] <= reach:
                over += min(reach, r[3]) - r[2]
            union += max(0.0, r[3] - max(r[2], r[2] if reach is None else reach))
            reach = r[3] if reach is None else max(reach, r[3])
            island[r[1]] = k
        cover[rec] = (union, over, len(ws))
    assert {r["event_id"]: r["island"] for r in I.islands(df).collect() if r["recording_id"] is not None} == {r[1]: island[r[1]] for r in rows if r[0] is not None}
    key = lambda g: tuple(-1 if x is None else x for x in g)
    assert sorted((tuple(r) for r in I.gaps(df).where("recording_id is not null").collect()), key=key) == sorted((g for g in gaps if g[0] is not None), key=key)
    for r in I.coverage(df).where("recording_id is not null").collect():
        union, over, n = cover[r["recording_id"]]
        assert (r["union_s"], r["overlap_s"], r["windows"]) == (pytest.approx(union), pytest.approx(over), n)
        assert r["gaps"] == sum(g[0] == r["recording_id"] for g in gaps)


def test_assembly(case):
    rows, df = case
    later, earlier, text = set(), set(), {}
    for rec, ws in by_recording(rows).items():
        reach = float("-inf")
        for i, r in enumerate(ws):
            if r[2] >= reach:
                reach = r[3]
                later.add(r[1])
            if i + 1 == len(ws) or ws[i + 1][2] >= r[3]:
                earlier.add(r[1])
        text[rec] = " ".join(r[4] for r in ws)
    known = {r[1] for r in rows if r[0] is not None}
    assert {r["event_id"] for r in I.drop_later(df.where("recording_id is not null")).collect()} == later & known
    assert {r["event_id"] for r in I.drop_earlier(df.where("recording_id is not null")).collect()} == earlier & known
    assert {r["recording_id"]: r["text"] for r in I.concatenated(df).where("recording_id is not null").collect()} == {k: v for k, v in text.items() if k is not None}


def test_no_slice_is_a_recording(spark, monkeypatch):
    """All windows lie in one recording and 90 % of them in one hour of a year: slices stay even, and a sweep compares what it finds."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 500)
    w = spark.range(20_000).selectExpr("1L as recording_id", "id as event_id", "case when id % 10 > 0 then 7200 + id * 0.18 else id * 1500.0 end as start_s").withColumn("end_s", F.col("start_s") + 0.3).withColumn("split", F.lit("train"))
    d = slices.sliced(w, ["recording_id", "start_s", "event_id"])
    n = [r["count"] for r in d.groupBy("slice").count().collect()]
    assert len(n) >= 40 and max(n) < 2_000
    assert I.overlap_pairs(w).count() == pytest.approx(18_000, rel=0.15)
    assert I.islands(w).agg(F.count_distinct("island")).first()[0] > 1


def test_sweeps_are_dealt_to_a_task_for_each_slice(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    w = spark.createDataFrame(some(4, 1000, 300), SCHEMA)
    for f in (I.overlap_pairs, I.drop_later):
        assert f(w).rdd.getNumPartitions() == 20  # a shuffle that is told no number puts all of them into one


def test_no_windows(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (I.overlap_pairs, I.islands, I.gaps, I.coverage, I.drop_later, I.drop_earlier, I.concatenated):
        assert f(none).count() == 0
    assert A.overlap_across_splits(none).count() == 0
    assert S.units(none.withColumn("unit_text", F.lit("x")), "unit_text").count() == 0
