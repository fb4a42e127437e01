"""Streams in several batches: late rows are counted, and state ends."""

import collections

import pytest
from pyspark.sql import functions as F

from evidara.streaming import windows as W

DAY = 86_400


def arrive(spark, path, batches, schema):
    """One file a batch, in order of arrival."""
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(path))
    return lambda: W.read_stream(spark, str(path), files_per_batch=1)


def test_late_rows_plus_counted_rows_are_the_input(spark, tmp_path):
    batches = [[(1, 1_000, 1.0), (1, 20 * DAY, 2.0), (2, 40_000, 1.0)], [(1, 2_000, 5.0), (2, 50_000, 7.0), (1, 20 * DAY + 5, 1.0), (2, 19 * DAY, 1.0)], [(3, 40 * DAY, 1.0), (2, 13 * DAY + 100, 9.0)], [(1, 33 * DAY - 1, 4.0)]]
    stream = arrive(spark, tmp_path / "in", batches, "user_id long, s long, value double")
    with W.rocks_db(spark):
        out = W.drain(W.chunks_and_late(stream())).collect()
    got = collections.defaultdict(float)
    for r in out:
        got[r["kind"], r["user_id"], r["start_s"]] += r["n"]
    want, mark, newest, closed = collections.defaultdict(float), 0, 0, 40 * DAY - 7 * DAY
    for rows in batches:
        for user, s, _ in rows:
            for start in (s - s % 10800, s - s % 10800 - 10800):
                if start + 21600 <= mark:
                    want["late", user, start] += 1
                elif start + 21600 <= closed:
                    want["chunk", user, start] += 1
        newest = max([newest, *(r[1] for r in rows)])
        mark = newest - 7 * DAY
    assert dict(got) == dict(want)
    assert sum(v for k, v in got.items() if k[0] == "late") > 2
    still_open = sum(s - s % 10800 - k * 10800 + 21600 > closed for rows in batches for _, s, _ in rows for k in (0, 1))
    assert sum(got.values()) + still_open == 2 * sum(map(len, batches))


def test_seen_keys_and_the_end_of_their_state(spark, tmp_path):
    near = [[("a", "train", 5), ("b", "train", 10), ("c", None, 20)], [("a", "test", DAY), ("c", "train", DAY), ("d", "train", 2 * DAY)], [("e", "test", 30 * DAY)], [("b", "test", 30 * DAY), ("e", "test", 31 * DAY)], [("f", "test", 60 * DAY)], [("g", "test", 90 * DAY)]]
    stream = arrive(spark, tmp_path / "in", near, "id string, split string, s long")
    progress: list = []
    out = {r["key"]: (r["n"], r["n_splits"]) for r in W.settled(W.drain(W.seen(stream(), "id"), progress=progress)).collect()}
    assert out == {"a": (2, 2), "c": (2, 1), "e": (2, 1)}  # b came again when it was forgotten
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(kept) >= 4 and kept[-1] <= 2


def test_first_copies(spark, tmp_path):
    stream = arrive(spark, tmp_path / "in", [[("a", 1), ("b", 5), ("a", 9)], [("a", DAY), ("c", DAY)], [("b", 2 * DAY)]], "sample_id string, s long")
    assert sorted(r["sample_id"] for r in W.drain(W.first_copies(stream())).collect()) == ["a", "b", "c"]


def test_open_windows_of_a_user_are_one_value(spark, tmp_path):
    hours = [(1, h * 3600, 1.0) for h in range(0, 900, 2)]
    stream = arrive(spark, tmp_path / "in", [hours, [(1, 100 * DAY, 1.0)]], "user_id long, s long, value double")
    progress: list = []
    with W.rocks_db(spark):
        out = W.drain(W.chunks_and_late(stream()), progress=progress).collect()
    assert sum(r["n"] for r in out) == 2 * len(hours)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) < 10


def test_keys_of_an_audit_share_values_of_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BUCKETS", 8)
    batches = [[(f"k{i}" if i else None, "train", 1 + i) for i in range(300)], [(f"k{i}" if i else None, "test" if i % 3 else None, DAY + i) for i in range(0, 300, 2)], [("z", "test", 30 * DAY)], [("k2", "test", 31 * DAY)]]
    stream = arrive(spark, tmp_path / "in", batches, "id string, split string, s long")
    progress: list = []
    out = {r["key"]: (r["n"], r["n_splits"]) for r in W.settled(W.drain(W.seen(stream(), "id"), progress=progress)).collect()}
    assert out == {f"k{i}" if i else None: (2, 2 if i % 3 else 1) for i in range(0, 300, 2)}  # k2 came again when it was forgotten
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(kept) <= 8 and kept[-1] <= 2
