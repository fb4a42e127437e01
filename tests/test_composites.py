"""Queries made of several operators hold every part."""

import os

import duckdb
import pytest

from evidara import catalog
from evidara.operators import checks
from evidara.queries.scores import evaluated

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return lambda name, of="*", end="": c.sql(f"SELECT {of} FROM ({catalog.oracle_sql()[name]}) {end}").fetchall()


def rows(spark, name, *columns):
    return [tuple(r) for r in catalog.queries()[name](spark, DATA).select(*columns).collect()]


def test_split_audit_has_windows_and_access(spark, sql):
    got = {(c, s): (n, m) for c, s, n, m in rows(spark, "split_audit", "code", "severity", "n", "n_samples")}
    want = {(c, s): (n, m) for c, s, n, m in sql("split_audit", "code, severity, n, n_samples")}
    pairs = sql("interval_overlap_pairs", "count(*)")[0][0]
    assert pairs > 0
    assert want["interval_overlap", "error"] == (pairs, 2 * pairs)
    access = sql("information_access_check", "code, severity, count(*)", "GROUP BY ALL")
    assert access and all(want[c, s] == (n, 0) for c, s, n in access)
    assert got == want


def test_typed_event_plan_has_every_event(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    even = events.where("user_id % 2 = 0").count()
    assert sorted(rows(spark, "typed_event_plan", "modality", "n")) == [("eeg", even), ("meg", events.count() - even)]


def test_no_plan_while_an_event_has_an_error(spark):
    row = (1, "s", "r", "eeg", 250.0, 10.0, "e", "t", 1.0, 5.0)
    names = "idx long, subject_id string, recording_id string, modality string, rate double, duration_s double, event_id string, text string, timestamp_s double, window_s double"
    assert sorted(map(tuple, checks.typed_event_plan(spark.createDataFrame([row], names)).select("modality", "n").collect())) == [("eeg", 1), ("meg", 0)]
    for bad in ((2, "s", "r", "eeg", 250.0, 10.0, "f", "t", 6.0, 5.0), (2, "s", "r", "meg", 250.0, 10.0, "f", "t", 1.0, 5.0)):
        assert checks.typed_event_plan(spark.createDataFrame([row, bad], names)).count() == 0


def test_occlusion_drop_has_every_run(spark, sql):
    got = {(m, v): (x, y) for m, v, x, y in rows(spark, "occlusion_drop", "metric", "variant", "drop", "mean_drop")}
    assert {m[:5] for m, _ in got} == {"run-0", "run-1", "run-2"}
    want = {(m, v): (x, y) for m, v, x, y in sql("occlusion_drop", 'metric, variant, "drop", mean_drop')}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-5) for k in want)


def test_evaluation_scores_paired_samples_with_one_reference(spark):
    full = [("r", i, "full", "a b", "a b") for i in "1234"]
    shuffled = [("r", "1", "shuffled", "a c", "a b"), ("r", "2", "shuffled", "x y", "other"), ("r", "4", "shuffled", "a b", None), ("r", "4", "shuffled", "a b", None), ("r", "5", "shuffled", "q", "q")]
    p = spark.createDataFrame(full + shuffled, "run_id string, sample_id string, control string, prediction_text string, reference_text string")
    got = {(r["control"], r["metric"]): (r["value"], r["examples"], r["findings"]) for r in evaluated(p).collect()}
    assert got["full", "wer"] == (0.0, 1, 0)
    assert got["shuffled", "wer"] == (0.5, 1, 4)  # conflict 2, missing 3, repeated 4, extra 5


def test_control_suite_has_eight_conditions(spark, sql):
    got = rows(spark, "control_suite", "control", "vec_id", "channel", "t", "value")
    n = sql("control_suite", "count(*) // 8")[0][0]
    assert {c: sum(r[0] == c for r in got) for c in {r[0] for r in got}} == dict.fromkeys(("full", "zero", "noise", "mask", "length", "shuffled", "timing", "surrogate"), n)
    old = {tuple(r[:4]): r[4] for r in sql("control_suite", "control, vec_id, channel, t, value")}
    new = {r[:4]: r[4] for r in got}
    assert all(new[k] == pytest.approx(v, abs=2e-5) for k, v in old.items())
    surrogate = {tuple(r[:3]): r[3] for r in sql("control_surrogate", "vec_id, channel, t, value")}
    assert all(new["surrogate", *k] == pytest.approx(v, abs=2e-5) for k, v in surrogate.items())
    assert all(v == (t == i % 8) for c, i, _, t, v in got if c == "timing")


def test_stream_audit_has_repeated_ids(spark, sql, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.unionByName(docs.where("doc_id in (3, 5)")).unionByName(docs.where("doc_id = 5")).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.queries()["stream_audit"](spark, str(tmp_path)).select("code", "key", "n").collect()]
    assert sorted(r[1:] for r in got if r[0] == "duplicate_sample") == [("3", 2), ("5", 3)]
    assert sorted(r[1:] for r in got if r[0] == "cross_split_text") == sorted(sql("stream_audit", "key, n", "WHERE code = 'cross_split_text'"))
