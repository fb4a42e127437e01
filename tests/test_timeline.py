"""Windows, splits and evaluation on small tables with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from evidara.operators import audit as A
from evidara.operators import checks as C
from evidara.operators import evaluation as E
from evidara.operators import intervals as I
from evidara.operators import retrieval as R
from evidara.operators import signals as G
from evidara.operators import splits as S
from evidara.operators.components import connected_components

WIN = "recording_id string, event_id long, start_s double, end_s double, prediction_text string, inference_duration_s double, emitted_at_s double, split string, unit_text string"


def windows(spark, rows):
    return spark.createDataFrame([("r", i, a, b, t, c, e, s, u) for i, (a, b, t, c, e, s, u) in enumerate(rows)], WIN)


@pytest.fixture
def two(spark):
    return windows(spark, [(2.0, 5.0, "left", 0.4, 5.5, "train", "x"), (4.0, 8.0, "right", 0.8, 9.0, "test", "y")])


def test_assembly(two):
    c = I.concatenated(two).first()
    assert (c["text"], c["union_s"], c["overlap_s"], c["gaps"], c["full"]) == ("left right", 6.0, 1.0, 0, True)
    t = I.timing(two).first()
    assert t["real_time_factor"] == pytest.approx(0.2) and t["latency_max_s"] == pytest.approx(1.0)
    assert [r["event_id"] for r in I.drop_earlier(two).collect()] == [1]
    assert [r["event_id"] for r in I.drop_later(two).collect()] == [0]


def test_overlap_and_touching(spark, two):
    assert A.overlap_across_splits(two).count() == 1
    touching = windows(spark, [(0.0, 1.0, "a", 0.1, 1.0, "train", "x"), (1.0, 2.0, "b", 0.1, 2.0, "test", "y")])
    assert A.overlap_pairs(touching).count() == 0
    assert I.islands(touching).agg(F.max("island")).first()[0] == 2
    assert A.overlap_pairs(touching, tolerance=0.1).count() == 1


def test_repartitioning_changes_nothing(spark):
    w = windows(spark, [(float(i % 7) * 3, float(i % 7) * 3 + 2 + i % 3, "t", 0.1, 1.0, "train", f"u{i % 5}") for i in range(40)])
    a = S.assign(S.units(w, "unit_text")).collect()
    b = S.assign(S.units(w.repartition(7), "unit_text")).collect()
    assert sorted(a) == sorted(b)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (None, 1), (9, 8), (8, 7), (7, 6), (2, 1)], "u long, v long")
    assert {r[0]: r[1] for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}
    assert connected_components(e.where("u > 99")).count() == 0


def test_components_that_have_not_settled(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long").repartition(40)
    with pytest.raises(RuntimeError):
        connected_components(e, max_rounds=1)
    assert {r[1] for r in connected_components(e).collect()} == {0}


def test_calibration(spark):
    c = spark.createDataFrame([("r", i, p, y) for i, (p, y) in enumerate([(0.95, 1), (0.6, 1), (0.3, 0), (0.45, 1)])], "run_id string, doc_id long, confidence double, correct int")
    s = E.calibration_summary(c, 2).first()
    assert s["ece"] == pytest.approx(0.175) and s["brier"] == pytest.approx(0.13875)


def test_resampling(spark):
    s = spark.createDataFrame([("s1", 0.2)] * 3 + [("s2", 0.8)] * 2, "cluster string, score double")
    assert E.cluster_bootstrap(s, 50).first()["estimate"] == pytest.approx(0.5)
    d = spark.createDataFrame([(i, 2.0) for i in range(3)], "pair long, diff double")
    p = E.paired_permutation(d).first()
    assert p["p_greater"] == pytest.approx(1 / 8) and p["p_two_sided"] == pytest.approx(2 / 8)


def test_grounding_and_gate(spark):
    m = spark.createDataFrame([("r", "full", "mrr", 0.5, 4), ("r", "shuffled", "mrr", 0.2, 4), ("r", "lm_only", "mrr", 0.45, 4), ("r", "zero", "mrr", 0.1, 4)], "run_id string, control string, metric string, value double, examples long")
    g = E.grounding(m)
    r = g.first()
    assert r["strongest"] == "lm_only" and r["gain"] == pytest.approx(0.05) and r["contribution"] == pytest.approx(0.3)
    runs = spark.createDataFrame([("r", True, False, 4, "r", ["zero", "shuffled"])], "run_id string, audit_passed boolean, unsafe_access boolean, expected_samples long, provenance_run_id string, declared array<string>")
    need = spark.createDataFrame([("zero",), ("shuffled",)], "control string")
    assert E.release_gate(runs, m, g, need).count() == 0
    assert E.release_gate(runs, m, g, need, min_gain=0.1).count() == 1
    other = runs.withColumn("provenance_run_id", F.lit("q")).withColumn("declared", F.array(F.lit("zero")))
    assert sorted(x["code"] for x in E.release_gate(other, m, g, need).collect()) == ["control_undeclared:shuffled", "run_id_mismatch"]


def test_signals(spark):
    rows = [("a", c, t, v, True, True, "train") for c, vs in enumerate([[0.0, 2.0], [1.0, 5.0]]) for t, v in enumerate(vs)]
    rows += [("b", c, t, v, True, True, "train") for c, vs in enumerate([[4.0, 10.0], [3.0, 7.0]]) for t, v in enumerate(vs)]
    cells = spark.createDataFrame(rows, "vec_id string, channel int, t int, value double, channel_ok boolean, time_ok boolean, split string")
    stats = G.fit_normalizer(cells)
    new = spark.createDataFrame([("c", 0, 0, 11.0, True, True, "test")], cells.schema)
    assert G.apply_normalizer(new, stats).first()["value"] == pytest.approx(7 / 14**0.5)
    starts = lambda n, last: spark.range(1).select(G.fixed_starts(F.lit(n), 5, 3, last)).first()[0]
    assert starts(12, True) == [0, 3, 6] and starts(12, False) == [0, 3, 6, 9]  # 6 + 5 leaves a step uncovered
    assert starts(11, False) == [0, 3, 6] and starts(4, True) == [] and starts(4, False) == [0]
    bad = G.normalizer_findings(cells.unionByName(new).where("not (vec_id = 'b' and channel = 1)").withColumn("channel_ok", F.col("channel") == 0))
    assert sorted(tuple(r) for r in bad.collect()) == [("channel_count", "a"), ("empty_channel", "1"), ("non_train_sample", "c")]


def test_retrieval(spark):
    v = "id long, v array<double>, grp long"
    bank = spark.createDataFrame([(0, [1.0, 1.0], 1), (1, [1.0, 0.8], 2), (2, [-1.0, 0.0], 3), (3, [0.0, 0.0], 4)], v)
    q = spark.createDataFrame([(9, [1.0, 1.0], 1)], v)
    assert [r["c_id"] for r in R.top_k(q, bank, 3, exclude_group=True).orderBy("rank").collect()] == [1, 2]
    assert R.top_k(q, bank, 1).first()["c_id"] == 0
    assert sorted(r["id"] for r in R.newest(bank, 3).collect()) == [1, 2, 3]
    codes = spark.createDataFrame([(0,), (0,), (0,)], "code int")
    h = R.codebook_health(codes, 4).first()
    assert (h["active"], h["dead"], h["perplexity"]) == (0.25, 0.75, 1.0)
    line = spark.createDataFrame([(1.0, 5.0), (2.0, 8.0), (4.0, 14.0)], "x double, y double")
    w = R.ridge(line, ["x"], "y", 0.1)
    assert w[0] + 3 * w[1] == pytest.approx(11.0, abs=0.1)


def test_alignment_records(spark):
    schema = "record_id long, sentence_id string, text string, words array<struct<index:long,start_s:double,end_s:double>>, fixations array<struct<word_index:long,start_s:double,end_s:double>>, rate double, channels int"
    good = (1, "s", "a b", [(0, 0.0, 1.0), (1, 1.0, 2.0)], [(1, 0.0, 0.1)], 250.0, 2)
    gap = (2, "s", "a b", [(0, 0.0, 1.0), (2, 1.0, 2.0)], [(5, 0.0, 0.1)], 250.0, 2)
    v, clean = C.alignment_records(spark.createDataFrame([good, gap], schema))
    assert sorted(r["code"] for r in v.collect()) == ["bad_fixation", "word_index_gap"]
    assert [r["record_id"] for r in clean.collect()] == ["1"]


def test_short_recordings_are_assembled_in_batches(spark):
    rows = [(None if i % 97 == 0 else i % 700, i, float(i * 37 % 101), float(i * 37 % 101 + 1 + i % 23)) for i in range(4000)]
    got = I.drop_later(spark.createDataFrame(rows, "recording_id long, event_id long, start_s double, end_s double"))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # a group for each recording before
    want, reach = set(), {}
    for r, e, s, z in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[2], x[3], x[1])):
        if s >= reach.get(r, float("-inf")):
            reach[r] = z
            want.add((r, e))
    assert {(r["recording_id"], r["event_id"]) for r in got.collect()} == want
