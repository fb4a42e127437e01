"""Rules that refuse a plan, a comparison or an aggregate, places in two steps, and scores on a table worked out by hand."""

import collections

import pytest
from pyspark.sql import functions as F

from evidara.operators import evaluation as E
from evidara.operators import intervals as I
from evidara.operators import signals as G
from evidara.operators import splits as S
from evidara.operators import text as T
from evidara.plans import ranks
from evidara.queries import flows, scores


def test_places_are_those_of_one_sort(spark):
    d = spark.createDataFrame([((i * 37) % 500 - 100,) for i in range(500)], "id long").repartition(5)
    want = {v: i + 1 for i, v in enumerate(sorted((i * 37) % 500 - 100 for i in range(500)))}
    assert {r["id"]: r["place"] for r in ranks.by_number(d, "id").collect()} == want
    h = F.sha2(F.col("id").cast("string"), 256)
    by = [r["id"] for r in d.orderBy(h).collect()]
    got = sorted(ranks.by_hash(d, h, "id").collect(), key=lambda r: r["place"])
    assert [r["id"] for r in got] == by and [r["place"] for r in got] == list(range(1, 501))
    assert ranks.by_number(d.where("id > 9999"), "id").count() == 0


def test_permutation_is_no_identity(spark):
    one = {r["id"]: r["source"] for r in G.permutation(spark.range(40), "id", "x").collect()}
    assert sorted(one) == sorted(one.values()) and any(k != v for k, v in one.items())
    for n in (1, 2, 3):
        ids = spark.range(n).select((F.col("id") * 10).alias("id"))
        p = {r["id"]: r["source"] for r in G.permutation(ids, "id", "seed").collect()}
        assert sorted(p) == sorted(p.values()) and (n == 1 or any(k != v for k, v in p.items()))


W = "recording_id string, event_id long, start_s double, end_s double, split string, unit_text string"


def test_plan_rules(spark):
    rows = [("a", 1, 0.0, 2.0, None, "t"), ("a", 2, 1.0, 3.0, None, "u"), ("b", 3, 0.0, 1.0, None, "t"), ("b", 4, 5.0, 6.0, None, None), ("b", 5, 7.0, 8.0, None, "u"), ("b", 6, 9.0, 9.5, None, "v")]
    plan = [(1, "test"), (2, "train"), (3, "train"), (4, "test"), (4, "test"), (5, "excluded"), (77, "train")]
    w, p = spark.createDataFrame(rows, W), spark.createDataFrame(plan, "event_id long, split string")
    got = {r["code"]: r["n"] for r in S.validate(w, p, held_out="a").collect()}
    assert got == {"duplicate_assignment": 1, "unassigned": 1, "unknown_assignment": 1, "overlap_across_splits": 1, "missing_key": 1, "key_across_splits": 1, "held_out_not_test": 1, "other_subject_in_test": 1}
    assert {r["code"]: r["n"] for r in S.validate(w, p, key=None).collect()}["missing_key"] == 0


def test_greedy_windows_by_islands(spark):
    rows = [("r", i, float(s), float(e)) for i, (s, e) in enumerate([(0, 4), (1, 2), (3, 5), (4, 6), (6, 7), (6, 9), (8, 9), (20, 21), (20, 30), (29, 31), (30, 31)])]
    kept, reach = [], float("-inf")
    for _, i, s, e in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if s >= reach:
            kept.append(i)
            reach = e
    got = I.drop_later(spark.createDataFrame(rows, "recording_id string, event_id long, start_s double, end_s double"))
    assert sorted(r["event_id"] for r in got.collect()) == sorted(kept)


def test_comparison_and_seeds(spark):
    side = lambda label, rows: spark.createDataFrame([(label, s, f) for s, f in rows], "label string, sample_id string, fingerprint string")
    got = {tuple(r) for r in E.comparison_findings(side("x", [("1", "a"), ("2", "b"), ("3", "c")]), side("y", [("1", "a"), ("2", "z"), ("4", "d")])).collect()}
    assert got == {("label_mismatch", "x"), ("label_mismatch", "y"), ("reference_mismatch", "2"), ("only_left", "3"), ("only_right", "4")}
    assert E.comparison_findings(side("x", [("1", "a")]), side("x", [("1", "a")])).count() == 0
    planned = spark.createDataFrame([("p", 1, "a1"), ("p", 2, "a2"), ("p", 3, "a3")], "plan string, seed int, artifact string")
    expected = spark.createDataFrame([("p", "wer"), ("p", "mrr")], "plan string, metric string")
    results = spark.createDataFrame([("p", 1, "a1", "wer"), ("p", 1, "a1", "mrr"), ("p", 2, "other", "wer"), ("p", 2, "other", "bleu"), ("p", 4, "a4", "wer"), ("p", 1, "a1", "wer")], "plan string, seed int, artifact string, metric string")
    got = sorted((r["seed"], r["code"]) for r in E.multiseed_findings(results, planned, expected).collect())
    assert got == [(1, "repeated_result"), (2, "artifact_mismatch"), (2, "missing_metric"), (2, "unexpected_metric"), (3, "missing_seed"), (4, "unplanned_seed")]


P = "run_id string, sample_id string, control string, prediction_text string, reference_text string"


@pytest.fixture
def predictions(spark):
    rows = [("r", "1", "full", "a b c d", "a b c d"), ("r", "2", "full", "x y", "x z"), ("r", "3", "full", "p", "q")]
    rows += [("r", "1", "shuffled", "x z", None), ("r", "2", "shuffled", "a b c d", None), ("r", "1", "zero", "the", None), ("r", "2", "zero", "the", None), ("r", "3", "zero", "the", None)]
    return spark.createDataFrame(rows, P)


def test_composed_evaluation(predictions):
    got = {(r["control"], r["metric"]): r for r in scores.evaluated(predictions).collect()}
    # sample 3 lacks its shuffled row, so it is scored nowhere
    assert got["full", "wer"]["value"] == pytest.approx(1 / 6, abs=1e-6) and got["full", "wer"]["examples"] == 2
    assert got["zero", "wer"]["value"] == pytest.approx(6 / 6, abs=1e-6)
    assert got["shuffled", "wer"]["value"] == pytest.approx((4 + 4) / 6, abs=1e-6)
    assert got["full", "cer"]["value"] == pytest.approx(1 / 10, abs=1e-6)
    assert got["full", "wer"]["strongest"] == "zero" and got["full", "wer"]["gain"] == pytest.approx(1 - 1 / 6, abs=1e-6)
    assert got["shuffled", "wer"]["findings"] == 1


def test_failure_explorer(predictions):
    e = {r["sample_id"]: r for r in E.failure_explorer(predictions, T.error_categories(predictions.where("control = 'full'"))).collect()}
    assert {k: r["category"] for k, r in e.items()} == {"1": "exact", "2": "substitution", "3": "hallucination"}
    assert e["1"]["controls"] == {"shuffled": "x z", "zero": "the"} and e["3"]["controls"] == {"zero": "the"} and e["2"]["reference"] == "x z"


def test_suites_of_user_functions(spark, tmp_path):
    rows = [(i, [float((i * 7 + k) % 5) / 10 for k in range(64)], 0) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    energy = {i: sum(round(x, 7) ** 2 for x in v) for i, v, _ in rows}
    got = {r["control"]: r for r in flows.faithfulness_suite(spark, str(tmp_path)).collect()}
    assert got["full"]["value"] == 1.0 and got["full"]["examples"] == 12
    import math

    assert got["zero"]["value"] == pytest.approx(sum(math.exp(-e) for e in energy.values()) / 12, abs=1e-4)
    o = {r["variant"]: r for r in flows.occlusion_suite(spark, str(tmp_path)).collect()}
    lost = {i: sum(v[c * 8 + t] ** 2 for c in (0, 3) for t in range(8)) for i, v, _ in rows}
    assert o["channels"]["drop"] == pytest.approx(1 - sum(math.exp(-x) for x in lost.values()) / 12, abs=1e-4)


def test_score_weights(spark):
    want = collections.OrderedDict(a=0.5, b=-2.0)
    rows = [(float(i % 7), float(i * i % 5), 3 + 0.5 * (i % 7) - 2.0 * (i * i % 5)) for i in range(60)]
    from evidara.operators import retrieval as R

    w = R.ridge(spark.createDataFrame(rows, "a double, b double, y double"), list(want), "y", 1e-9)
    assert w == pytest.approx([3.0, *want.values()], abs=1e-5)
