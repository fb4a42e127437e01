"""User metrics and suites, retrieval in an evaluation, tokenizers as arguments, and text metrics of long rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidara.operators import evaluation as E
from evidara.operators import suites as U
from evidara.operators import text as T
from evidara.queries.scores import evaluated

PAIRS = "run_id string, control string, sample_id string, prediction_text string, reference_text string"
EXACT = U.Metric("exact", lambda h, r: [h == r])
ERRORS = U.Metric("slips", lambda h, r: [abs(len(h) - len(r)), len(r)], lambda s, n: s[0] / s[1], width=2, higher_is_better=False)


def signal(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, x double")


def say(batches):
    for b in batches:
        yield pd.DataFrame({"sample_id": b["sample_id"], "prediction_text": ["first" if x == 1 else "second" if x == 2 else "control" for x in b["x"]]})


def test_a_suite_scores_controls_by_declared_directions(spark):
    full = signal(spark, [("a", 1.0), ("b", 2.0)])
    signals = {"full": full, "shuffled": signal(spark, [("a", 2.0), ("b", 1.0)]), "zero": full.withColumn("x", F.lit(0.0)), "noise": signal(spark, [("a", 7.0), ("b", 2.0)])}
    want = spark.createDataFrame([("a", "first"), ("b", "second")], "sample_id string, reference_text string")
    together = U.Metric("all_right", whole=lambda h, r: float(sorted(h) == sorted(r)))
    s = U.faithfulness(signals, say, want, [EXACT, ERRORS, together])
    got = {(r["control"], r["metric"]): (round(r["value"], 6), r["examples"]) for r in s.scores.collect()}
    assert got["full", "exact"] == (1.0, 2) and got["noise", "exact"] == (0.5, 2) and got["shuffled", "exact"] == (0.0, 2)
    assert got["full", "slips"] == (0.0, 2) and got["zero", "slips"] == (round((2 + 1) / 11, 6), 2)
    assert got["full", "all_right"] == (1.0, 2) and got["shuffled", "all_right"] == (1.0, 2) and got["zero", "all_right"] == (0.0, 2)
    g = {r["metric"]: r for r in s.grounding.collect()}
    assert (g["exact"]["strongest"], g["exact"]["gain"], g["exact"]["contribution"]) == ("noise", 0.5, 1.0)
    assert g["slips"]["gain"] == pytest.approx(2 / 11) and g["slips"]["strongest"] == "noise"  # less is better: the best control has least
    assert s.findings.count() == 0 and s.forbidden == []


def test_what_a_suite_refuses(spark):
    one = signal(spark, [("a", 1.0)])
    want = spark.createDataFrame([("a", "first"), ("b", "x")], "sample_id string, reference_text string")
    for signals in ({"shuffled": one}, {"full": one}, {"full": one, "shuffled": one.withColumn("gold_text", F.lit("x"))}):
        with pytest.raises(ValueError):
            U.faithfulness(signals, say, want, [EXACT])
    for metrics in ([], [EXACT, EXACT]):
        with pytest.raises(ValueError):
            U.faithfulness({"full": one, "shuffled": one}, say, want, metrics)
    for wrong in ({"name": " ", "parts": len}, {"name": "x"}, {"name": "x", "parts": len, "whole": len}):
        with pytest.raises(ValueError):
            U.Metric(**wrong)
    assert U.forbidden_parameters(lambda batches, labels=None: batches) == ["labels"]
    s = U.faithfulness({"full": one, "shuffled": one}, say, want, [EXACT])
    assert {(r["control"], r["code"], r["sample_id"]) for r in s.findings.collect()} == {("full", "missing", "b")}


def test_retrieval_in_an_evaluation(spark):
    p = spark.createDataFrame([("r", c, s, "x", "x") for c in ("full", "shuffled", "zero") for s in ("a", "b", "c")], PAIRS)
    rows = [("r", "full", "a", [0.9, 0.1, 0.2], 0), ("r", "full", "b", [0.5, 0.5, 0.2], 1), ("r", "shuffled", "a", [0.1, 0.9, 0.5], 0), ("r", "shuffled", "b", [0.1, 0.2, 0.3], 2), ("r", "shuffled", "z", [0.1], 0), ("r", "full", "c", [0.1], None)]
    c = spark.createDataFrame([(*k, x, i == pos) for *k, xs, pos in rows for i, x in enumerate(xs)], "run_id string, control string, sample_id string, score double, positive boolean")
    found, m = E.retrieval_by_control(c, p, ks=(2, 1, 2))
    assert {(r["control"], r["code"], r["sample_id"]) for r in found.collect()} == {("full", "bad_positive", "c"), ("shuffled", "no_scores", "c"), ("shuffled", "no_prediction", "z")}
    got = {(r["control"], r["metric"]): r["value"] for r in m.collect()}
    assert got["full", "retrieval_mean_rank"] == 1.5 and got["full", "retrieval_mrr"] == 0.75  # a tie has the worst rank
    assert got["shuffled", "retrieval_recall_at_1"] == 0.5 and got["shuffled", "retrieval_recall_at_2"] == 0.5 and "zero" not in {k for k, _ in got}
    out = {(r["control"], r["metric"]): r for r in evaluated(p, c, ks=(1,)).collect()}
    assert out["full", "retrieval_mean_rank"]["strongest"] == "shuffled" and out["full", "retrieval_mean_rank"]["gain"] == 0.5
    assert out["full", "cer"]["value"] == 0.0 and out["full", "cer"]["findings"] == 1


def test_units_of_a_bootstrap(spark):
    s = spark.createDataFrame([("s1", "t1", 0.2), ("s1", "t2", 0.2), ("s1", "t3", 0.2), ("s2", "t1", 0.8), (None, "t1", 0.5)], "subject_id string, stimulus_id string, score double")
    a, b = E.subject_bootstrap(s, resamples=40).first(), E.stimulus_bootstrap(s, resamples=40).first()
    assert (a["unit"], a["clusters"], a["estimate"]) == ("subject", 2, pytest.approx(0.5))
    assert (b["unit"], b["clusters"], b["estimate"]) == ("stimulus", 3, pytest.approx((0.5 + 0.2 + 0.2) / 3))


def test_a_users_tokenizer(spark):
    p = spark.createDataFrame([("r", "full", "a", "ab-cd ef", "ab-cd ef gh"), ("r", "full", "b", "", "")], PAIRS)
    letters = lambda c: F.filter(F.split(F.regexp_replace(c, r"\W", ""), ""), lambda x: x != "")
    blanks = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    bleu = {name: T.corpus_bleu(p, t).first()["bleu"] for name, t in (("own", None), ("letters", letters), ("blanks", blanks))}
    assert bleu["letters"] == pytest.approx(2.718281828 ** (1 - 8 / 6)) and bleu["blanks"] == pytest.approx(2.718281828 ** (1 - 3 / 2))
    assert bleu["own"] == pytest.approx(2.718281828 ** (1 - 4 / 3))
    rouge = {r["sample_id"]: r["rouge_l"] for r in T.rouge_l(p, blanks).collect()}
    assert rouge == {"a": pytest.approx(4 / 5), "b": 1.0}
    assert {r["sample_id"]: r["meteor"] for r in T.meteor_unigram(p, blanks).collect()}["b"] == 1.0


def test_long_rows(spark):
    words = " ".join(f"w{i % 7000}" for i in range(20_000))
    p = spark.createDataFrame([("r", "full", "a", words, words + " end"), ("r", "full", "b", "x x y", "x y")], PAIRS)
    m = T.meteor_unigram(p)
    assert "Exchange" not in m._jdf.queryExecution().executedPlan().toString()
    got = {r["sample_id"]: r["meteor"] for r in m.collect()}
    q = 20_000 / 20_001
    assert got["a"] == pytest.approx(10 * q / (q + 9) * (1 - 0.5 * (1 / 20_000) ** 3))
    assert {r["sample_id"]: r["category"] for r in T.error_categories(p.where("sample_id = 'b'")).collect()} == {"b": "repetition"}
