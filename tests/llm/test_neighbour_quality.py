"""Neighbour votes against a plain vote over all labelled vectors, held-out figures, and odd rows."""

import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from evidara.llm import neighbour_quality as N

DIR = "/root/testdata/sf0.01"


def test_votes_of_all_vectors():
    rng = np.random.default_rng(3)
    c = rng.poisson(0.05, (90, N.FEATURES)).astype(np.float32)
    c[40] = c[41] = c[42]  # ties
    labels = (rng.random(60) < 0.7).astype(float)
    s = N.Space(c[:60], labels)
    got = s.score(c)
    for i in range(len(c)):
        v = s.project(c[i : i + 1])[0]
        cosine = [float(np.dot(v, x)) for x in s.vectors]
        last = sorted(cosine)[-N.NEIGHBOURS]
        votes = [(max(x, 0) ** N.SHARPNESS, y) for x, y in zip(cosine, labels, strict=True) if x >= last - 1e-6]
        assert math.isclose(got[i], sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs_tol=0.02)
    assert (got == np.concatenate([s.score(c[i : i + 1]) for i in range(len(c))])).all() or np.allclose(got, np.concatenate([s.score(c[i : i + 1]) for i in range(len(c))]), atol=1e-5)


def test_axes_are_the_leading_singular_vectors():
    rng = np.random.default_rng(4)
    c = (rng.poisson(0.4, (70, 5)) @ rng.poisson(0.3, (5, N.FEATURES))).astype(np.float32) + rng.poisson(0.01, (70, N.FEATURES))
    s = N.Space(c.astype(np.float32), np.ones(70))
    x = s._weighted(c.astype(np.float32))
    full = np.linalg.svd(x, compute_uv=False)
    mine = np.linalg.norm(x @ s.axes, axis=0)
    assert np.allclose(np.sort(mine)[::-1][:5], full[:5], rtol=1e-3)


def test_counts_are_the_same_in_any_batch(monkeypatch):
    texts = ["The  THE the the 12-34", None, "", " \n", "Éan Éan Éan", "x" * 500, "one, two; three!", "日本語 テスト"]
    whole = N.counts(pa.array(texts))
    assert (whole == np.concatenate([N.counts(pa.array([x], pa.string())) for x in texts])).all()
    monkeypatch.setattr(N, "PIECE", 7)
    assert (whole == N.counts(pa.array(texts))).all()
    assert whole[4, N.WORDS] == 2 and not whole[1].any() and not whole[2].any()


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.createDataFrame([(i, f"good words number {i}" if i % 3 else f"BAD!! WORDS!! {i}!!") for i in range(120)], "doc_id long, text string").selectExpr("*", "'x' as label", "1 as at", "2 as quality").repartition(3)
    rows = [(i, int(i % 3 > 0)) for i in range(120)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([*rows, (None, 1), (5000, 1), (3, None)], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in rows], "doc_id long, quality int")
    one, two = ({r["doc_id"]: r for r in N.scored(docs, x).collect()} for x in (labels, turned))
    assert one == two and len(one) == 120
    for i, r in one.items():
        assert r["held_out"] == (i in held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) == int(i % 3 > 0)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b c"), (1, "other text"), (2, "X!! Y!!"), (3, "long " * 300_000), (None, "a b c"), (4, None), (7, ""), (8, " \n"), (2, "X!! Y!!")], "doc_id long, text string")
    out = N.scored(docs, labels).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 for r in out) and not [r for r in out if r["doc_id"] is None and r["held_out"]]
    assert len({r["score"] for r in out if r["doc_id"] in (7, 8)}) == 1
    nothing = N.scored(docs, labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in nothing} == {(1.0, 1)}
    assert N.scored(docs.where("false"), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_held_out_accuracy(spark):
    from evidara.llm.registry import queries

    q = queries()["op13_neighbour_quality"](spark, DIR).where("held_out").join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").toPandas()
    good = q[q["quality"] == 1]
    bad = q[q["quality"] == 0]
    assert (good["predicted"] == 1).mean() > 0.95 and (bad["predicted"] == 0).mean() > 0.7
    assert np.mean([(g > bad["score"]).mean() + (g == bad["score"]).mean() / 2 for g in good["score"]]) > 0.95
