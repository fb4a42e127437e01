"""What goes through the driver or one task does not grow with the tables."""

import re

import pytest
from pyspark.sql import functions as F

from evidara import catalog
from evidara.operators import evaluation as E


def broadcast_parts(df):
    """The plans below the tables that are broadcast for a hash join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search(r"[A-Za-z*]", x).start() if re.search(r"[A-Za-z*]", x) else 0 for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange Hashed" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1 : end])


@pytest.mark.parametrize("clusters", [0, 1, 5000])
def test_draws_of_a_bootstrap_are_not_broadcast(spark, clusters):
    s = spark.range(clusters * 3).select((F.col("id") % max(1, clusters)).alias("cluster"), (F.col("id") * 0.5).alias("score"))
    b = E.cluster_bootstrap(s, resamples=50)
    if clusters > 1:  # of one cluster there are no more draws than resamples
        assert not [p for p in broadcast_parts(b) if "Range (" in p or "explode" in p]
    r = b.first()
    assert r["clusters"] == clusters
    if clusters:
        assert r["low"] <= r["estimate"] <= r["high"]
    else:
        assert r["estimate"] is None and r["low"] is None


def test_draws_of_a_unit_bootstrap_are_not_broadcast(spark):
    s = spark.range(9000).select(F.sha2((F.col("id") % 3000).cast("string"), 256).alias("stimulus_id"), F.when(F.col("id") % 3 < 2, F.col("id") * 0.5).alias("score"))
    b = E.stimulus_bootstrap(s, resamples=20)
    assert not [p for p in broadcast_parts(b) if "Range (" in p or "explode" in p]
    r = b.first()
    assert (r["unit"], r["clusters"]) == ("stimulus", s.where("score is not null").select("stimulus_id").distinct().count())


def test_checksums_of_long_texts_do_not_overflow(spark, tmp_path):
    n = 60_000
    spark.createDataFrame([(1, " ".join(f"w{i:05d}" for i in range(n)), "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    r = catalog.queries()["encode_tokens"](spark, str(tmp_path)).first()
    ids = [1, *range(4, n + 4), 2]
    assert (r["n"], r["unknown"], r["checksum"]) == (n + 2, 0, sum(x * (i + 1) for i, x in enumerate(ids)))
