"""Paired evaluation: pairing proofs, control aggregates, grounding, calibration, resampling, and run-level rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.plans.ranks import by_value
from evidara.plans.storage import staged


def pairing_findings(p: DataFrame) -> DataFrame:
    """(run_id, control, code, sample_id): duplicates in a control, and ids that a control has more or less than the full condition."""
    ids = p.groupBy("run_id", "control", "sample_id").agg(F.count("*").alias("n"))
    dup = ids.where("n > 1").select("run_id", "control", F.lit("duplicate").alias("code"), "sample_id")
    full = ids.where("control = 'full'").select("run_id", "sample_id")
    controls = ids.select("run_id", "control").distinct().where("control <> 'full'")
    expected = full.join(controls, "run_id")
    missing = expected.join(ids, ["run_id", "control", "sample_id"], "left_anti").select("run_id", "control", F.lit("missing").alias("code"), "sample_id")
    extra = ids.where("control <> 'full'").join(full, ["run_id", "sample_id"], "left_anti").select("run_id", "control", F.lit("extra").alias("code"), "sample_id")
    return dup.unionByName(missing).unionByName(extra)


def resolve_references(p: DataFrame, supplied: DataFrame) -> DataFrame:
    """Rows with ``reference`` (inline, else supplied) and ``code``: conflict, missing, or null."""
    j = p.join(supplied.select("sample_id", F.col("reference_text").alias("given")), "sample_id", "left")
    code = F.when(F.col("reference_text").isNotNull() & F.col("given").isNotNull() & (F.col("reference_text") != F.col("given")), "conflict").when(F.coalesce("reference_text", "given").isNull(), "missing")
    return j.select("run_id", "control", "sample_id", F.coalesce("reference_text", "given").alias("reference"), code.alias("code"))


def resolved_pairs(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, predictions): the findings of pairing and references, and the rows of samples that have none, with their references.

    A sample with a finding in one control is left out of every control of its run, so all are scored on the same samples."""
    given = p.where("reference_text is not null").groupBy("sample_id").agg(F.min("reference_text").alias("reference_text"))
    resolved = resolve_references(p, given)
    findings = pairing_findings(p).unionByName(resolved.where("code is not null").select("run_id", "control", "code", "sample_id"))
    bad = findings.select("run_id", "sample_id").distinct()
    good = p.drop("reference_text").join(bad, ["run_id", "sample_id"], "left_anti")
    return findings, good.join(resolved.where("code is null").select("run_id", "control", "sample_id", F.col("reference").alias("reference_text")), ["run_id", "control", "sample_id"])


def retrieval_by_control(scores: DataFrame, predictions: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """(findings, metrics) of candidate scores (run_id, control, sample_id, score, positive) that go with predictions.

    Metrics are (run_id, control, metric, value, examples): retrieval_mrr, retrieval_mean_rank and retrieval_recall_at_k; ties get the worst rank. A prediction without
    scores, scores without a prediction, and a query without exactly one positive are findings and do not count. Controls without any scores have no metrics."""
    keys = ["run_id", "control", "sample_id"]
    own = scores.where("positive").groupBy(*keys).agg(F.max("score").alias("own"), F.count("*").alias("positives"))
    rank = scores.join(own.where("positives = 1"), keys).groupBy(*keys).agg(F.count_if(F.col("score") >= F.col("own")).alias("rank"))
    asked = scores.select(*keys).distinct()
    code = lambda df, name: df.select("run_id", "control", F.lit(name).alias("code"), "sample_id")
    some = predictions.join(scores.select("run_id", "control").distinct(), ["run_id", "control"], "left_semi")
    found = code(some.join(asked, keys, "left_anti"), "no_scores").unionByName(code(asked.join(predictions, keys, "left_anti"), "no_prediction")).unionByName(code(asked.join(rank, keys, "left_anti"), "bad_positive"))
    r = rank.join(found.select(*keys).distinct(), keys, "left_anti").groupBy("run_id", "control")
    cuts = sorted(set(ks))
    m = r.agg(F.avg(1 / F.col("rank")).alias("retrieval_mrr"), F.avg("rank").alias("retrieval_mean_rank"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"retrieval_recall_at_{k}") for k in cuts], F.count("*").alias("examples"))
    return found, m.unpivot(["run_id", "control", "examples"], ["retrieval_mrr", "retrieval_mean_rank", *[f"retrieval_recall_at_{k}" for k in cuts]], "metric", "value")


def control_aggregate(metrics: DataFrame) -> DataFrame:
    """Per control and metric the example-weighted mean over the rows that have it, runs and examples."""
    return metrics.groupBy("control", "metric").agg((F.sum(F.col("value") * F.col("examples")) / F.sum("examples")).alias("value"), F.count_distinct("run_id").alias("runs"), F.sum("examples").alias("examples"))


def lower_is_better(metric: Column, directions: dict[str, bool] | None = None) -> Column:
    """Whether less of a metric is better: as ``directions`` (name to whether more is better) say, else by its name."""
    by_name = metric.rlike("(cer|wer)$") | (metric == "retrieval_mean_rank")
    told = directions or {}
    return F.when(metric.isin([k for k, v in told.items() if not v]), True).when(metric.isin([k for k, v in told.items() if v]), False).otherwise(by_name) if told else by_name


def grounding(metrics: DataFrame, directions: dict[str, bool] | None = None) -> DataFrame:
    """(run_id, metric, full, strongest, strongest_value, gain, contribution): the full condition against its strongest control and against shuffled."""
    sign = F.when(lower_is_better(F.col("metric"), directions), -1.0).otherwise(1.0)
    m = metrics.withColumn("signed", sign * F.col("value"))
    full = m.where("control = 'full'").select("run_id", "metric", F.col("value").alias("full"), F.col("signed").alias("fs"))
    w = Window.partitionBy("run_id", "metric").orderBy(F.desc("signed"), "control")
    best = m.where("control <> 'full'").withColumn("r", F.row_number().over(w)).where("r = 1").select("run_id", "metric", F.col("control").alias("strongest"), F.col("value").alias("strongest_value"), F.col("signed").alias("bs"))
    sh = m.where("control = 'shuffled'").select("run_id", "metric", F.col("signed").alias("ss"))
    j = full.join(best, ["run_id", "metric"]).join(sh, ["run_id", "metric"], "left")
    return j.select("run_id", "metric", "full", "strongest", "strongest_value", (F.col("fs") - F.col("bs")).alias("gain"), (F.col("fs") - F.col("ss")).alias("contribution"))


def calibration_bins(c: DataFrame, bins: int) -> DataFrame:
    """(run_id, bin, n, confidence, accuracy) of equal-width bins, empty ones kept; the last holds 1.0.

    The bounds are i / bins and (i + 1) / bins as given, found by a range join with the small table of bins."""
    b = c.sparkSession.range(bins).select(F.col("id").alias("bin"), (F.col("id") / bins).alias("lo"), ((F.col("id") + 1) / bins).alias("hi"))
    inside = (F.col("confidence") >= F.col("lo")) & ((F.col("confidence") < F.col("hi")) | ((F.col("bin") == bins - 1) & (F.col("confidence") <= 1.0)))
    got = c.join(F.broadcast(b), inside).groupBy("run_id", "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))
    every = c.select("run_id").distinct().crossJoin(F.broadcast(b.select("bin")))
    return every.join(got, ["run_id", "bin"], "left").select("run_id", "bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def calibration_summary(c: DataFrame, bins: int) -> DataFrame:
    b = calibration_bins(c, bins)
    total = F.sum("n").over(Window.partitionBy("run_id"))
    e = b.withColumn("part", F.col("n") / total * F.abs(F.col("confidence") - F.col("accuracy"))).groupBy("run_id").agg(F.sum("part").alias("ece"), F.sum("n").alias("n"))
    brier = c.groupBy("run_id").agg(F.avg((F.col("confidence") - F.col("correct")) * (F.col("confidence") - F.col("correct"))).alias("brier"))
    return e.join(brier, "run_id")


def risk_coverage(c: DataFrame) -> DataFrame:
    """Running error rate in order of falling confidence. Totals of confidence buckets are summed first, then places inside each bucket, so a run is not one task."""
    c = c.withColumn("bucket", F.floor(F.col("confidence") * 256).cast("int"))
    t = c.groupBy("run_id", "bucket").agg(F.count("*").alias("bn"), F.sum(1 - F.col("correct")).alias("be"))
    above = Window.partitionBy("run_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("bn").over(Window.partitionBy("run_id"))
    t = t.select("run_id", "bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("bn"), F.coalesce(F.sum("be").over(above), F.lit(0)).alias("be"), whole.alias("total"))
    w = Window.partitionBy("run_id", "bucket").orderBy(F.desc("confidence"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    j = c.select("run_id", "bucket", "doc_id", "confidence", F.count("*").over(w).alias("i"), F.sum(1 - F.col("correct")).over(w).alias("e")).join(t, ["run_id", "bucket"])
    i = F.col("i") + F.col("bn")
    return j.select("run_id", "doc_id", i.alias("i"), ((F.col("e") + F.col("be")) / i).alias("risk"), (i / F.col("total")).alias("coverage"), F.col("confidence").alias("threshold"))


#: Draws of one task of a bootstrap.
DRAWS = 1 << 21


def cluster_bootstrap(scores: DataFrame, resamples: int = 200, confidence: float = 0.95, seed: str = "boot") -> DataFrame:
    """Mean of the cluster means, and a percentile interval over seeded resamples of clusters with replacement."""
    m = staged(scores.groupBy("cluster").agg(F.avg("score").alias("m")), "clusters")  # the scores are read once
    m = by_value(m, "cluster", "i").withColumn("i", (F.col("i") - 1).cast("long"))
    n = m.agg(F.count("*").alias("n"), F.avg("m").alias("estimate"))
    spark, clusters = scores.sparkSession, m.count()
    every = resamples * clusters  # a range over all draws: its size is known to the planner, which would broadcast the rows of an exploded sequence as if they were few
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // DRAWS))
    draws = spark.range(0, every, 1, parts).select(F.expr(f"id div {max(1, clusters)}L").alias("r"), (F.col("id") % max(1, clusters)).alias("slot"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("r").cast("string"), F.col("slot").cast("string")), 256), 1, 8), 16, 10).cast("long")
    means = draws.select("r", (h % max(1, clusters)).alias("i")).join(m.select("i", "m"), "i").groupBy("r").agg(F.round(F.avg("m"), 9).alias("b"))
    a = (1 - confidence) / 2
    ci = means.agg(F.percentile("b", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return n.crossJoin(ci).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.col("n").alias("clusters"))  # one row each


def subject_bootstrap(scores: DataFrame, subject: str = "subject_id", **how) -> DataFrame:
    """Every subject counts alike; (unit, estimate, low, high, clusters)."""
    return _of_unit(scores, subject, "subject", how)


def stimulus_bootstrap(scores: DataFrame, stimulus: str = "stimulus_id", **how) -> DataFrame:
    """Every stimulus (a text, an item) counts alike; (unit, estimate, low, high, clusters)."""
    return _of_unit(scores, stimulus, "stimulus", how)


def _of_unit(scores: DataFrame, column: str, unit: str, how: dict) -> DataFrame:
    s = scores.where(F.col(column).isNotNull() & F.col("score").isNotNull()).select(F.col(column).alias("cluster"), "score")
    return cluster_bootstrap(s, **how).select(F.lit(unit).alias("unit"), "*")


def paired_permutation(diffs: DataFrame, permutations: int = 500, seed: str = "perm", exact_up_to: int = 16) -> DataFrame:
    """(n, observed, p_greater, p_two_sided) of paired differences (pair, diff): all sign vectors for few pairs, else seeded draws."""
    spark = diffs.sparkSession
    n = diffs.count()
    d = by_value(diffs, "pair", "i").withColumn("i", (F.col("i") - 1).cast("int")) if n <= exact_up_to else diffs
    obs = d.agg(F.round(F.avg("diff"), 9).alias("observed"))
    exact = n <= exact_up_to
    masks = spark.range(1 << n if exact else permutations).select(F.col("id").alias("m"))
    if exact:
        sign = F.when(F.expr("shiftright(m, i) & 1") == 1, -1.0).otherwise(1.0)
    else:
        h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("m").cast("string"), F.col("pair").cast("string")), 256), 1, 8), 16, 10).cast("long")
        sign = F.when(h % 2 == 1, -1.0).otherwise(1.0)
    draws = masks.crossJoin(d).groupBy("m").agg(F.round(F.avg(sign * F.col("diff")), 9).alias("s"))  # sign vectors against the pairs
    k = draws.crossJoin(F.broadcast(obs)).agg(F.count_if(F.col("s") >= F.col("observed")).alias("g"), F.count_if(F.abs("s") >= F.abs("observed")).alias("t"), F.max("observed").alias("observed"), F.count("*").alias("k"))
    p = (lambda c: F.col(c) / F.col("k")) if exact else (lambda c: (F.col(c) + 1) / (F.col("k") + 1))
    return k.select(F.lit(n).cast("long").alias("n"), "observed", p("g").alias("p_greater"), p("t").alias("p_two_sided"))


def occlusion_drop(scores: DataFrame, directions: dict[str, bool] | None = None) -> DataFrame:
    """(metric, variant, drop, mean_drop): baseline minus score, turned round where lower is better."""
    base = scores.where("variant = 'baseline'").select("metric", F.col("value").alias("b"))
    s = scores.where("variant <> 'baseline'").join(base, "metric")
    drop = F.when(lower_is_better(F.col("metric"), directions), F.col("value") - F.col("b")).otherwise(F.col("b") - F.col("value"))
    s = s.select("metric", "variant", drop.alias("drop"))
    return s.withColumn("mean_drop", F.avg("drop").over(Window.partitionBy("metric")))


def multiseed(metrics: DataFrame, planned: DataFrame) -> DataFrame:
    """(plan, metric, value, seeds) of plans whose seeds are those planned and whose metric sets agree."""
    have = metrics.select("plan", "seed").distinct()
    wrong = planned.join(have, ["plan", "seed"], "left_anti").select("plan").unionByName(have.join(planned, ["plan", "seed"], "left_anti").select("plan"))
    per = metrics.groupBy("plan", "metric").agg(F.avg("value").alias("value"), F.count_distinct("seed").alias("seeds"))
    need = planned.groupBy("plan").agg(F.count_distinct("seed").alias("need"))
    uneven = per.join(need, "plan").where("seeds <> need").select("plan")
    return per.join(wrong.unionByName(uneven).distinct(), "plan", "left_anti")


def multiseed_findings(results: DataFrame, planned: DataFrame, expected: DataFrame) -> DataFrame:
    """(plan, seed, code) for what refuses an aggregate: planned seeds without a result, results without a plan, repeated ones, other artifacts
    than planned, and metrics missing or unexpected.

    ``results`` are (plan, seed, artifact, metric), ``planned`` (plan, seed, artifact), ``expected`` (plan, metric)."""
    have = results.select("plan", "seed", "artifact").distinct()
    keys = ["plan", "seed"]
    code = lambda df, name: df.select(*keys, F.lit(name).alias("code"))
    due = planned.select(*keys).join(expected, "plan")
    got = results.select(*keys, "metric")
    return (
        code(planned.join(have, keys, "left_anti"), "missing_seed")
        .unionByName(code(have.join(planned, keys, "left_anti").select(*keys).distinct(), "unplanned_seed"))
        .unionByName(code(results.groupBy(*keys, "metric").agg(F.count("*").alias("n")).where("n > 1").select(*keys).distinct(), "repeated_result"))
        .unionByName(code(have.join(planned.withColumnRenamed("artifact", "due"), keys).where("not artifact <=> due").select(*keys).distinct(), "artifact_mismatch"))
        .unionByName(code(due.join(got, [*keys, "metric"], "left_anti").join(have.select(*keys), keys, "left_semi").select(*keys).distinct(), "missing_metric"))
        .unionByName(code(got.join(due, [*keys, "metric"], "left_anti").join(planned, keys, "left_semi").select(*keys).distinct(), "unexpected_metric"))
    )


def compare(left: DataFrame, right: DataFrame, directions: dict[str, bool] | None = None) -> DataFrame:
    """(metric, delta, code) of two runs' metrics: right minus left, positive is better; metrics that one lacks are findings."""
    j = left.select("metric", F.col("value").alias("l")).join(right.select("metric", F.col("value").alias("r")), "metric", "full_outer")
    delta = F.when(lower_is_better(F.col("metric"), directions), F.col("l") - F.col("r")).otherwise(F.col("r") - F.col("l"))
    return j.select("metric", delta.alias("delta"), F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").alias("code"))


def comparison_findings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(code, key) for what refuses a paired comparison of (label, sample_id, fingerprint): labels or references that differ, samples that one lacks."""
    labels = left.select("label").distinct().withColumn("l", F.lit(1)).join(right.select("label").distinct().withColumn("r", F.lit(1)), "label", "full_outer")
    labels = labels.where("l is null or r is null").select(F.lit("label_mismatch").alias("code"), F.col("label").alias("key"))
    side = lambda df, name: df.select("sample_id", F.col("fingerprint").alias(name), F.lit(True).alias(f"has_{name}"))
    j = side(left, "l").join(side(right, "r"), "sample_id", "full_outer")
    code = F.when(F.col("has_r").isNull(), "only_left").when(F.col("has_l").isNull(), "only_right").when(~F.col("l").eqNullSafe(F.col("r")), "reference_mismatch")
    return labels.unionByName(j.select(code.alias("code"), F.col("sample_id").alias("key")).where("code is not null"))


def benchmark_table(metrics: DataFrame, intervals: DataFrame) -> DataFrame:
    """(label, metric, value, low, high, code): values with their intervals; a value outside its interval and a repeated label are findings."""
    m = metrics.withColumn("copies", F.count("*").over(Window.partitionBy("label", "metric")))
    j = m.join(intervals, ["label", "metric"], "left")
    code = F.when(F.col("copies") > 1, "duplicate_label").when(F.col("low").isNotNull() & ((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))), "outside_interval")
    return j.select("label", "metric", "value", "low", "high", code.alias("code"))


def missing_controls(metrics: DataFrame, required: DataFrame) -> DataFrame:
    """(run_id, control) that are required and not reported; ``required`` is a short list of names."""
    runs = metrics.select("run_id").distinct()
    return runs.crossJoin(F.broadcast(required)).join(metrics.select("run_id", "control").distinct(), ["run_id", "control"], "left_anti")


def release_gate(runs: DataFrame, metrics: DataFrame, ground: DataFrame, required: DataFrame, min_gain: float = 0.0, min_contribution: float = 0.0) -> DataFrame:
    """(run_id, code) for all that keeps a run from release; ``runs`` are (run_id, audit_passed, unsafe_access, expected_samples, provenance_run_id, declared).

    ``declared`` are the controls that the run's configuration names (null: it names none, and the rule is not applied), which are not taken for those it reports."""
    n = metrics.groupBy("run_id").agg(F.max("examples").alias("most"), F.min("examples").alias("least"))
    j = runs.join(n, "run_id", "left")
    rules = {
        "no_predictions": F.col("most").isNull(),
        "run_id_mismatch": ~F.col("provenance_run_id").eqNullSafe(F.col("run_id")),
        "unsafe_access": F.coalesce(F.col("unsafe_access"), F.lit(False)),
        "audit_missing": F.col("audit_passed").isNull(),
        "audit_failed": F.col("audit_passed") == F.lit(False),
        "sample_count_mismatch": F.col("most").isNotNull() & ((F.col("most") != F.col("least")) | (F.col("most") != F.col("expected_samples"))),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    out = j.select("run_id", F.explode(found).alias("code"))
    gone = missing_controls(metrics, required).select("run_id", F.concat(F.lit("control_unreported:"), "control").alias("code"))
    undeclared = runs.where("declared is not null").crossJoin(F.broadcast(required.select("control")))  # a short list of names
    undeclared = undeclared.where(~F.array_contains("declared", F.col("control"))).select("run_id", F.concat(F.lit("control_undeclared:"), "control").alias("code"))
    gone = gone.unionByName(undeclared)
    no_ground = runs.join(ground, "run_id", "left_anti").select("run_id", F.lit("grounding_missing").alias("code"))
    weak = ground.where(F.col("gain") <= min_gain).select("run_id", F.concat(F.lit("gain:"), "metric").alias("code"))
    low = ground.where(F.coalesce(F.col("contribution") <= min_contribution, F.lit(True))).select("run_id", F.concat(F.lit("contribution:"), "metric").alias("code"))
    return out.unionByName(gone).unionByName(no_ground).unionByName(weak).unionByName(low)


def label_invariance(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """(run_id, samples, changed): predictions with labels omitted, supplied and replaced must be the same."""
    p = lambda df, n: df.select("run_id", "sample_id", F.col("prediction_text").alias(n))
    j = p(a, "a").join(p(b, "b"), ["run_id", "sample_id"], "full_outer").join(p(c, "c"), ["run_id", "sample_id"], "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("a").eqNullSafe(F.col("c"))
    return j.groupBy("run_id").agg(F.count("*").alias("samples"), F.count_if(~same).alias("changed"))


def failure_explorer(p: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per sample: reference, full prediction, its error category, and a map of the controls' predictions."""
    by = p.groupBy("run_id", "sample_id").agg(
        F.max(F.when(F.col("control") == "full", F.col("reference_text"))).alias("reference"),
        F.max(F.when(F.col("control") == "full", F.col("prediction_text"))).alias("full"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("control") != "full", F.struct("control", "prediction_text"))))).alias("controls"),
    )
    return by.join(categories.where("control = 'full'").select("run_id", "sample_id", "category"), ["run_id", "sample_id"], "left")


#: Parts of names that give the answer away.
FORBIDDEN_PARTS = ("target", "label", "gold", "oracle", "reference", "stimulus_text")
FORBIDDEN = f"({'|'.join(FORBIDDEN_PARTS)})"


def evidence_schema(catalog: DataFrame) -> DataFrame:
    """(run_id, column_name) of declared inference columns whose names give the answer away."""
    return catalog.where(F.lower("column_name").rlike(FORBIDDEN)).select("run_id", "column_name")


def benchmark_label(labels: DataFrame) -> DataFrame:
    """The seven parts of slash labels, ``ok`` if there are seven and none is blank."""
    parts = F.split("label", "/")
    names = ("task", "dataset", "protocol", "model", "control", "seed", "version")
    ok = (F.size(parts) == 7) & ~F.exists(parts, lambda x: F.trim(x) == "")
    return labels.select("label", ok.alias("ok"), *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
