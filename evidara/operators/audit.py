"""Leakage audits: every check returns findings (code, severity, key, sample_ids, splits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.intervals import overlap_pairs

COLUMNS = ["code", "severity", "key", "sample_ids", "splits"]


def _finding(df: DataFrame, code: str, severity: str) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("key").cast("string").alias("key"), "sample_ids", "splits")


def _shared(samples: DataFrame, key: str) -> DataFrame:
    """Keys that occur in two splits or more, with all members; null splits count as members only."""
    t = samples.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    t = t.agg(F.sort_array(F.collect_set("sample_id")).alias("sample_ids"), F.sort_array(F.collect_set("split")).alias("splits"))
    return t.where(F.size("splits") > 1)


def group_across_splits(samples: DataFrame) -> DataFrame:
    return _finding(_shared(samples.select("sample_id", "split", F.explode("group_ids").alias("g")), "g"), "group_across_splits", "error")


def duplicate_target_text(samples: DataFrame, severity: str = "error") -> DataFrame:
    return _finding(_shared(samples, "fingerprint"), "duplicate_target_text", severity)


def duplicate_and_missing(samples: DataFrame) -> DataFrame:
    """Second and later copies of a sample id, and samples without a split."""
    again = samples.withColumn("n", F.row_number().over(Window.partitionBy("sample_id").orderBy("idx"))).where("n > 1")
    row = lambda df: df.select(F.col("sample_id").alias("key"), F.array("sample_id").alias("sample_ids"), F.filter(F.array("split"), lambda x: x.isNotNull()).alias("splits"))
    return _finding(row(again), "duplicate_sample", "error").unionByName(_finding(row(samples.where("split is null")), "missing_split", "error"))


def overlap_across_splits(windows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    p = overlap_pairs(windows, tolerance).where("left_split <> right_split")
    ids = F.array(F.col("left_id").cast("string"), F.col("right_id").cast("string"))
    p = p.select(F.col("recording_id").alias("key"), ids.alias("sample_ids"), F.sort_array(F.array("left_split", "right_split")).alias("splits"))
    return _finding(p, "interval_overlap", "error")


def pretraining_overlap(samples: DataFrame, exposure: DataFrame | None) -> DataFrame:
    """The first of sample, recording, dataset and text that pretraining has seen; one warning if exposure is undeclared."""
    if exposure is None:
        one = samples.sparkSession.range(1).select(F.lit("").alias("key"), F.array().cast("array<string>").alias("sample_ids"), F.array().cast("array<string>").alias("splits"))
        return _finding(one, "exposure_undeclared", "warning")
    known = exposure.select("kind", "value").distinct()
    s = samples
    ranks = (("sample", "sample_id"), ("recording", "session_id"), ("dataset", "dataset_id"), ("text", "fingerprint"))
    for kind, column in ranks:
        k = known.where(F.col("kind") == kind).select(F.col("value").alias(column), F.lit(kind).alias(f"hit_{kind}"))
        s = s.join(k, column, "left")
    hit = F.coalesce(*[F.col(f"hit_{k}") for k, _ in ranks])
    s = s.where(hit.isNotNull()).select(F.concat_ws(":", hit, "sample_id").alias("key"), F.array("sample_id").alias("sample_ids"), F.filter(F.array("split"), lambda x: x.isNotNull()).alias("splits"))
    return _finding(s, "pretraining_overlap", "error")


def information_access(access: DataFrame) -> DataFrame:
    """What a dataset's stages may see: text, context or audio at inference is an error, boundaries are a warning."""
    rules = (("text_at_inference", "error"), ("context_at_inference", "error"), ("audio_at_inference", "error"), ("token_boundaries", "warning"), ("event_boundaries", "warning"))
    found = F.filter(F.array(*[F.when(F.col(c), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s in rules]), lambda x: x.isNotNull())
    t = access.select(F.col("dataset_id").alias("key"), F.explode(found).alias("f"))
    empty = F.array().cast("array<string>")
    return t.select("f.code", "f.severity", F.col("key").cast("string").alias("key"), empty.alias("sample_ids"), empty.alias("splits"))


def split_audit(samples: DataFrame, exposure: DataFrame | None = None, windows: DataFrame | None = None, access: DataFrame | None = None) -> DataFrame:
    """All findings of the audits above in one table; the audit passes if none is an error."""
    out = group_across_splits(samples).unionByName(duplicate_target_text(samples)).unionByName(duplicate_and_missing(samples)).unionByName(pretraining_overlap(samples, exposure))
    if windows is not None:
        out = out.unionByName(overlap_across_splits(windows))
    return out if access is None else out.unionByName(information_access(access))


def _shared_counts(samples: DataFrame, key: str, code: str) -> DataFrame:
    """(code, severity, n, n_samples) of the keys in two splits or more, counted without gathering their members."""
    t = samples.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), "sample_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    t = t.groupBy("key").agg(F.count("*").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    return t.agg(F.count("*").alias("n"), F.sum("k").alias("n_samples")).where("n > 0").select(F.lit(code).alias("code"), F.lit("error").alias("severity"), "n", "n_samples")


def split_audit_counts(samples: DataFrame, exposure: DataFrame | None = None, windows: DataFrame | None = None, access: DataFrame | None = None) -> DataFrame:
    """``summary`` of ``split_audit``; a key with very many members costs a count."""
    out = _shared_counts(samples.select("sample_id", "split", F.explode("group_ids").alias("g")), "g", "group_across_splits")
    out = out.unionByName(_shared_counts(samples, "fingerprint", "duplicate_target_text"))
    rest = duplicate_and_missing(samples).unionByName(pretraining_overlap(samples, exposure))
    if windows is not None:
        rest = rest.unionByName(overlap_across_splits(windows))
    return out.unionByName(summary(rest if access is None else rest.unionByName(information_access(access))))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count("*").alias("n"), F.sum(F.size("sample_ids")).alias("n_samples"))
