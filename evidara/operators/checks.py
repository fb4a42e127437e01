"""Row and record contracts: each check explodes the rules that a row violates; small array helpers beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) for every rule whose condition holds; a null condition does not."""
    found = F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("code"))


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def sample_contract(samples: DataFrame) -> DataFrame:
    """Violations of (sample_id, subject_id, rate, channel_count, channel_names, start_s, end_s, token_start_s, token_end_s, group_ids)."""
    ts, te, g = F.col("token_start_s"), F.col("token_end_s"), F.col("group_ids")
    return violations(
        samples,
        "sample_id",
        {
            "blank_id": blank("sample_id") | blank("subject_id"),
            "bad_rate": not_finite(F.col("rate")) | (F.col("rate") <= 0),
            "bad_channel_count": F.col("channel_count").isNull() | (F.col("channel_count") <= 0),
            "channel_names_length": F.col("channel_names").isNotNull() & (F.size("channel_names") != F.col("channel_count")),
            "bad_interval": F.col("start_s").isNull() | F.col("end_s").isNull() | (F.col("start_s") < 0) | (F.col("start_s") >= F.col("end_s")),
            "token_times_incomplete": ts.isNull() != te.isNull(),
            "token_times_length": F.size(ts) != F.size(te),
            "token_times_order": F.exists(F.arrays_zip(ts.alias("s"), te.alias("e")), lambda x: x["e"] < x["s"]),
            "bad_group_ids": F.exists(g, lambda x: F.trim(x) == "") | (F.size(g) != F.size(F.array_distinct(g))),
        },
    )


def prepared_contract(rows: DataFrame) -> DataFrame:
    """Violations of (sample_id, values array<array<double>>, channels, channel_mask, time_mask)."""
    v = F.col("values")
    return violations(
        rows,
        "sample_id",
        {
            "channel_count": F.size(v) != F.col("channels"),
            "no_time": F.size(v[0]) < 1,
            "not_rectangular": F.exists(v, lambda c: F.size(c) != F.size(v[0])),
            "not_finite": F.exists(v, lambda c: F.exists(c, not_finite)),
            "channel_mask_length": F.size("channel_mask") != F.size(v),
            "time_mask_length": F.size("time_mask") != F.size(v[0]),
            "no_valid_channel": ~F.exists("channel_mask", lambda x: x),
            "no_valid_time": ~F.exists("time_mask", lambda x: x),
        },
    )


def prediction_contract(p: DataFrame) -> DataFrame:
    return violations(p, "sample_id", {"blank_id": blank("sample_id") | blank("run_id") | blank("control"), "blank_text": blank("prediction_text"), "bad_score": F.col("evidence_score").isNotNull() & not_finite(F.col("evidence_score"))})


def canonical_conversion(samples: DataFrame, access: DataFrame) -> DataFrame:
    """Violations of (sample_id, dataset_id, split, target_text, uri, source_record_id) against (dataset_id, train_target, validation_target)."""
    s = samples.join(access, "dataset_id", "left")
    allowed = F.when(F.col("split") == "train", F.col("train_target")).when(F.col("split") == "validation", F.col("validation_target")).otherwise(F.lit(False))
    s = s.withColumn("allowed", F.coalesce(allowed, F.lit(False))).withColumn("copies", F.count("*").over(Window.partitionBy("sample_id")))
    return violations(
        s,
        "sample_id",
        {
            "bad_split": F.col("split").isNull() | ~F.col("split").isin("train", "validation", "test"),
            "target_missing": F.col("allowed") & blank("target_text"),
            "target_forbidden": ~F.col("allowed") & ~blank("target_text"),
            "uri_not_portable": F.col("uri").rlike(r"^/|^[a-z]+://|(^|/)\.\.(/|$)"),
            "raw_extension": F.lower("uri").rlike(r"\.(mat|h5|hdf5|fif|edf|bdf)$"),
            "no_source_record": blank("source_record_id"),
            "duplicate_sample": F.col("copies") > 1,
        },
    )


def typed_events(events: DataFrame) -> DataFrame:
    """Violations of (idx, subject_id, recording_id, modality, rate, duration_s, event_id, text, timestamp_s, window_s).

    A recording's modality is that of its first row with both fields valid; later rows that differ are mixed."""
    known = F.col("modality").isin("eeg", "meg") & ~blank("recording_id")
    w = Window.partitionBy("recording_id").orderBy("idx")
    e = events.withColumn("first_modality", F.first(F.when(known, F.col("modality")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ok_time = ~not_finite(F.col("timestamp_s")) & (F.col("timestamp_s") >= 0)
    ok_span = ~not_finite(F.col("duration_s")) & (F.col("duration_s") > 0)
    return violations(
        e,
        "idx",
        {
            "no_subject": blank("subject_id"),
            "no_recording": blank("recording_id"),
            "bad_modality": ~F.coalesce(F.col("modality").isin("eeg", "meg"), F.lit(False)),
            "no_event": blank("event_id") | blank("text"),
            "bad_timestamp": ~ok_time,
            "bad_rate": not_finite(F.col("rate")) | (F.col("rate") <= 0),
            "bad_duration": ~ok_span,
            "exceeds_recording": ok_time & ok_span & (F.col("timestamp_s") + F.col("window_s") > F.col("duration_s")),
            "mixed_modality": known & (F.col("modality") != F.col("first_modality")),
        },
    )


def typed_event_plan(events: DataFrame) -> DataFrame:
    """Events by modality, zero-filled, and the digest of their schema (subject, recording and modality of every event, in any order), only if no event violates a rule.

    Equal rows are counted before they are hashed together, in 256 parts by their own hash and then those parts."""
    bad = typed_events(events).agg(F.count("*").alias("bad"))
    every = events.sparkSession.createDataFrame([("eeg",), ("meg",)], "modality string")
    n = events.groupBy("modality").agg(F.count("*").alias("n"))
    return every.join(n, "modality", "left").crossJoin(F.broadcast(bad)).where("bad = 0").select("modality", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(schema_digest(events)))  # one row each


def schema_digest(events: DataFrame) -> DataFrame:
    h = F.sha2(F.concat_ws("\x1f", "subject_id", "recording_id", "modality"), 256)
    h = events.groupBy(h.alias("h")).agg(F.count("*").alias("n")).select(F.substring("h", 1, 2).alias("part"), F.concat_ws(":", "h", "n").alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    return h.groupBy("part").agg(joined("h").alias("d")).select(F.concat_ws(":", "part", "d").alias("d")).agg(joined("d").alias("schema_digest"))


def descriptors(rows: DataFrame) -> DataFrame:
    """Violations of (idx, subject_id, block_id, day_id, session_id, recording_id, access, contract)."""
    ids = ("subject_id", "block_id", "day_id", "session_id", "recording_id")
    missing = F.lit(False)
    for c in ids:
        missing = missing | blank(c)
    r = rows.withColumn("missing", missing)
    again = F.row_number().over(Window.partitionBy("missing", *ids[:4]).orderBy("idx"))
    r = r.withColumn("again", again)
    return violations(r, "idx", {"missing_id": F.col("missing"), "duplicate_descriptor": ~F.col("missing") & (F.col("again") > 1), "access_mismatch": ~F.col("missing") & ~F.col("access").eqNullSafe(F.col("contract"))})


def alignment_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(violations, minimised records) of (record_id, sentence_id, text, words array<struct<index,start_s,end_s>>, fixations array<struct<word_index,start_s,end_s>>, rate, channels)."""
    ok = lambda x: x["index"].isNotNull() & (x["start_s"] >= 0) & (x["end_s"] >= x["start_s"])
    good = F.filter("words", ok)
    found = F.array_sort(F.array_distinct(F.transform(good, lambda x: x["index"])))
    r = rows.withColumn("good", good).withColumn("found", found)
    bad_fix = F.exists("fixations", lambda f: ~F.array_contains("found", f["word_index"]) | (f["start_s"] < 0) | (f["end_s"] < f["start_s"]))
    rules = {
        "no_sentence": blank("sentence_id") | blank("text"),
        "no_words": F.size("words") < 1,
        "bad_word_timing": F.size("good") < F.size("words"),
        "word_index_gap": (F.size("good") > 0) & (F.col("found") != F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: i.cast("long"))),
        "bad_fixation": bad_fix,
        "bad_eeg": not_finite(F.col("rate")) | (F.col("rate") <= 0) | (F.col("channels") < 1),
    }
    v = violations(r, "record_id", rules)
    r = r.withColumn("record_id", F.col("record_id").cast("string"))
    clean = r.join(v.select(F.col("key").alias("record_id")).distinct(), "record_id", "left_anti")
    return v, clean.select("record_id", F.sha2("text", 256).alias("text_sha256"), F.size("words").alias("n_words"), F.size("fixations").alias("n_fixations"))


def feature_binding(features: DataFrame, samples: DataFrame) -> DataFrame:
    """Findings on (sample_id, split, fitted) against the samples' splits."""
    s = samples.select("sample_id", F.col("split").alias("own"), F.lit(True).alias("known"))
    f = features.join(s, "sample_id", "left")
    return violations(
        f,
        "sample_id",
        {
            "fitted_on_unknown": F.col("fitted") & F.col("known").isNull(),
            "fitted_on_non_train": F.col("fitted") & F.col("known") & ~F.coalesce(F.col("own") == "train", F.lit(False)),
            "mapping_unknown": ~F.col("fitted") & F.col("known").isNull(),
            "mapping_split_differs": ~F.col("fitted") & F.col("known") & ~F.col("split").eqNullSafe(F.col("own")),
        },
    )


def montage_select(rows: DataFrame) -> DataFrame:
    """(vec_id, picked, missing): values of the montage's channels in its order, and the channels a row lacks."""
    pick = F.transform("montage", lambda n: F.get("values", F.array_position("names", n).cast("int") - 1))
    return rows.select("vec_id", pick.alias("picked"), F.array_except("montage", "names").alias("missing"))


def tensorize(sensors: DataFrame) -> DataFrame:
    """Per layout its ordered sensors as arrays, padded with zeros to the longest layout."""
    t = sensors.groupBy("layout_id").agg(F.array_sort(F.collect_list(F.struct("name", "x", "y", "z"))).alias("s"))
    most = t.agg(F.max(F.size("s")).alias("m"))
    t = t.crossJoin(F.broadcast(most))  # one row
    pad = lambda c: F.concat(F.transform("s", lambda x: x[c]), F.array_repeat(F.lit(0.0), F.col("m") - F.size("s"))).alias(c)
    return t.select("layout_id", F.size("s").alias("n"), F.transform("s", lambda x: x["name"]).alias("names"), pad("x"), pad("y"), pad("z"))


def numeric_parity(expected: DataFrame, got: DataFrame, atol: float = 1e-6, rtol: float = 1e-6) -> DataFrame:
    """Per signal the largest and mean differences, and whether one of the tolerances holds; a cell that is missing fails."""
    j = expected.join(got.withColumnRenamed("value", "other"), ["vec_id", "channel", "t"], "full_outer")
    diff = F.abs(F.col("value") - F.col("other"))
    a = j.groupBy("vec_id").agg(F.max(diff).alias("max_abs"), F.avg(diff).alias("mean_abs"), F.max(diff / F.greatest(F.abs("value"), F.lit(1e-12))).alias("max_rel"), F.count_if(diff.isNull() | F.isnan(diff)).alias("bad"))
    return a.withColumn("passed", (F.col("bad") == 0) & ((F.col("max_abs") <= atol) | (F.col("max_rel") <= rtol)))


def ctc_collapse(logits: DataFrame, blank: int = 0) -> DataFrame:
    """(vec_id, tokens): best token of each step, repeats and blanks dropped; ties go to the smaller token."""
    best = logits.groupBy("vec_id", "t").agg(F.max_by("token", F.struct("score", -F.col("token"))).alias("k"))
    before = F.lag("k", 1, blank).over(Window.partitionBy("vec_id").orderBy("t"))
    kept = best.withColumn("p", before)
    tokens = F.filter(F.array_sort(F.collect_list(F.struct("t", "k", "p"))), lambda x: (x["k"] != blank) & (x["k"] != x["p"]))
    return kept.groupBy("vec_id").agg(F.transform(tokens, lambda x: x["k"]).alias("tokens"))
