"""Files as tables: manifests, JSON signals, predictions, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.plans.storage import staged

SAMPLE_SCHEMA = (
    "sample_id string, dataset_id string, subject_id string, modality string, split string, session_id string, run_id string, trial_id string, task string, "
    "group_ids array<string>, metadata map<string,string>, signal struct<uri:string,recording_id:string,array_key:string,checksum_sha256:string,sampling_rate_hz:double,channel_count:int,channel_names:array<string>>, "
    "interval struct<start_s:double,end_s:double>, target struct<text:string,language:string,token_start_s:array<double>,token_end_s:array<double>>"
)
PREDICTION_SCHEMA = "run_id string, sample_id string, control string, prediction_text string, reference_text string, target_free boolean, evidence_score double"


def _classified(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(value, path, place, what, s): every non-blank line is a 'header', a 'sample' with its fields in ``s``, or the code of a finding.

    ``place`` orders the lines of a part of a file; its first part begins at 0."""
    t = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place"))
    t = t.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    t = t.withColumn("s", F.from_json("value", SAMPLE_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).withColumn("kind", F.get_json_object("value", "$.kind"))
    what = (
        F.when(F.coalesce(F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))), F.lit(0)) != 1, "invalid_json")  # nothing may stand behind the value
        .when(~F.col("value").rlike(r"^\s*\{"), "not_an_object")
        .when(F.col("kind") == "manifest", "header")
        .when(F.col("kind").isNotNull(), "unknown_kind")
        .when(F.col("s._corrupt").isNotNull(), "wrong_type")
        .when(F.trim(F.coalesce("s.sample_id", F.lit(""))) == "", "missing_sample_id")
        .otherwise("sample")
    )
    return t.withColumn("what", what)


def read_manifest(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Sample rows of JSONL manifests, defaults filled in; headers and blank lines are left out, and what is neither is one of ``manifest_findings``."""
    s = _classified(spark, paths).where("what = 'sample'").select("s.*").drop("_corrupt")
    target = F.when(F.col("target").isNotNull(), F.col("target").withField("language", F.coalesce("target.language", F.lit("en"))))
    return s.withColumn("target", target).withColumn("task", F.coalesce("task", F.lit("unknown")))


def manifest_findings(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(code, key): lines that are no header and no sample (invalid JSON, no object, an unknown kind, a field of a wrong type, no sample id), a header that is missing or stands
    behind other lines of its file, repeated ids, several datasets."""
    t = _classified(spark, paths)
    code = lambda df, name, key: df.select(F.lit(name).alias("code"), key.alias("key"))
    bad = t.where(~F.col("what").isin("header", "sample")).select(F.col("what").alias("code"), F.md5("value").alias("key"))
    first = t.groupBy("path").agg(F.min(F.struct("part", "place")).alias("first"))
    late = t.where("what = 'header'").join(first, "path").where(F.col("first") < F.struct("part", "place"))
    none = t.agg(F.count_if(F.col("what") == "header").alias("n")).where("n = 0")
    s = t.where("what = 'sample'").select("s.sample_id", "s.dataset_id")
    again = s.groupBy("sample_id").count().where("count > 1")
    sets = s.select("dataset_id").distinct().agg(F.count("*").alias("n")).where("n > 1")
    out = bad.unionByName(code(late, "header_not_first", F.col("path"))).unionByName(code(none, "missing_header", F.lit("")))
    return out.unionByName(code(again, "duplicate_sample", F.col("sample_id"))).unionByName(code(sets, "several_datasets", F.lit("")))


def write_manifest(samples: DataFrame, path: str, dataset_id: str) -> None:
    """One header file and the sample lines, keys in sorted order; lines are written by all executors."""
    spark = samples.sparkSession
    header = spark.range(1).select(F.to_json(F.struct(F.lit(dataset_id).alias("dataset_id"), F.lit("manifest").alias("kind"))).alias("value"))
    header.write.text(f"{path}/header")
    samples.select(F.to_json(F.struct(*[F.col(c) for c in sorted(samples.columns)])).alias("value")).write.text(f"{path}/samples")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.schema(PREDICTION_SCHEMA).json(path)
    return p.withColumn("control", F.coalesce("control", F.lit("full"))).withColumn("target_free", F.coalesce("target_free", F.lit(True)))


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.partitionBy("run_id", "control").json(path)


def read_signals(spark: SparkSession, samples: DataFrame, root: str, suffix: str = ".json") -> tuple[DataFrame, DataFrame]:
    """(signals, findings) of the JSON matrices that ``samples`` (sample_id, uri, checksum_sha256, channel_count) name below ``root``, in files that end in ``suffix``.

    A file is one matrix or, for samples with an ``array_key``, has a line ``{"key": ..., "values": matrix}`` for each of many, so that small matrices need no file each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    files = files.withColumn("uri", F.substring_index("path", below, -1))
    keyed, matrix = "array_key" in samples.columns, "array<array<double>>"
    parts = F.array(F.col("content").cast("string"))
    parts = F.when(F.col("content").cast("string").rlike(r"^\s*\{"), F.split(F.col("content").cast("string"), "\n")).otherwise(parts) if keyed else parts
    arrays = files.select("uri", F.sha2("content", 256).alias("actual"), F.explode(parts).alias("text"))
    if not keyed:
        j = samples.join(arrays.select("uri", "actual", F.from_json("text", matrix).alias("values")), "uri", "left").withColumns({"there": F.col("actual"), "n": F.lit(1)})
    else:
        line = F.from_json("text", f"key string, values {matrix}")
        one = arrays.where(F.trim("text") != "").select("uri", "actual", F.when(F.col("text").rlike(r"^\s*\{"), line).otherwise(F.struct(F.lit(None).cast("string").alias("key"), F.from_json("text", matrix).alias("values"))).alias("a"))
        one = one.select("uri", "actual", F.coalesce("a.key", F.lit("")).alias("key"), "a.values").groupBy("uri", "key").agg(F.first("actual").alias("actual"), F.first("values").alias("values"), F.count("*").alias("n"))
        j = samples.withColumn("key", F.coalesce("array_key", F.lit(""))).join(one, ["uri", "key"], "left").join(files.select("uri", F.lit("").alias("there")), "uri", "left")
    code = (
        F.when(F.col("uri").rlike(r"^/|(^|/)\.\.(/|$)") | ~F.col("uri").endswith(suffix), "bad_path")
        .when(F.col("there").isNull(), "missing_file")
        .when(F.col("actual").isNull(), "missing_array")
        .when(F.col("n") > 1, "repeated_array")
        .when(F.col("checksum_sha256") != F.col("actual"), "checksum_mismatch")
        .when(F.col("values").isNull() | (F.size("values") != F.col("channel_count")), "bad_channels")
        .when(F.size(F.array_distinct(F.transform("values", lambda c: F.size(c)))) > 1, "not_rectangular")
        .when(F.exists("values", lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), "not_finite")
    )
    j = j.withColumn("code", code)
    return j.where("code is null").select("sample_id", "values"), j.where("code is not null").select("sample_id", "code")


def read_authorized_features(spark: SparkSession, samples: DataFrame, mapping: DataFrame, root: str, suffix: str = ".json") -> tuple[DataFrame, DataFrame]:
    """Signals by a mapping table (sample_id, split, uri, checksum_sha256, and array_key where files hold many); samples without a mapping are findings."""
    where = [c for c in ("uri", "array_key", "checksum_sha256") if c in mapping.columns]
    mapped = samples.select("sample_id", "channel_count").join(mapping.select("sample_id", *where), "sample_id")
    signals, findings = read_signals(spark, mapped, root, suffix)
    unmapped = samples.join(mapping, "sample_id", "left_anti").select("sample_id", F.lit("unmapped").alias("code"))
    return signals, findings.unionByName(unmapped)


def checksum_findings(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(uri, code) of (uri, expected) against files (uri, content): the first rule that fails."""
    j = expected.join(files.select("uri", F.sha2("content", 256).alias("actual"), F.length("content").alias("size")), "uri", "full_outer")
    code = (
        F.when(F.col("expected").isNull(), "unexpected")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("uri").rlike(r"^/|\\|(^|/)\.\.(/|$)"), "non_portable_path")
        .when(~F.col("uri").endswith(".json"), "wrong_extension")
        .when(~F.col("expected").rlike("^[0-9a-f]{64}$"), "malformed_checksum")
        .when(F.col("size") == 0, "empty")
        .when(F.col("expected") != F.col("actual"), "mismatch")
    )
    return j.select("uri", code.alias("code")).where("code is not null")


def table_digest(df: DataFrame, row: Column, key: str) -> DataFrame:
    """Digest of a table whatever the order of its rows, per key and per first two digits of the row hashes, so that no group is all of a key."""
    h = df.select(F.col(key).alias("k"), F.sha2(row, 256).alias("h")).select(F.concat("k", F.lit("/"), F.substring("h", 1, 2)).alias(key), "h")
    return h.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def tree_digest(df: DataFrame, row: Column, key: str, leaf: int = 4096) -> DataFrame:
    """(key, n, digest): one digest of each key's rows whatever their order, from a tree over the first digits of the row hashes.

    A leaf holds the rows of a key that share so many digits that ``leaf`` rows would be there if the largest key's hashes were even; its digest is that of its sorted hashes, and a
    node's that of its children's digests in order, sixteen at most. So no task gathers more than a leaf, however many rows there are. Rows that
    repeat are counted in the leaf, not listed."""
    h = df.select(F.col(key).alias("key"), F.sha2(row, 256).alias("h")).groupBy("key", "h").agg(F.count("*").alias("copies"))
    h = staged(h, "hashes")
    most = h.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = 0
    while most > leaf * 16**digits:
        digits += 1
    node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ","), 256)
    t = h.select("key", F.col("h").alias("p"), F.concat_ws(":", "h", F.col("copies").cast("string")).alias("d"), F.col("copies").alias("n"))
    for size in range(digits, -1, -1):
        t = t.groupBy("key", F.substring("p", 1, size).alias("q")).agg(node.alias("d"), F.sum("n").alias("n")).withColumnRenamed("q", "p")
    return t.select(F.col("key").alias(key), "n", F.col("d").alias("digest"))


def inventory_findings(files: DataFrame) -> DataFrame:
    """(code, key) of a listing (path, task, version, subject): paths without a subject, subjects that a task has twice in a version, tasks with several versions,
    and subjects that lack a task which others have."""
    named = files.where("coalesce(subject, '') <> ''")
    code = lambda df, name, key: df.select(F.lit(name).alias("code"), key.alias("key"))
    blank = code(files.where("coalesce(subject, '') = ''"), "unparsable_subject", F.col("path"))
    twice = named.groupBy("task", "version", "subject").agg(F.count("*").alias("n")).where("n > 1")
    versions = files.groupBy("task").agg(F.count_distinct("version").alias("n")).where("n > 1")
    tasks = files.agg(F.count_distinct("task").alias("due"))
    partial = named.groupBy("subject").agg(F.count_distinct("task").alias("n")).crossJoin(F.broadcast(tasks)).where("n < due")  # one row
    out = blank.unionByName(code(twice, "duplicate_subject", F.concat_ws("/", "task", "version", "subject")))
    return out.unionByName(code(versions, "several_versions", F.col("task"))).unionByName(code(partial, "partial_task_set", F.col("subject")))
