"""Queries through files, streams and user functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidara.operators import evaluation as E
from evidara.operators import signals as G
from evidara.plans.storage import shared_dir
from evidara.plans.views import view
from evidara.queries.registry import query
from evidara.sources import files as S
from evidara.streaming import windows as W


def fresh(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("manifest_scan", ("samples",), "SELECT sample_id, subject_id, split, md5(text) AS text, 'en' AS language, 'unknown' AS task FROM samples")
def manifest_scan(spark, d):
    s = view(spark, d, "samples")
    s = s.select("sample_id", "dataset_id", "subject_id", "split", F.array("group_id").alias("group_ids"), F.struct(F.col("text").alias("text")).alias("target"))
    path = fresh(spark, "manifest")
    S.write_manifest(s, path, "docs")
    m = S.read_manifest(spark, [f"{path}/header", f"{path}/samples"])
    return m.select("sample_id", "subject_id", "split", F.md5("target.text").alias("text"), F.col("target.language").alias("language"), "task")


@query("manifest_write", ("samples",), "SELECT count(*) + 1 AS lines, 1 AS headers, 0 AS findings FROM samples")
def manifest_write(spark, d):
    path = fresh(spark, "manifest")
    S.write_manifest(view(spark, d, "samples").select("sample_id", "dataset_id", "subject_id", "split"), path, "docs")
    both = [f"{path}/header", f"{path}/samples"]
    found = S.manifest_findings(spark, both).agg(F.count("*").cast("int").alias("findings"))
    return spark.read.text(both).agg(F.count("*").alias("lines"), F.count_if(F.col("value").contains('"kind"')).cast("int").alias("headers")).crossJoin(found)  # one row each


_FAULT = "CASE doc_id % 12 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'missing_sample_id' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'wrong_type' WHEN 5 THEN 'unknown_kind' ELSE 'sample' END"


@query("manifest_faults", (), f"SELECT code, count(*) AS n FROM (SELECT {_FAULT} AS code FROM documents) GROUP BY code UNION ALL SELECT 'missing_header', 1")
def manifest_faults(spark, d):
    """A manifest without a header in which five of twelve lines are broken, each in another way: every line is a sample or a finding."""
    t = spark.read.parquet(f"{d}/documents.parquet")
    k, i = F.col("doc_id") % 12, F.col("doc_id").cast("string")
    good = F.to_json(F.struct(F.lit("docs").alias("dataset_id"), i.alias("sample_id"), F.struct("text").alias("target")))
    line = F.when(k == 1, F.concat(F.lit('{"sample_id": "'), i)).when(k == 2, F.to_json(F.struct("lang"))).when(k == 3, F.concat(F.lit("["), i, F.lit("]")))
    line = line.when(k == 4, F.concat(F.lit('{"sample_id": "'), i, F.lit('", "interval": "soon"}'))).when(k == 5, F.concat(F.lit('{"kind": "other", "sample_id": "'), i, F.lit('"}'))).otherwise(good)
    path = fresh(spark, "faults")
    t.select(line.alias("value")).write.text(path)
    found = S.manifest_findings(spark, path).groupBy("code").agg(F.count("*").alias("n"))
    return found.unionByName(S.read_manifest(spark, path).agg(F.count("*").alias("n")).select(F.lit("sample").alias("code"), "n"))


#: Matrices of one file; the work of a file (its folder, its commit, its listing) is many times that of a matrix.
MATRICES = 1024


def signal_files(spark, d):
    """(root, declared samples): the embeddings as JSON matrices of 8 channels in files of MATRICES or so, some of them faulty; and what a manifest says of them."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("embedding", c * 8 + 1, F.lit(8))).alias("m"))
    short = F.concat(F.slice("m", 1, 7), F.array(F.slice(F.element_at("m", 8), 1, 7)))
    matrix = F.when(F.col("vec_id") % 17 == 0, F.slice("m", 1, 7)).when(F.col("vec_id") % 19 == 0, short).otherwise(F.col("m"))
    bundle = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-e.count() // MATRICES))))
    text = e.select("vec_id", bundle.alias("bundle"), F.to_json(F.struct(F.col("vec_id").cast("string").alias("key"), matrix.alias("values"))).alias("value"))
    root = fresh(spark, "signals")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # told, so that a bundle is one file
    text.where("vec_id % 13 <> 0").select("bundle", "value").repartition(parts, "bundle").write.partitionBy("bundle").text(root)  # named .txt by the writer
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    uri = F.regexp_extract("path", r"(bundle=\d+/[^/]+)$", 1)
    listed = listed.select(uri.alias("uri"), F.regexp_extract("path", r"bundle=(\d+)/", 1).cast("long").alias("bundle"))
    s = text.select("vec_id", F.when(F.col("vec_id") % 13 != 0, F.col("bundle")).alias("bundle"), F.when(F.col("vec_id") % 23 == 0, F.repeat(F.lit("0"), F.lit(64))).alias("checksum_sha256")).join(listed, "bundle", "left")
    s = s.select(F.col("vec_id").cast("string").alias("sample_id"), F.coalesce(F.when(F.col("vec_id") % 29 == 0, F.concat(F.lit("../"), "uri")).otherwise(F.col("uri")), F.lit("none.txt")).alias("uri"), F.col("vec_id").cast("string").alias("array_key"), "checksum_sha256", F.lit(8).alias("channel_count"))
    return root, s


_SIGNAL_CODE = """CASE WHEN vec_id % 13 <> 0 AND vec_id % 29 = 0 THEN 'bad_path' WHEN vec_id % 13 = 0 THEN 'missing_file' WHEN vec_id % 23 = 0 THEN 'checksum_mismatch' WHEN vec_id % 17 = 0 THEN 'bad_channels' WHEN vec_id % 19 = 0 THEN 'not_rectangular' END"""


@query("signal_json_scan", (), f"SELECT vec_id::VARCHAR AS sample_id, coalesce({_SIGNAL_CODE}, 'ok') AS code, CASE WHEN {_SIGNAL_CODE} IS NULL THEN 64 ELSE 0 END AS n_values FROM embeddings")
def signal_json_scan(spark, d):
    root, s = signal_files(spark, d)
    return scanned(*S.read_signals(spark, s, root, ".txt"))


def scanned(good, bad):
    n = F.aggregate("values", F.lit(0), lambda a, c: a + F.size(c))
    return good.select("sample_id", F.lit("ok").alias("code"), n.alias("n_values")).unionByName(bad.select("sample_id", "code", F.lit(0).alias("n_values")))


@query("authorized_feature_scan", (), f"SELECT vec_id::VARCHAR AS sample_id, CASE WHEN vec_id % 7 = 0 THEN 'unmapped' ELSE coalesce({_SIGNAL_CODE}, 'ok') END AS code, CASE WHEN vec_id % 7 <> 0 AND {_SIGNAL_CODE} IS NULL THEN 64 ELSE 0 END AS n_values FROM embeddings")
def authorized_feature_scan(spark, d):
    root, s = signal_files(spark, d)
    mapping = s.where("cast(sample_id as long) % 7 <> 0").select("sample_id", F.lit("train").alias("split"), "uri", "array_key", "checksum_sha256")
    return scanned(*S.read_authorized_features(spark, s.select("sample_id", "channel_count"), mapping, root, ".txt"))


@query("prediction_scan", ("predictions",), "SELECT run_id, control, sample_id, md5(prediction_text) AS prediction, true AS target_free FROM predictions")
def prediction_scan(spark, d):
    path = fresh(spark, "predictions")
    S.write_predictions(view(spark, d, "predictions").select("run_id", "control", "sample_id", "prediction_text"), path)
    p = S.read_predictions(spark, path)
    return p.select("run_id", "control", "sample_id", F.md5("prediction_text").alias("prediction"), "target_free")


@query("prediction_write", ("predictions",), "SELECT run_id, control, count(*) AS n FROM predictions GROUP BY run_id, control")
def prediction_write(spark, d):
    path = fresh(spark, "predictions")
    S.write_predictions(view(spark, d, "predictions"), path)
    return S.read_predictions(spark, path).groupBy("run_id", "control").agg(F.count("*").alias("n"))


_CHUNKS = """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, value FROM events), w AS (SELECT user_id, unnest([s - s % 10800, s - s % 10800 - 10800]) AS start_s, value FROM e)
 SELECT user_id, start_s, count(*) AS n, round(sum(value), 4) AS total FROM w {} GROUP BY user_id, start_s"""


@query("stream_chunk", (), _CHUNKS.format("WHERE start_s + 21600 <= (SELECT max(s) FROM e) - 604800"))
def stream_chunk(spark, d):
    """Windows that the watermark has closed; later ones stay in the stream's state."""
    e = W.read_stream(spark, f"{d}/events.parquet").select("user_id", W.instant().alias("at"), "value")
    return W.drain(W.chunks(e))


@query("batch_chunk", (), _CHUNKS.format(""))
def batch_chunk(spark, d):
    return W.chunks(spark.read.parquet(f"{d}/events.parquet").select("user_id", W.instant().alias("at"), "value"))


@query(
    "stream_drop_later",
    (),
    """WITH RECURSIVE w AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 300 AS e FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS i FROM w),
    f AS (SELECT user_id, i, event_id, s, true AS kept, e AS reach FROM o WHERE i = 1
      UNION ALL SELECT o.user_id, o.i, o.event_id, o.s, o.s >= f.reach, CASE WHEN o.s >= f.reach THEN o.e ELSE f.reach END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
    SELECT event_id FROM f WHERE kept AND s < (SELECT max(s) FROM w) - 604800""",
)
def stream_drop_later(spark, d):
    """Windows that began before the watermark; later ones wait in the stream's state."""
    e = W.read_stream(spark, f"{d}/events.parquet").withColumn("at", W.instant())
    s = F.unix_micros("at") / 1e6
    return W.drain(W.drop_later(e.select(F.col("user_id").alias("recording_id"), "event_id", s.alias("start_s"), (s + F.col("value") * 300).alias("end_s"), "at")))


@query("stream_audit", ("samples",), "SELECT 'cross_split_text' AS code, fingerprint AS key, count(DISTINCT split) AS n FROM samples GROUP BY fingerprint HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'duplicate_sample', sample_id, count(*) FROM samples GROUP BY sample_id HAVING count(*) > 1")
def stream_audit(spark, d):
    """A document arrives each second; what is known of a text or an id is kept for the lateness of the stream."""
    from evidara.operators.text import fingerprint

    docs = W.read_stream(spark, f"{d}/documents.parquet")
    k = F.col("doc_id") % 10
    split = F.when(F.col("doc_id") % 97 == 0, F.lit(None)).when(k <= 6, "train").when(k == 7, "validation").otherwise("test")
    docs = docs.select(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("at"), split.alias("split"), fingerprint(F.col("text")).alias("fingerprint"), F.col("doc_id").cast("string").alias("sample_id"))
    leaks, again = (W.settled(W.drain(W.seen(docs, key))) for key in ("fingerprint", "sample_id"))
    leaks = leaks.where("n_splits > 1").select(F.lit("cross_split_text").alias("code"), "key", F.col("n_splits").alias("n"))
    return leaks.unionByName(again.where("n > 1").select(F.lit("duplicate_sample").alias("code"), "key", "n"))


_LATE = """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, value FROM events), w AS (SELECT event_id, user_id, unnest([s - s % 10800, s - s % 10800 - 10800]) AS start_s, value FROM e),
 m AS (SELECT max(s) FILTER (event_id % 3 <> 0) - 604800 AS first, max(s) - 604800 AS last FROM e), c AS (SELECT w.*, event_id % 3 = 0 AND start_s + 21600 <= first AS late FROM w, m)
 SELECT CASE WHEN late THEN 'late' ELSE 'chunk' END AS kind, user_id, start_s, count(*) AS n, round(sum(value), 4) AS total FROM c, m WHERE late OR start_s + 21600 <= last GROUP BY ALL"""


#: Rows of a file of arrivals, about.
ARRIVAL_ROWS = 1 << 18


@query("stream_chunk_late", (), _LATE)
def stream_chunk_late(spark, d):
    """Two thirds of the events arrive first, the others after them: those that are behind the watermark then are counted as late."""
    path = fresh(spark, "arrivals")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", W.instant().alias("at"), "value")
    files = max(1, e.count() // ARRIVAL_ROWS)
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        e.where(part).repartition(files).write.mode("append").parquet(path)  # as many files for each, none of them empty, so a batch is one of the two
    with W.rocks_db(spark):
        out = W.drain(W.chunks_and_late(W.read_stream(spark, path, files_per_batch=files)))
    return out.select("kind", "user_id", "start_s", "n", F.round("total", 4).alias("total"))


def generate(cells, function):
    """A target-free user function over signals, in batches; the frame handed to it has the signal columns only."""
    return cells.select("vec_id", "channel", "t", "value").groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("channel", "t", "value"))).alias("x")).select("vec_id", F.transform("x", lambda r: r["value"]).alias("signal")).mapInPandas(function, "vec_id long, prediction double")


def _energy(batches):
    for b in batches:
        yield b.assign(prediction=[float(round(sum(v * v for v in s), 6)) for s in b["signal"]])[["vec_id", "prediction"]]


@query("faithfulness_suite")
def faithfulness_suite(spark, d):
    """The user function on the full signal and on each control; how far its answers move, and the grounding of that."""
    c = view(spark, d, "cells")
    full = generate(c, _energy).withColumnRenamed("prediction", "reference")
    out = None
    for name in ("full", "shuffled", "zero", "noise"):
        p = generate(c if name == "full" else G.control(c, name), _energy).join(full, "vec_id")
        m = p.agg(F.avg(F.exp(-F.abs(F.col("prediction") - F.col("reference")))).alias("value"), F.count("*").alias("examples")).select(F.lit("run").alias("run_id"), F.lit(name).alias("control"), F.lit("agreement").alias("metric"), "value", "examples")
        out = m if out is None else out.unionByName(m)
    g = E.grounding(out)
    return out.select("control", "metric", F.round("value", 6).alias("value"), "examples").crossJoin(g.select(F.round("gain", 6).alias("gain"), F.round("contribution", 6).alias("contribution")))  # one row


@query("occlusion_suite")
def occlusion_suite(spark, d):
    c = view(spark, d, "cells")
    full = generate(c, _energy).withColumnRenamed("prediction", "reference")
    out = full.agg(F.lit(1.0).alias("value")).select(F.lit("baseline").alias("variant"), F.lit("agreement").alias("metric"), "value")
    for name, channels, t0, t1 in (("channels", [0, 3], None, None), ("time", None, 2, 5)):
        v = spark.createDataFrame([(name, channels, t0, t1)], "variant string, channels array<int>, t0 int, t1 int")
        p = generate(G.occlude(c, v), _energy).join(full, "vec_id").agg(F.avg(F.exp(-F.abs(F.col("prediction") - F.col("reference")))).alias("value"))
        out = out.unionByName(p.select(F.lit(name).alias("variant"), F.lit("agreement").alias("metric"), "value"))
    return E.occlusion_drop(out).select("variant", "metric", F.round("drop", 6).alias("drop"), F.round("mean_drop", 6).alias("mean_drop"))
