"""Queries over timestamped windows: overlaps, islands, coverage, assembly, unit splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import intervals as I
from evidara.operators import splits as S
from evidara.plans.views import view
from evidara.queries.registry import query


def windows(spark, d):
    return view(spark, d, "windows")


_PAIRS = """SELECT l.recording_id, l.event_id AS left_id, r.event_id AS right_id FROM windows l JOIN windows r ON l.recording_id = r.recording_id
 AND (l.start_s, l.event_id) < (r.start_s, r.event_id) AND l.start_s < r.end_s AND r.start_s < l.end_s AND l.split <> r.split"""
_REACH = "reach AS (SELECT *, max(end_s) OVER (PARTITION BY recording_id ORDER BY start_s, end_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows)"
_ISLANDS = f"{_REACH}, isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_s, end_s, event_id) AS island FROM reach)"
_COVER = f"""{_REACH}, cov AS (SELECT recording_id, sum(greatest(0, end_s - greatest(start_s, coalesce(reach, start_s)))) AS union_s,
  sum(CASE WHEN start_s <= reach THEN least(reach, end_s) - start_s ELSE 0 END) AS overlap_s, count(*) FILTER (start_s > reach) AS gaps,
  coalesce(sum(start_s - reach) FILTER (start_s > reach), 0) AS gap_s, count(*) AS windows FROM reach GROUP BY recording_id)"""


@query("interval_overlap_pairs", ("windows",), _PAIRS)
def interval_overlap_pairs(spark, d):
    return I.overlap_pairs(windows(spark, d)).where("left_split <> right_split").select("recording_id", "left_id", "right_id")


@query("overlap_islands", ("windows",), f"WITH {_ISLANDS} SELECT event_id, island::BIGINT AS island FROM isl")
def overlap_islands(spark, d):
    return I.islands(windows(spark, d)).select("event_id", "island")


@query("coverage_gaps", ("windows",), f"WITH {_COVER} SELECT recording_id, round(union_s, 3) AS union_s, round(overlap_s, 3) AS overlap_s, gaps, round(gap_s, 3) AS gap_s, windows FROM cov")
def coverage_gaps(spark, d):
    c = I.coverage(windows(spark, d))
    return c.select("recording_id", *[F.round(x, 3).alias(x) for x in ("union_s", "overlap_s", "gap_s")], "gaps", "windows")


@query("coverage_gap_list", ("windows",), f"WITH {_REACH} SELECT recording_id, round(reach, 3) AS gap_start_s, round(start_s, 3) AS gap_end_s FROM reach WHERE start_s > reach")
def coverage_gap_list(spark, d):
    return I.gaps(windows(spark, d)).select("recording_id", F.round("gap_start_s", 3).alias("gap_start_s"), F.round("gap_end_s", 3).alias("gap_end_s"))


@query("assemble_drop_earlier", ("windows",), "SELECT event_id FROM (SELECT event_id, end_s, lead(start_s) OVER (PARTITION BY recording_id ORDER BY start_s, end_s, event_id) AS nxt FROM windows) WHERE nxt IS NULL OR nxt >= end_s")
def assemble_drop_earlier(spark, d):
    return I.drop_earlier(windows(spark, d)).select("event_id")


@query(
    "assemble_drop_later",
    ("windows",),
    """WITH RECURSIVE o AS (SELECT recording_id, event_id, start_s, end_s, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, end_s, event_id) AS i FROM windows),
    f AS (SELECT recording_id, i, event_id, true AS kept, end_s AS reach FROM o WHERE i = 1
      UNION ALL SELECT o.recording_id, o.i, o.event_id, o.start_s >= f.reach, CASE WHEN o.start_s >= f.reach THEN o.end_s ELSE f.reach END FROM f JOIN o ON o.recording_id = f.recording_id AND o.i = f.i + 1)
    SELECT event_id FROM f WHERE kept""",
)
def assemble_drop_later(spark, d):
    return I.drop_later(windows(spark, d)).select("event_id")


@query(
    "assemble_concatenate",
    ("windows",),
    f"WITH {_COVER}, t AS (SELECT recording_id, string_agg(prediction_text, ' ' ORDER BY start_s, end_s, event_id) AS text, min(start_s) AS a, max(end_s) AS z FROM windows GROUP BY recording_id) SELECT recording_id, md5(text) AS text, round(a, 3) AS start_s, round(z, 3) AS end_s, round(union_s, 3) AS union_s, gaps FROM t JOIN cov USING (recording_id)",
)
def assemble_concatenate(spark, d):
    c = I.concatenated(windows(spark, d))
    return c.select("recording_id", F.md5("text").alias("text"), *[F.round(x, 3).alias(x) for x in ("start_s", "end_s", "union_s")], "gaps")


@query(
    "timing_summary",
    ("windows",),
    f"""WITH {_COVER}, t AS (SELECT recording_id, CASE WHEN count(inference_duration_s) = count(*) THEN sum(inference_duration_s) END AS c, avg(emitted_at_s - end_s) AS m, max(emitted_at_s - end_s) AS x FROM windows GROUP BY recording_id)
    SELECT recording_id, round(c, 5) AS compute_s, round(c / union_s, 5) AS real_time_factor, round(m, 4) AS latency_mean_s, round(x, 4) AS latency_max_s FROM t JOIN cov USING (recording_id)""",
)
def timing_summary(spark, d):
    t = I.timing(windows(spark, d))
    return t.select("recording_id", F.round("compute_s", 5).alias("compute_s"), F.round("real_time_factor", 5).alias("real_time_factor"), F.round("latency_mean_s", 4).alias("latency_mean_s"), F.round("latency_max_s", 4).alias("latency_max_s"))


def _unit_sql(key: str) -> str:
    return f"""{_ISLANDS}, head AS (SELECT *, min(event_id) OVER (PARTITION BY recording_id, island) AS h FROM isl),
    edge AS (SELECT DISTINCT h, min(h) OVER (PARTITION BY {key}) AS l FROM head), sym AS (SELECT h AS a, l AS b FROM edge UNION SELECT l, h FROM edge),
    cc(n, c) AS (SELECT DISTINCT h, h FROM head UNION SELECT sym.b, cc.c FROM cc JOIN sym ON sym.a = cc.n WHERE cc.c < sym.b),
    comp AS (SELECT n, min(c) AS c FROM cc GROUP BY n), units AS (SELECT event_id, c AS unit FROM head JOIN comp ON comp.n = head.h)"""


_ISLAND_UNITS = f"{_ISLANDS}, units AS (SELECT event_id, min(event_id) OVER (PARTITION BY recording_id, island) AS unit FROM isl)"
_ASSIGN = """r AS (SELECT unit, row_number() OVER (ORDER BY sha256(concat_ws(':', '0', unit::VARCHAR)), unit) AS place FROM (SELECT DISTINCT unit FROM units)),
 n0 AS (SELECT count(*) AS n, greatest(1, round_even(count(*) * 0.2, 0)) AS t, CASE WHEN count(*) >= 3 THEN greatest(1, round_even(count(*) * 0.1, 0)) ELSE 0 END AS v FROM r),
 n1 AS (SELECT n, t, greatest(0, least(v, n - 1 - t)) AS v FROM n0), n2 AS (SELECT n, greatest(0, least(t, n - 1)) AS t, v FROM n1),
 plan AS (SELECT event_id, CASE WHEN place <= t THEN 'test' WHEN place <= t + v THEN 'validation' ELSE 'train' END AS split FROM units JOIN r USING (unit), n2)"""


def _with_recursive(units: str, rest: str) -> str:
    return f"WITH {units}{rest}"


@query("split_units", ("windows",), _with_recursive(_unit_sql("unit_text"), " SELECT event_id, unit FROM units"))
def split_units(spark, d):
    return S.units(windows(spark, d), "unit_text")


@query("split_random_legacy", ("windows",), _with_recursive(_ISLAND_UNITS, f", {_ASSIGN} SELECT event_id, split FROM plan"))
def split_random_legacy(spark, d):
    return S.assign(S.units(windows(spark, d)))


@query("split_unique_text", ("windows",), _with_recursive(_unit_sql("unit_text"), f", {_ASSIGN} SELECT event_id, split FROM plan"))
def split_unique_text(spark, d):
    return S.assign(S.units(windows(spark, d), "unit_text"))


@query("split_session_holdout", ("windows",), _with_recursive(_unit_sql("session_id"), f", {_ASSIGN} SELECT event_id, split FROM plan"))
def split_session_holdout(spark, d):
    return S.assign(S.units(windows(spark, d), "session_id"))


@query(
    "split_validate",
    ("windows",),
    """WITH w AS (SELECT recording_id, event_id, start_s, end_s, CASE WHEN event_id % 43 <> 0 THEN unit_text END AS unit_text,
      CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 47 = 0 THEN 'excluded' ELSE split END AS split, event_id % 41 = 0 AND event_id % 31 <> 0 AS twice FROM windows),
    a AS (SELECT * FROM w WHERE split <> 'excluded'),
    p AS (SELECT l.event_id FROM a l JOIN a r ON l.recording_id = r.recording_id AND (l.start_s, l.event_id) < (r.start_s, r.event_id) AND l.start_s < r.end_s AND r.start_s < l.end_s AND l.split <> r.split)
    SELECT 'duplicate_assignment' AS code, count(*) FILTER (twice) AS n FROM w UNION ALL SELECT 'unassigned', count(*) FILTER (split IS NULL) FROM w
    UNION ALL SELECT 'unknown_assignment', count(*) FILTER (event_id % 53 = 0) FROM w
    UNION ALL SELECT 'overlap_across_splits', (SELECT count(*) FROM p)
    UNION ALL SELECT 'missing_key', count(*) FILTER (unit_text IS NULL) FROM a
    UNION ALL SELECT 'key_across_splits', (SELECT count(*) FROM (SELECT unit_text FROM a WHERE unit_text IS NOT NULL GROUP BY unit_text HAVING count(DISTINCT split) > 1))
    UNION ALL SELECT 'held_out_not_test', count(*) FILTER (recording_id = 7 AND split <> 'test') FROM a
    UNION ALL SELECT 'other_subject_in_test', count(*) FILTER (recording_id <> 7 AND split = 'test') FROM a""",
)
def split_validate(spark, d):
    """The given splits as a plan with every kind of fault: ids left out, repeated, unknown and excluded, texts left out; held out is recording 7."""
    w = windows(spark, d)
    plan = w.select("event_id", F.when(F.col("event_id") % 47 == 0, "excluded").otherwise(F.col("split")).alias("split")).where("event_id % 31 <> 0")
    again = plan.where("event_id % 41 = 0")
    unknown = w.where("event_id % 53 = 0").select((-1 - F.col("event_id")).alias("event_id"), "split")
    w = w.withColumn("unit_text", F.when(F.col("event_id") % 43 != 0, F.col("unit_text")))
    return S.validate(w, plan.unionByName(again).unionByName(unknown), held_out="7")


@query("latency_summary", (), "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 4) AS elapsed_s, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def latency_summary(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return e.agg(q.alias("q"), F.sum("value").alias("s"), F.count("*").alias("n")).select("event_type", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"), F.round("s", 4).alias("elapsed_s"), F.round(F.col("n") / F.col("s"), 6).alias("per_second"))


@query("control_timing_only", (), "SELECT user_id, unnest(range(720)) AS frame, unnest(list_transform(range(720), lambda i: CASE WHEN list_contains(fs, i) THEN 1.0 ELSE 0.0 END))::DOUBLE AS value FROM (SELECT user_id, list(DISTINCT floor((epoch_us(ts) / 1e6 - 1704067200) / 3600)::BIGINT) AS fs FROM events GROUP BY user_id)")
def control_timing_only(spark, d):
    from evidara.operators.signals import timing_only

    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.floor((F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6 - 1704067200) / 3600).alias("frame"))
    return timing_only(e, "user_id", 720)
