"""Views over the given tables in the shape the operators expect, in one SQL template for two engines.

``{...}`` parts differ between Spark and DuckDB; everything else is the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.plans.folding import duck_sql, spark_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: White space as Python's str.split() sees it, for Java and RE2.
SPACES = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"

SPARK = {
    "int_hash": lambda x: f"cast(conv(substring(sha2({x}, 256), 1, 8), 16, 10) as bigint)",
    "seconds": lambda x: f"(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {x}) / 1e6)",
    "div": lambda a, b: f"(({a}) div ({b}))",
    "str": lambda x: f"cast({x} as string)",
    "norm": lambda x: f"trim(regexp_replace({spark_sql(x)}, r'{SPACES}', ' '))",
    "sha": lambda x: f"sha2({x}, 256)",
    "words": lambda x: f"filter(split({x}, r'[\\x20\\x09-\\x0D]+'), w -> w <> '')",
    "drop_fifth": lambda ws, k: f"array_join(filter(transform({ws}, (w, i) -> if((i + {k}) % 5 = 0, '', w)), w -> w <> ''), ' ')",
    "reversed": lambda ws: f"array_join(reverse({ws}), ' ')",
    "n": lambda ws: f"size({ws})",
    "cell": lambda x, c, t: f"{x}[{c} * 8 + {t}]",
    "numbers": lambda n: f"explode(sequence(0, {n} - 1))",
    "mod": lambda a, b: f"pmod({a}, {b})",
    "double": lambda x: f"cast({x} as double)",
}
DUCK = SPARK | {
    "int_hash": lambda x: f"('0x' || substr(sha256({x}), 1, 8))::BIGINT",
    "seconds": lambda x: f"(epoch_us({x}) / 1e6)",
    "div": lambda a, b: f"(({a}) // ({b}))",
    "str": lambda x: f"({x})::VARCHAR",
    "norm": lambda x: f"trim(regexp_replace({duck_sql(x)}, '{SPACES}', ' ', 'g'))",
    "sha": lambda x: f"sha256({x})",
    "words": lambda x: f"list_filter(string_split_regex({x}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')",
    "drop_fifth": lambda ws, k: f"array_to_string(list_filter({ws}, lambda w, i: (i - 1 + {k}) % 5 <> 0), ' ')",
    "reversed": lambda ws: f"array_to_string(list_reverse({ws}), ' ')",
    "n": lambda ws: f"len({ws})",
    "cell": lambda x, c, t: f"{x}[{c} * 8 + {t} + 1]",
    "numbers": lambda n: f"unnest(range({n}))",
    "mod": lambda a, b: f"((({a}) % ({b})) + ({b})) % ({b})",
    "double": lambda x: f"({x})::DOUBLE",
}

#: name -> (views it builds on, template taking the engine's functions)
VIEWS = {
    "samples": ((), lambda d: f"""SELECT doc_id AS idx, {d['str']('doc_id')} AS sample_id, 'docs' AS dataset_id, source AS subject_id,
        concat(source, '-', lang) AS session_id, text, lang, concat(source, ':', {d['str'](d['div']('doc_id', '25'))}) AS group_id,
        CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 10 <= 6 THEN 'train' WHEN doc_id % 10 = 7 THEN 'validation' ELSE 'test' END AS split,
        {d['sha'](d['norm']('text'))} AS fingerprint FROM documents"""),
    "windows": ((), lambda d: f"""SELECT event_id, user_id AS recording_id, {d['seconds']('ts')} - 1704067200 AS start_s,
        {d['seconds']('ts')} - 1704067200 + value * 300 AS end_s, event_type AS prediction_text, value / 1000 AS inference_duration_s,
        {d['seconds']('ts')} - 1704067200 + value * 300 + event_id % 7 AS emitted_at_s,
        CASE WHEN event_id % 10 <= 6 THEN 'train' WHEN event_id % 10 = 7 THEN 'validation' ELSE 'test' END AS split,
        CASE WHEN event_id % 4 < 2 THEN concat('k', {d['str'](d['div']('event_id', '2'))}) ELSE concat('x', {d['str']('event_id')}) END AS unit_text,
        concat({d['str']('user_id')}, '-w', {d['str'](f"cast(floor(({d['seconds']('ts')} - 1704067200) / 604800) as bigint)")}) AS session_id FROM events"""),
    "exposure": (("samples",), lambda d: """SELECT 'sample' AS kind, sample_id AS value FROM samples WHERE idx % 101 = 0
        UNION SELECT 'text', fingerprint FROM samples WHERE idx % 37 = 0"""),
    "turns": ((), lambda d: f"""SELECT concat('run-', {d['str']('conv_id % 3')}) AS run_id, concat({d['str']('conv_id')}, '-', {d['str']('turn')}) AS sample_id,
        conv_id * 1000 + turn AS k, text AS reference_text, {d['words']('text')} AS ws FROM conversations"""),
    "predictions": (("turns",), lambda d: f"""SELECT run_id, sample_id, 'full' AS control, {d['drop_fifth']('ws', 'k')} AS prediction_text, reference_text FROM turns
        UNION ALL SELECT run_id, sample_id, 'shuffled', coalesce(lead(reference_text) OVER (PARTITION BY run_id ORDER BY {d['sha']('sample_id')}),
            first_value(reference_text) OVER (PARTITION BY run_id ORDER BY {d['sha']('sample_id')})), reference_text FROM turns
        UNION ALL SELECT run_id, sample_id, 'noise', {d['reversed']('ws')}, reference_text FROM turns
        UNION ALL SELECT run_id, sample_id, 'zero', 'the', reference_text FROM turns
        UNION ALL SELECT run_id, sample_id, 'length', trim(repeat('x ', cast({d['n']('ws')} as int))), reference_text FROM turns"""),
    "vectors": ((), lambda d: "SELECT vec_id, label, embedding AS v FROM embeddings"),
    "cells": ((), lambda d: f"""SELECT vec_id, label, c AS channel, t, {d['double'](d['cell']('embedding', 'c', 't'))} AS value,
        NOT (c = vec_id % 8 AND vec_id % 5 = 0) AS channel_ok, t < 8 - vec_id % 3 AS time_ok,
        CASE vec_id % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, {d['numbers']('8')} AS t FROM (SELECT *, {d['numbers']('8')} AS c FROM embeddings) q) r"""),
    "confidences": ((), lambda d: f"""SELECT l.doc_id, lang AS run_id, ({d['int_hash'](d['str']('l.doc_id'))} % 1001) / 1000.0e0 AS confidence, quality AS correct
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*_needed(VIEWS[n][0]), n) if x not in out]
    return out


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of predictions without a task that orders a run: texts are ordered in buckets of their hashes, and the last of a bucket is followed by the first of the next.

    Turns are dealt to a told number of tasks, as what is done with them costs more than their size tells."""
    turns = view(spark, sf_dir, "turns").withColumn("run_", F.coalesce("run_id", F.lit(""))).withColumn("hash_", F.sha2("sample_id", 256))
    turns = turns.withColumn("bucket_", F.coalesce(F.conv(F.substring("hash_", 1, 3), 16, 10).cast("int"), F.lit(-1)))  # 4,097 at most
    turns = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_", "bucket_")
    keys = ["run_", "bucket_"]
    heads = turns.groupBy(*keys).agg(F.min(F.struct("hash_", "sample_id", F.col("reference_text").alias("text"))).alias("head_")).select(*keys, F.col("head_.text").alias("text_"))
    run = Window.partitionBy("run_").orderBy("bucket_")
    places = heads.select(*keys).withColumn("next_", F.lead("bucket_").over(run)).withColumn("first_", F.min("bucket_").over(Window.partitionBy("run_")))  # numbers only
    text = lambda column, name: heads.select("run_", F.col("bucket_").alias(column), F.col("text_").alias(name))
    after = places.join(text("next_", "after_"), ["run_", "next_"], "left").join(text("first_", "begin_"), ["run_", "first_"], "left").select(*keys, "after_", "begin_")
    inside = Window.partitionBy(*keys).orderBy("hash_")
    moved = turns.withColumn("following_", F.lead(F.struct("reference_text")).over(inside)).join(after, keys, "left")
    moved = moved.withColumn("shuffled_", F.coalesce(F.when(F.col("following_").isNotNull(), F.col("following_.reference_text")).otherwise(F.col("after_")), F.col("begin_")))

    def part(df: DataFrame, control: str, text: Column) -> DataFrame:
        return df.select("run_id", "sample_id", F.lit(control).alias("control"), text.alias("prediction_text"), "reference_text")

    out = part(turns, "full", F.expr(SPARK["drop_fifth"]("ws", "k"))).unionByName(part(moved, "shuffled", F.col("shuffled_"))).unionByName(part(turns, "noise", F.expr(SPARK["reversed"]("ws"))))
    return out.unionByName(part(turns, "zero", F.lit("the"))).unionByName(part(turns, "length", F.expr("trim(repeat('x ', size(ws)))")))


#: Views whose template would order very many rows in one task, as Spark operators with the same rows.
SPREAD = {"predictions": _predictions}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet files in ``sf_dir``."""
    return SPREAD[name](spark, sf_dir) if name in SPREAD else templated(spark, sf_dir, name)


def templated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The template of the view, as it is."""
    text = VIEWS[name][1](SPARK)
    for below in VIEWS[name][0]:
        text = text.replace(f"FROM {below}", f"FROM {{{below}}}")
    frames = {below: view(spark, sf_dir, below) for below in VIEWS[name][0]}
    for t in TABLES:
        if f"FROM {t}" in text or f"JOIN {t}" in text:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(text.replace("{85}", "{{85}}").replace("p{Z}", "p{{Z}}"), **frames)


def duck(names: tuple[str, ...], select: str) -> str:
    """``select`` for DuckDB, after the views it needs."""
    parts = [f"{n} AS ({VIEWS[n][1](DUCK)})" for n in _needed(names)]
    body = select.strip().replace("WITH RECURSIVE ", "WITH ", 1) if select.strip().startswith("WITH RECURSIVE ") else select.strip()
    if not parts:
        return select.strip()
    return "WITH RECURSIVE " + ",\n".join(parts) + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
