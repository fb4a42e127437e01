"""Leakage-safe splits: units that must stay together, seeded assignment, and its proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators.components import connected_components
from evidara.operators.intervals import islands, overlap_pairs
from evidara.plans.ranks import by_hash, lowest
from evidara.plans.storage import staged


def units(windows: DataFrame, key: str | None = None) -> DataFrame:
    """(event_id, unit): islands of overlap, united further by equal ``key``; a unit is named by its smallest member.

    Components are those of the graph between islands and keys, islands standing for their members."""
    w = islands(windows)
    w = w.join(w.groupBy("recording_id", "island").agg(F.min("event_id").alias("head")), ["recording_id", "island"])
    if key is None:
        return w.select("event_id", F.col("head").alias("unit"))
    heads = w.select(F.col(key).alias("key"), "head").distinct()  # a key that very many windows have is counted, not gathered
    least = heads.where("key is not null").groupBy("key").agg(F.min("head").alias("lead"))
    edges = heads.join(least, "key").where("head <> lead").select("head", "lead").distinct()
    parts = connected_components(edges, "head", "lead").select(F.col("node").alias("head"), "component")
    return w.join(parts, "head", "left").select("event_id", F.coalesce("component", "head").alias("unit"))


def seeded_rank(df: DataFrame, column: str, seed: str) -> DataFrame:
    """Place of each row in the order of a seeded hash of ``column``, which does not depend on partitions."""
    return by_hash(df, _seeded(column, seed), column)


def _seeded(column: str, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(column).cast("string")), 256)


def assign(unit_of: DataFrame, seed: str = "0", validation: float = 0.1, test: float = 0.2) -> DataFrame:
    """(event_id, split): units in seeded order, the first to test, the next to validation, the rest to train.

    Counts are half-even rounded and shrink, validation first, until a unit is left for
    train."""
    u = unit_of.select("unit").distinct()
    n = u.agg(F.count("*").alias("n"))
    n = n.select("n", F.greatest(F.lit(1), F.bround(F.col("n") * test).cast("long")).alias("t"), F.when((F.col("n") >= 3) & F.lit(validation > 0), F.greatest(F.lit(1), F.bround(F.col("n") * validation).cast("long"))).otherwise(0).alias("v"))
    n = n.select("n", "t", F.greatest(F.lit(0), F.least("v", F.col("n") - 1 - F.col("t"))).alias("v")).select("n", F.greatest(F.lit(0), F.least("t", F.col("n") - 1)).alias("t"), "v")
    ranked = seeded_rank(u, "unit", seed).crossJoin(F.broadcast(n))  # one row of counts
    split = F.when(F.col("place") <= F.col("t"), "test").when(F.col("place") <= F.col("t") + F.col("v"), "validation").otherwise("train")
    return unit_of.join(ranked.select("unit", split.alias("split")), "unit").select("event_id", "split")


def leave_one_out(samples: DataFrame, held_out: str, unique_text: bool = False, seed: str = "0", validation: float = 0.1) -> DataFrame:
    """(sample_id, split): the held-out subject is test, other subjects' texts go to validation and train by text units.

    With ``unique_text`` samples of others whose text occurs for the held-out subject are 'excluded'."""
    samples = staged(samples.select("sample_id", "subject_id", "fingerprint"), "fingerprints")  # texts are read once
    mine = F.col("subject_id") == held_out
    test = samples.where(mine).select("sample_id", F.lit("test").alias("split"))
    rest = samples.where(~mine)
    seen = samples.where(mine).select("fingerprint").distinct()
    out = test
    if unique_text:
        rest = rest.join(seen.withColumn("seen_", F.lit(True)), "fingerprint", "left")
        out = out.unionByName(rest.where("seen_").select("sample_id", F.lit("excluded").alias("split")))
        rest = rest.where("seen_ is null").drop("seen_")
    u = rest.select("fingerprint").distinct()
    n = u.agg(F.count("*").alias("n")).select(F.least(F.greatest(F.lit(1), F.bround(F.col("n") * validation).cast("long")), F.col("n") - 1).alias("v"))
    chosen = lowest(u, _seeded("fingerprint", seed), n, "chosen", "fingerprint")
    split = F.when(F.col("chosen"), "validation").otherwise("train")
    return out.unionByName(rest.join(chosen.select("fingerprint", split.alias("split")), "fingerprint").select("sample_id", "split"))


def materialize(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """Samples with the plan's split; excluded rows go."""
    return samples.drop("split").join(plan.where("split <> 'excluded'"), "sample_id")


def plan_coverage(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """Ids that only one of samples and plan has."""
    s, p = samples.select("sample_id").distinct(), plan.select("sample_id").distinct()
    return s.join(p, "sample_id", "left_anti").withColumn("code", F.lit("missing")).unionByName(p.join(s, "sample_id", "left_anti").withColumn("code", F.lit("unknown")))


#: The rules of ``validate``; each protocol asks for the first four and some of the others.
CODES = ("duplicate_assignment", "unassigned", "unknown_assignment", "overlap_across_splits", "missing_key", "key_across_splits", "held_out_not_test", "other_subject_in_test")


def validate(windows: DataFrame, plan: DataFrame, key: str | None = "unit_text", held_out: str | None = None, subject: str = "recording_id") -> DataFrame:
    """(code, n) of every rule of a plan (event_id, split), 0 where it holds.

    Ids that the plan repeats, lacks or does not know, and pairs of overlapping windows in two splits. With ``key`` (the text, or the session of a session
    protocol) also windows without one and keys in two splits; with ``held_out`` windows of that subject outside test, and windows of others in it.
    Excluded windows belong to no split."""
    one = plan.groupBy("event_id").agg(F.min("split").alias("split"))  # an id that the plan repeats is judged once
    used = dict.fromkeys(["event_id", "recording_id", "start_s", "end_s", *([key] if key else []), *([subject] if held_out is not None else [])])
    w = staged(windows.select(*used).join(one, "event_id", "left"), "assigned")  # read by most rules
    active = w.where("split <> 'excluded'")
    code = lambda df, name: df.select(F.lit(name).alias("code"))
    found = [
        code(plan.groupBy("event_id").count().where("count > 1"), "duplicate_assignment"),
        code(w.where("split is null"), "unassigned"),
        code(one.join(windows, "event_id", "left_anti"), "unknown_assignment"),
        code(overlap_pairs(active).where("left_split <> right_split"), "overlap_across_splits"),
    ]
    if key:
        found.append(code(active.where(F.col(key).isNull()), "missing_key"))
        found.append(code(active.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("k")).where("k > 1"), "key_across_splits"))
    if held_out is not None:
        mine = F.col(subject).cast("string") == held_out
        found.append(code(active.where(mine & (F.col("split") != "test")), "held_out_not_test"))
        found.append(code(active.where(~mine & (F.col("split") == "test")), "other_subject_in_test"))
    every = windows.sparkSession.createDataFrame([(c,) for c in CODES], "code string")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return every.join(out.groupBy("code").agg(F.count("*").alias("n")), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))
