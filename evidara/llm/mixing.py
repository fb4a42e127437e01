"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Targets are clamped at ``cap`` times a source's size and the excess goes to the others in
proportion to weight. With targets ``min(cap_i, level * w_i)`` the level follows from prefix sums over the sources in the order
of cap_i / w_i, so no iteration is needed. A source with target r times its size takes every document floor(r) times,
and the first documents in a seeded hash order once more until the rest of the
target is met; the document on the edge gives its first words only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.quality import words
from evidara.llm.session import free_name, table
from evidara.plans.storage import staged

SEED, BUCKETS = "mix-1", 4096


def order_key(seed: str) -> Column:
    """A seeded 60-bit number of a row, from its doc_id and text."""
    parts = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.sha2(parts, 256), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size); weights repeat over sources in code point order, null last.

    Sources are aggregated first, so the windows here hold one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.select("*", F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).alias("w"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(every) * percent / 100).alias("total"),
        (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap).alias("capped"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open_w"),
    )
    # The level if all sources before this one are capped; this one is capped if its cap lies below it.
    level = (F.col("total") - F.col("capped")) / F.col("open_w")
    s = s.select("*", level.alias("level"), (F.col("source_size") * cap <= level * F.col("w")).alias("is_capped"))
    final = F.min(F.when(~F.col("is_capped"), F.struct(F.col("capped"), F.col("level")))).over(every)["level"]
    target = F.when(F.col("is_capped"), F.col("source_size") * cap).otherwise(final * F.col("w"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mixed(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, extra) for every row: ``copies`` whole repetitions and ``extra`` words of one more.

    Null texts have size 0 and are taken 0 times; null sources are one source, last in order. Repeated rows count each; an empty
    table gives an empty table; other columns are ignored."""
    d = docs.select(
        "doc_id",
        "source",
        F.size(words(F.col("text"))).cast("long").alias("size"),
        order_key(seed).alias("u"),
    )
    d = staged(d, "mix_sizes")  # read several times below, the texts once
    t = targets(d.select("source", "size"), **how)
    # Prefix sums per source in hash order, in two steps: over buckets of the hash, then inside each bucket.
    d = d.withColumn("bucket", F.shiftright("u", 60 - 12).cast("int"))
    of = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("of")
    d = d.select("*", of)
    sums = d.groupBy("of", "bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("of", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, ["of", "bucket"]).select("*", (F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("before"))
    d = d.join(t.select(of, "source_size", "target"), "of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.select("*", whole.alias("copies"))
    wanted = F.round(F.col("target")).cast("long") - F.col("copies") * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), wanted - F.col("before"))).cast("long")
    d = d.select("*", extra.alias("extra"))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"), "copies", "extra", "u")


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of ``text``, joined by spaces."""
    return F.array_join(F.slice(words(text), 1, n.cast("int")), " ")


def sample_mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents as rows: each one as often as it is taken, and on the edge its first words.

    Rows that are equal in doc_id, source and text share what they are taken, the first ones whole; rows of size 0 are taken never. Other columns are
    carried along, whatever their names."""
    seed = how.pop("seed", SEED)
    names = ("mix_id", "mix_source", "mix_key", "mix_size", "mix_copies", "mix_extra", "mix_rows", "mix_place", "mix_take")
    ident, source, key, size, copies, extra, rows, place, take = (free_name(docs, n) for n in names)
    m = mixed(docs, seed, **how).groupBy("doc_id", "source", "u", "size", "copies").agg(F.sum("extra").alias("extra"), F.count("*").alias("rows"))
    m = m.toDF(ident, source, key, size, copies, extra, rows)
    mine = order_key(seed)
    d = docs.withColumn(place, F.lit(1))
    if not m.where(F.col(rows) > 1).isEmpty():  # equal rows are numbered
        d = d.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", "source", mine).orderBy(F.lit(0))))
    d = d.join(m, d["doc_id"].eqNullSafe(m[ident]) & d["source"].eqNullSafe(m[source]) & (mine == m[key]))
    part = F.least(F.col(size), F.greatest(F.lit(0), F.col(extra) - (F.col(place) - 1) * F.col(size)))
    whole = F.array_repeat(size, F.col(copies).cast("int"))
    d = d.withColumn(take, F.explode(F.concat(whole, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))))
    text = F.when(F.col(take) >= F.col(size), F.col("text")).otherwise(first_words(F.col("text"), F.col(take)))
    cols = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text.alias("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length(text).cast("long").alias("n_chars")
    return d.where(F.col(size) > 0).select(*[cols[c] for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
c AS (SELECT *, sum(source_size) OVER () * 150 / 100 AS total, sum(w) OVER () AS all_w,
        coalesce(sum(source_size) OVER o, 0) * 2 AS capped, coalesce(sum(w) OVER o, 0) AS used_w FROM s
      WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped) / (all_w - used_w) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN source_size * 2 <= level * w THEN (source_size * 2)::DOUBLE
        ELSE (min(struct_pack(a := capped, b := level)) FILTER (source_size * 2 > level * w) OVER ()).b * w END AS target FROM l),
k AS (SELECT d.doc_id, d.source, d.size, ('0x' || substr(sha256('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(x.text, ''))), 1, 15))::BIGINT AS u
      FROM d JOIN documents x USING (doc_id)),
b AS (SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
j AS (SELECT b.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, round(target)::BIGINT - copies * source_size - before)))::BIGINT AS taken FROM j
"""
