"""Slices of an ordered table: contiguous ranges of bounded size, so that no recording, user or key is one task.

Spark's range partitioner cuts at quantiles of a sample, so slices are even however the values cluster. A slice's number is
its partition; as a plan that is run twice may cut elsewhere, the sliced table is written once and read from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.plans.storage import staged

#: Rows of a slice, about.
SLICE_ROWS = 1 << 16


def tasks(df: DataFrame, rows: int | None = None) -> int:
    """So many tasks that each has a slice's rows, about. Told to a shuffle, as one that is told none is put together by compressed bytes, which say little of the memory of a sort."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or SLICE_ROWS)))


def sliced(df: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """``df`` with ``slice``: all rows of a slice come before those of the next in ``order``. Rows that are equal in it share one."""
    return staged(df.repartitionByRange(tasks(df, rows), *order).withColumn("slice", F.spark_partition_id()), "slices")


def carried(d: DataFrame, key: str, *, before: dict | None = None, after: dict | None = None) -> DataFrame:
    """``d`` with figures of the other slices of its key: ``before`` and ``after`` map a new column to (aggregate of a slice, how the aggregates of all slices before,
    or of the next one, are put together). A slice has one row in the fold; only a key that lies in several has figures."""
    made = {**(before or {}), **(after or {})}
    s = d.groupBy(key, "slice").agg(*[a.alias(c) for c, (a, _) in made.items()])
    w = Window.partitionBy(key).orderBy("slice")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(key, "slice", *[f(F.col(c)).over(past).alias(c) for c, (_, f) in (before or {}).items()], *[f(F.col(c)).over(w).alias(c) for c, (_, f) in (after or {}).items()])
    s = s.where(F.coalesce(*[F.col(c).isNotNull() for c in made]) if len(made) == 1 else F.greatest(*[F.col(c).isNotNull() for c in made]))
    return d.join(s, [key, "slice"], "left")
