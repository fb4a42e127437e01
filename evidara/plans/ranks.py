"""Places in an order over a whole table, without a task that sorts all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.plans.slices import sliced

#: Buckets of the first step: so many rows at most are ordered in one task to get their bases.
BUCKETS = 4096


def ranked(df: DataFrame, bucket: Column, order: list[Column | str], name: str = "place") -> DataFrame:
    """``df`` with ``name``, the place from 1 on in ``order``, where rows of a smaller ``bucket`` (0 to BUCKETS - 1) come first in it.

    Rows are counted by bucket, and places are counted inside each."""
    d = df.withColumn("bucket_", bucket.cast("int"))
    n = d.groupBy("bucket_").agg(F.count("*").alias("n_"))
    n = n.select("bucket_", F.coalesce(F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    d = d.withColumn("inside_", F.row_number().over(Window.partitionBy("bucket_").orderBy(*order)))
    d = d.join(F.broadcast(n), "bucket_")  # BUCKETS rows at most
    return d.withColumn(name, F.col("base_") + F.col("inside_")).drop("bucket_", "inside_", "base_")


def by_hash(df: DataFrame, hexadecimal: Column, *ties: str, name: str = "place") -> DataFrame:
    """Places in the order of a hash in hexadecimal."""
    return ranked(df.withColumn("hash_", hexadecimal), F.conv(F.substring("hash_", 1, 3), 16, 10), ["hash_", *ties], name).drop("hash_")


#: So many rows are ordered in one task.
FEW = 1 << 16


def by_value(df: DataFrame, column: str, name: str = "place") -> DataFrame:
    """Places in the order of a column of any kind; a table of more than FEW rows is cut into slices by range first."""
    if df.count() <= FEW:
        return df.withColumn(name, F.row_number().over(Window.orderBy(column)))
    d = sliced(df, [column])
    n = d.groupBy("slice").agg(F.count("*").alias("n_"))
    n = n.select("slice", F.coalesce(F.sum("n_").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy(column))
    return d.join(F.broadcast(n), "slice").withColumn(name, F.col("base_") + inside).drop("slice", "base_")  # a row for each slice


def by_number(df: DataFrame, column: str, name: str = "place") -> DataFrame:
    """Places in the order of a column of whole numbers, dealt to buckets of equal width between its extremes."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    width = max(1, -(-(high - low + 1) // BUCKETS))
    return ranked(df, F.floor((F.col(column) - low) / width), [column], name)


def lowest(df: DataFrame, hexadecimal: Column, n: DataFrame, name: str, *ties: str) -> DataFrame:
    """``df`` with ``name``, whether a row is one of the first ``n`` (a table of one number) in the order of a hash in hexadecimal.

    Buckets below the one in which the n-th row lies are whole; only the rows of that bucket are ordered."""
    d = df.withColumn("hash_", hexadecimal).withColumn("bucket_", F.conv(F.substring("hash_", 1, 3), 16, 10).cast("int"))
    k = d.groupBy("bucket_").agg(F.count("*").alias("n_"))  # BUCKETS rows at most
    w = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    k = k.select("bucket_", "n_", F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("base_")).crossJoin(F.broadcast(n.toDF("due_")))
    k = k.select("bucket_", F.when(F.col("base_") + F.col("n_") <= F.col("due_"), True).when(F.col("base_") >= F.col("due_"), False).alias("whole_"), (F.col("due_") - F.col("base_")).alias("left_"))
    d = d.join(F.broadcast(k), "bucket_")
    inside = d.where("whole_ is null").withColumn("place_", F.row_number().over(Window.partitionBy("bucket_").orderBy("hash_", *ties)))
    out = d.where("whole_ is not null").withColumn(name, F.col("whole_")).unionByName(inside.withColumn(name, F.col("place_") <= F.col("left_")).drop("place_"))
    return out.drop("hash_", "bucket_", "whole_", "left_")
