"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from evidara.llm.session import table
from evidara.plans.storage import staged

SHARDS, BUCKETS = 16, 1024


@F.pandas_udf(IntegerType())
def jump_shard(key: pd.Series, shards: pd.Series) -> pd.Series:
    """The shard of each 64-bit key, by the jumps of Lamping and Veach, for a whole batch at once."""
    k, n = key.to_numpy().astype(np.int64).view(np.uint64).copy(), shards.to_numpy().astype(np.int64)
    at, ahead = np.full(len(k), -1, dtype=np.int64), np.zeros(len(k), dtype=np.int64)
    while (go := ahead < n).any():
        at[go] = ahead[go]
        with np.errstate(over="ignore"):
            k[go] = k[go] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[go] = ((at[go] + 1) * (2.0**31 / ((k[go] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
    return pd.Series(at.astype(np.int32))


def stable_key(key: Column) -> Column:
    """60 bits of the MD5 of the key as text: the same on every machine and for every type of key; null has its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard) of every row.

    Null texts have no bytes (size 1, checksum 0); a null doc_id is one more key. Repeated
    rows get slots of their own. Slots count by two steps, hash buckets of a shard and
    places in a bucket, so no task orders a whole shard. An empty table gives an empty
    table; other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), stable_key(F.col("doc_id")).alias("key"))
    d = d.select("*", jump_shard("key", F.lit(shards)).alias("shard"), jump_shard("key", F.lit(shards + 1)).alias("grown_shard"))
    d = d.withColumn("bucket", (F.xxhash64("key") % BUCKETS).cast("int"))
    d = staged(d, "shards")  # no text any more: read twice below
    n = d.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("shard", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id", "size", "text_crc32")
    d = d.select("*", F.row_number().over(inside).alias("place")).join(n, ["shard", "bucket"])
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
