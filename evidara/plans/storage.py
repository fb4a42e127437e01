"""Where intermediate tables live: always the shared checkpoint folder, never a local one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; else the context's; only a local session (tests) without any gets a fresh one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_evidara_shared", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-evidara-", dir="/tmp")
        spark._evidara_shared = known
    return known


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() needs a directory on the context; the session setting names it."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor, as the files are
    in storage that all executors share."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/evidara-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
