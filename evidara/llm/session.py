"""Session settings that the Arrow stages of this subpackage rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: whole texts come in such batches, so this bounds a worker's memory.
ROWS_PER_BATCH = 512


def prepare(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator works on, so that other columns cannot clash with its own names."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast if it has ``most`` rows or fewer, else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() <= most else df
