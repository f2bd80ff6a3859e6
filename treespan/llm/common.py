"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.plans.lineage import discard, materialize, shared_dir

__all__ = ["batches_of", "discard", "materialize", "shared_dir", "table", "with_row_key"]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, actions send at most so many rows at once to Python workers: a batch holds whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once, with a long that differs between rows, equal ids and repeated rows included.

    As the keys are written they are the same wherever they are read, whatever the input's plan or the executors are.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))
