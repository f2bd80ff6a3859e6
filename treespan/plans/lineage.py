"""Cutting the lineage of loops, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most a few longs and doubles that may be broadcast: some tens of MB.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where a local master has none, a temporary folder of its one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/treespan-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A new place in the shared folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def configured(spark: SparkSession, **values: str) -> Iterator[None]:
    """Inside, settings of SETTINGS have these values."""
    before = {SETTINGS[k]: spark.conf.get(SETTINGS[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(SETTINGS[k], v)
    try:
        yield
    finally:
        for name, v in before.items():
            spark.conf.unset(name) if v is None else spark.conf.set(name, v)


#: Settings that are changed for single actions: whether what one shuffles is deleted when it ends, not when the driver's
#: garbage is next collected; and whether shuffles keep as many partitions as there are cores, however small.
SETTINGS = {
    "freed": "spark.sql.classic.shuffleDependency.fileCleanup.enabled",
    "parallel": "spark.sql.adaptive.coalescePartitions.parallelismFirst",
}


def materialize(df: DataFrame, few_files: bool = False) -> DataFrame:
    """Writes `df` once to the shared folder and returns what was written; it outlives lost executors.

    With `few_files`, shuffle partitions are merged up to the advisory size: for tables that are small or cheap to make.
    """
    path = new_path(df.sparkSession)
    more = {"parallel": "false"} if few_files else {}
    with configured(df.sparkSession, freed="true", **more):
        df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` returned and that nothing still to be run reads."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has few enough rows, else as it is for a shuffled join."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
