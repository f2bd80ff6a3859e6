"""Text, CSV and VTK files of bodies, cells and reports, written and read by all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.operators.partition import numbered
from treespan.plans.lineage import materialize


def write_values(df: DataFrame, order: str, columns: list[str], path: str) -> None:
    """One value a line, the columns of a row after each other, rows in order through the files' names."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order)
    rows.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("value")).write.mode("overwrite").text(path)


def read_values(spark: SparkSession, path: str, columns: list[str], skip: int = 0) -> DataFrame:
    """Rows of so many values as there are columns, with their number as body_id, after `skip` values."""
    lines = spark.read.text(path).select(F.col("value").cast("double").alias("v"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    every = numbered(materialize(lines), ["f", "b", "n"], "at").where(F.col("at") >= skip)
    width = len(columns)
    at = F.col("at") - skip
    grouped = every.select(F.floor(at / width).alias("body_id"), (at % width).alias("k"), "v").groupBy("body_id")
    return grouped.agg(*(F.max(F.when(F.col("k") == i, F.col("v"))).alias(c) for i, c in enumerate(columns)))


def dump_xyz(df: DataFrame, path: str, append: bool = False) -> None:
    """Lines of coordinates in scientific notation, with all digits: what is read back is what was written."""
    df.select(F.format_string("%.16e %.16e %.16e", "x", "y", "z").alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_rank_csv(df: DataFrame, path: str, rank: str = "Rank") -> None:
    """Rows with the number of the partition that they are in; reports are small, so in one file."""
    df.withColumn(rank, F.spark_partition_id()).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def vtk_lines(df: DataFrame) -> DataFrame:
    """(part, n, value): points as lines of a legacy VTK file, to be put together in order of part and n."""
    n = df.count()
    head = ["# vtk DataFile Version 3.0", "bodies", "ASCII", "DATASET POLYDATA", f"POINTS {n} double"]
    top = df.sparkSession.createDataFrame([(0, i, h) for i, h in enumerate(head)], "part int, n long, value string")
    return top.union(numbered(df, ["body_id"], "n").select(F.lit(1), "n", F.concat_ws(" ", *(F.col(a).cast("string") for a in "xyz"))))


def write_vtk(df: DataFrame, path: str) -> None:
    """A legacy VTK file of points: its parts, one after the other by name, are the file."""
    lines = vtk_lines(df)
    lines.repartitionByRange("part", "n").sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)
