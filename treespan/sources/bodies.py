"""Bodies from tables: a long body_id, double coordinates x, y(, z) and a double src."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BodySpec:
    """Which columns of a table are a body's id, coordinates and strength."""

    id: str | Column
    coordinates: tuple[str | Column, ...]
    src: str | Column

    def of(self, df: DataFrame) -> DataFrame:
        col = lambda c: F.col(c) if isinstance(c, str) else c
        axes = zip(("x", "y", "z"), self.coordinates)
        return df.select(col(self.id).cast("long").alias("body_id"), *(col(c).cast("double").alias(a) for a, c in axes), col(self.src).cast("double").alias("src"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str, src: Column) -> DataFrame:
    return BodySpec("vec_id", tuple(F.col("embedding")[i] for i in range(3)), src).of(table(spark, sf_dir, "embeddings"))


def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' first three components, of positive strength."""
    return _vectors(spark, sf_dir, (F.col("label") + 1) / 10.0)


def b3c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with strengths of both signs."""
    return _vectors(spark, sf_dir, F.col("label") - 4.5)


def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the plane of user and value."""
    ev = table(spark, sf_dir, "events")
    most = ev.agg(F.max("user_id").cast("double").alias("m")).first().m
    return BodySpec("event_id", (F.col("user_id") / most, F.col("value") / 600.0), F.lit(1.0)).of(ev)


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by quantity, discount and price; they have no unique id."""
    return BodySpec(F.lit(0), (F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_extendedprice") / 105000), F.col("l_tax") + 0.01).of(table(spark, sf_dir, "lineitem")).drop("body_id")


def coincident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by quantity, discount and tax: many share a place."""
    return BodySpec(F.lit(0), (F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12), F.lit(1.0)).of(table(spark, sf_dir, "lineitem")).drop("body_id")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BodySpec("p_partkey", (F.col("p_size") / 50, F.col("p_retailprice") / 2000, F.pmod("p_partkey", F.lit(1000)) / 1000), F.lit(1.0)).of(table(spark, sf_dir, "part"))


#: The same views as SQL, to stand after WITH.
SQL = {
    "b3": "b AS (SELECT vec_id AS body_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, (label + 1) / 10.0::DOUBLE AS src FROM embeddings)",
    "b3c": "b AS (SELECT vec_id AS body_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label - 4.5::DOUBLE AS src FROM embeddings)",
    "b2": "b AS (SELECT event_id AS body_id, user_id / (SELECT MAX(user_id)::DOUBLE FROM events) AS x, value / 600.0::DOUBLE AS y, 1.0::DOUBLE AS src FROM events)",
    "lineitems": "b AS (SELECT l_quantity / 50::DOUBLE AS x, l_discount * 10::DOUBLE AS y, l_extendedprice / 105000::DOUBLE AS z, l_tax + 0.01::DOUBLE AS src FROM lineitem)",
    "coincident": "b AS (SELECT l_quantity / 50::DOUBLE AS x, l_discount * 10::DOUBLE AS y, l_tax * 12::DOUBLE AS z, 1.0::DOUBLE AS src FROM lineitem)",
    "parts": "b AS (SELECT p_partkey AS body_id, p_size / 50::DOUBLE AS x, p_retailprice / 2000::DOUBLE AS y, (p_partkey % 1000) / 1000::DOUBLE AS z, 1.0::DOUBLE AS src FROM part)",
}
