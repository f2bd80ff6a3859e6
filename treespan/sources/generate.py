"""Generated bodies: lattices and random distributions by a 48-bit linear congruential generator.

The generator's n-th number is found by a jump, so any task can make any stretch, and a distribution is the same
however many tasks make it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.operators.partition import numbered
from treespan.operators.tree import AXES

#: Multiplier, increment and modulus of the generator, and what follows the seed.
MULTIPLIER, INCREMENT, MASK, TAIL = 0x5DEECE66D, 0xB, (1 << 48) - 1, 0x330E


def _jump(n: int) -> tuple[int, int]:
    """Multiplier and increment of n steps."""
    a, c, out_a, out_c = MULTIPLIER, INCREMENT, 1, 0
    while n:
        if n & 1:
            out_a, out_c = out_a * a & MASK, (out_c * a + c) & MASK
        c = (c * a + c) & MASK
        a = a * a & MASK
        n >>= 1
    return out_a, out_c


def uniform(seed: int, first: int, n: int) -> np.ndarray:
    """The numbers `first` to first + n - 1, from 0 on, in [0, 1)."""
    a, c = _jump(first + 1)
    states = np.array([(a * ((seed << 16) | TAIL) + c) & MASK], np.uint64)
    while len(states) < n:
        a, c = _jump(len(states))
        states = np.concatenate([states, (np.uint64(a) * states + np.uint64(c)) & np.uint64(MASK)])
    return states[:n] / float(1 << 48)


def draws(spark: SparkSession, n: int, each: int, seed: int = 0) -> DataFrame:
    """(id, u0, u1, ..): `each` consecutive numbers for each of n ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids = b.column(0).to_numpy()
            if len(ids):
                u = uniform(seed, int(ids[0]) * each, (int(ids[-1]) - int(ids[0]) + 1) * each).reshape(-1, each)[ids - ids[0]]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(u[:, k]) for k in range(each))], names=["id", *(f"u{k}" for k in range(each))])

    return spark.range(n).mapInArrow(run, "id long, " + ", ".join(f"u{k} double" for k in range(each)))


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """The cube of about n points on [-1, 1]^3; x is slowest. A single point lies at -1."""
    side = max(round(n ** (1 / 3)), 1)
    at = lambda k: (F.floor(F.col("id") / side**k) % side / max(side - 1, 1)) * 2 - 1
    return spark.range(side**3).select(F.col("id").alias("body_id"), *(at(k).cast("double").alias(a) for a, k in zip(AXES, (2, 1, 0))))


def cube(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return draws(spark, n, 3, seed).select(F.col("id").alias("body_id"), *((F.col(f"u{k}") * 2 * pi - pi).alias(a) for k, a in enumerate(AXES)))


def sphere(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Points of a cube moved onto the sphere of radius 1 / 1.1."""
    p = draws(spark, n, 3, seed).select(F.col("id").alias("body_id"), *((F.col(f"u{k}") * 2 - 1).alias(a) for k, a in enumerate(AXES)))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) * 1.1
    return p.select("body_id", *(F.try_divide(a, r).alias(a) for a in AXES))


def plummer(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A cluster of Plummer's profile; radii of 100 or more are drawn again, so ids number what stays."""
    tried = draws(spark, n + n // 100 + 100, 3, seed)
    r = F.lit(1.0) / F.sqrt(F.pow("u0", F.lit(-2.0 / 3.0)) - 1.0)
    good = numbered(tried.withColumn("r", r).where("r < 100"), ["id"], "body_id").where(F.col("body_id") < n)
    z = (F.lit(1.0) - F.lit(2.0) * F.col("u1")) * F.col("r")
    flat = F.sqrt(F.greatest(F.col("r") * F.col("r") - z * z, F.lit(0.0)))
    scale = 3.0 * pi / 16.0
    return good.select("body_id", (flat * F.cos(2.0 * pi * F.col("u2")) * scale).alias("x"), (flat * F.sin(2.0 * pi * F.col("u2")) * scale).alias("y"), (z * scale).alias("z"))


def with_charges(bodies: DataFrame, n: int, seed: int = 0, mass: bool = False) -> DataFrame:
    """Adds src: the seed's numbers less one half by id, or 1 / n."""
    if mass:
        return bodies.withColumn("src", F.lit(1.0 / n))
    return bodies.join(draws(bodies.sparkSession, n, 1, seed).select(F.col("id").alias("body_id"), (F.col("u0") - 0.5).alias("src")), "body_id")


def with_targets(bodies: DataFrame) -> DataFrame:
    """Adds empty results, each body's number and weight 1."""
    return bodies.withColumns({"trg": F.array(*(F.lit(0.0) for _ in range(4))), "ibody": F.col("body_id").cast("int"), "weight": F.lit(1.0)})


def generate(spark: SparkSession, n: int, kind: str = "c", seed: int = 0, mass: bool = False) -> DataFrame:
    """Bodies of a distribution, l(attice), c(ube), s(phere) or p(lummer), with charges and targets."""
    makers = {"l": lambda: lattice(spark, n), "c": lambda: cube(spark, n, seed), "s": lambda: sphere(spark, n, seed), "p": lambda: plummer(spark, n, seed)}
    if kind not in makers:
        raise ValueError(f"no distribution is called {kind}")
    bodies = makers[kind]()
    total = max(round(n ** (1 / 3)), 1) ** 3 if kind == "l" else n
    return with_targets(with_charges(bodies, total, seed, mass))


def random_masses(spark: SparkSession, n: int, seed: int = 0, dim: int = 3, equal: bool = False) -> DataFrame:
    """Bodies of the unit cube with masses of the generator over n, or all 1 / n."""
    each = dim + (not equal)
    u = draws(spark, n, each, seed)
    src = F.lit(1.0 / n) if equal else F.col(f"u{dim}") / n
    return u.select(F.col("id").alias("body_id"), *(F.col(f"u{k}").alias(a) for k, a in enumerate(AXES[:dim])), src.alias("src"))


def random_floats(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Bodies of the unit cube in single precision: coordinates, then strength, as the generator gives them."""
    return draws(spark, n, 4, seed).select(F.col("id").alias("body_id"), *(F.col(f"u{k}").cast("float").alias(a) for k, a in enumerate((*AXES, "src"))))


def neutral(bodies: DataFrame) -> DataFrame:
    """Charges less their mean."""
    mean = bodies.agg(F.avg("src").alias("__mean"))
    return bodies.crossJoin(F.broadcast(mean)).withColumn("src", F.col("src") - F.col("__mean")).drop("__mean")  # one row


def from_arrays(spark: SparkSession, x, q) -> DataFrame:
    """Bodies from flat arrays of a driver: x of 3 n coordinates, q of n charges."""
    import pandas as pd

    xyz = np.asarray(x, float).reshape(-1, 3)
    return spark.createDataFrame(pd.DataFrame({"body_id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "src": np.asarray(q, float)}), "body_id long, x double, y double, z double, src double")
