"""Calls for forces, and trees of streams."""

from pyspark.sql import functions as F

from treespan import api
from treespan.functions.special import erfc
from treespan.sources import generate as G
from treespan.streaming.batches import cells_to_parquet


def error(got, want):
    d = got.join(want.select("body_id", F.col("pot").alias("w")), "body_id")
    return d.agg(F.sqrt(F.sum((F.col("pot") - F.col("w")) ** 2) / F.sum(F.col("w") ** 2))).first()[0]


def test_other_targets(spark):
    s = G.random_masses(spark, 300, 1)
    t = G.random_masses(spark, 200, 2).drop("src")
    assert error(api.laplace(t, s, ncrit=16), api.direct_laplace(t, s)) < 5e-3


def test_stream(spark, tmp_path):
    G.random_masses(spark, 50).write.parquet(str(tmp_path / "in"))
    bodies = spark.readStream.schema("body_id long, x double, y double, z double, src double").parquet(str(tmp_path / "in"))
    q = cells_to_parquet(bodies, str(tmp_path / "out"), 8).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    cells = spark.read.parquet(str(tmp_path / "out"))
    assert cells.where("is_leaf").agg(F.sum("nb")).first()[0] == 50


def charges(spark, n=60):
    """A neutral cube of charges with types."""
    b = G.neutral(G.random_masses(spark, n, 4).withColumn("src", F.col("src") * n))
    return b.withColumn("atype", (F.col("body_id") % 2).cast("int"))


def test_periodic_charges(spark):
    """Ewald sums and levels of images of a neutral cube agree in forces and total energy; the surface term is spread evenly over the bodies."""
    b = charges(spark).select("body_id", "x", "y", "z", "src")
    ewald = api.ewald_coulomb(b, 11, 10.0, 0.25 / 3.141592653589793, 0.45, 1.0)
    images = api.coulomb(b, ncrit=16, cycle=1.0, images=3)
    assert ewald.count() == images.count() == 60
    both = images.join(ewald.select("body_id", *(F.col(c).alias(f"w_{c}") for c in api.KINDS)), "body_id")
    off = both.agg(F.sqrt(sum(F.sum((F.col(c) - F.col(f"w_{c}")) ** 2) for c in api.KINDS[1:]) / sum(F.sum(F.col(f"w_{c}") ** 2) for c in api.KINDS[1:])), F.sum("pot"), F.sum("w_pot")).first()
    assert off[0] < 2e-2 and abs(off[1] - off[2]) < 2e-2 * abs(off[2])
    assert error(api.coulomb(b, ncrit=16), api.direct_coulomb(b)) < 5e-3
    assert api.direct_coulomb(b, 1.0).count() == 60


def test_short_range(spark):
    b = charges(spark)
    types = spark.createDataFrame([(i, j, 40.0 + i + j, 0.1, 0.2) for i in (0, 1) for j in (0, 1)], "ti int, tj int, rscale double, gscale double, fgscale double")
    grid = api.vanderwaals(b, types, 0.2, 0.3, 1.0)
    every = api.direct_vanderwaals(b, b, types, 0.2, 0.3, 1.0)
    assert error(grid, every) < 1e-9
    pairs = spark.createDataFrame([(0, 1), (1, 0), (5, 6)], "body_id long, other long")
    assert {r.body_id for r in api.coulomb_exclusion(b, pairs, 1.0).collect()} == {0, 1, 5}
    assert {r.body_id for r in api.vanderwaals_exclusion(b, pairs, types, 0.2, 0.3, 1.0).collect()} <= {0, 1, 5}


def test_erfc(spark):
    import math

    rows = spark.range(1, 600).select((F.col("id") / 100).alias("x"))
    assert all(abs(r.e / math.erfc(r.x) - 1) < 1e-12 for r in rows.select("x", erfc(F.col("x")).alias("e")).collect())
