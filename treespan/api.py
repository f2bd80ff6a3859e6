"""Forces on bodies by one call each: body_id, pot, acc_x, acc_y, acc_z."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespan.operators import expansions, kernels, periodic, traverse
from treespan.operators.tree import build_tree, bounding_box

KINDS = ("pot", "acc_x", "acc_y", "acc_z")


def laplace(
    targets: DataFrame, sources: DataFrame | None = None, theta: float = 0.4, ncrit: int = 64, order: int = expansions.ORDER,
    rules: expansions.Rules = expansions.CARTESIAN, cycle: float | None = None, images: int = 0,
) -> DataFrame:
    """Fast multipole sums of src / r; targets are the sources unless others are given.

    In a periodic cube of side `cycle`, one level of images adds the 26 nearest, as bodies; each further level adds
    the 26 neighbours of the block so far, as wholes. Images take the sources to be the targets.
    """
    if images and sources is None:
        tree = build_tree(targets, ncrit)
        near = build_tree(periodic.with_images(targets, 1, cycle), ncrit)
        sums = expansions.fast_multipole(tree, traverse.dual(tree, theta, sources=near), order, near, rules)
        if images == 1:
            return sums
        return expansions.added(sums, expansions.at_bodies(tree, expansions.periodic_local(tree, cycle, images, order, rules), order, rules))
    if images:
        raise ValueError("images are of the targets' own cube")
    if sources is None:
        tree = build_tree(targets, ncrit)
        return expansions.fast_multipole(tree, traverse.dual(tree, theta), order, rules=rules)
    if "src" not in targets.columns:
        targets = targets.withColumn("src", F.lit(0.0))
    box = bounding_box(targets.select("x", "y", "z").union(sources.select("x", "y", "z")))
    t, s = build_tree(targets, ncrit, box=box), build_tree(sources, ncrit, box=box)
    return expansions.fast_multipole(t, traverse.dual(t, theta, sources=s), order, s, rules)


def direct_laplace(targets: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    return kernels.direct(targets, targets if sources is None else sources)


def _scaled(df: DataFrame, bodies: DataFrame, by: float) -> DataFrame:
    """Times each body's charge and a constant."""
    return df.join(bodies.select("body_id", F.col("src").alias("__q")), "body_id").select("body_id", *((F.col(c) * F.col("__q") * by).alias(c) for c in KINDS))


def coulomb(bodies: DataFrame, theta: float = 0.4, ncrit: int = 64, cycle: float | None = None, images: int = 0) -> DataFrame:
    """Energies and forces of charges in open space or, with levels of images, in a periodic cube with its surface term."""
    sums = laplace(bodies, theta=theta, ncrit=ncrit, cycle=cycle, images=images)
    if images:
        sums = expansions.added(sums, periodic.dipole_correction(bodies, cycle))
    return _scaled(sums, bodies, periodic.CELEC)


def ewald_coulomb(bodies: DataFrame, ksize: int, alpha: float, sigma: float, cutoff: float, cycle: float) -> DataFrame:
    """Energies and forces of charges in a periodic cube."""
    parts = (periodic.ewald_wave(bodies, bodies, ksize, alpha, sigma, cycle), periodic.ewald_real(bodies, bodies, alpha, cutoff, cycle), periodic.ewald_self(bodies, alpha))
    return _scaled(expansions.added(*parts), bodies, periodic.CELEC)


def direct_coulomb(bodies: DataFrame, cycle: float | None = None) -> DataFrame:
    """All pairs, of nearest images if the space is periodic, with the surface term then."""
    if cycle is None:
        return _scaled(kernels.direct(bodies, bodies), bodies, periodic.CELEC)
    sums = periodic.coulomb(bodies, bodies, 2 * cycle, cycle)
    return _scaled(expansions.added(sums, periodic.dipole_correction(bodies, cycle)), bodies, periodic.CELEC)


def coulomb_exclusion(bodies: DataFrame, excluded: DataFrame, cycle: float) -> DataFrame:
    return _scaled(periodic.coulomb_exclusion(bodies, excluded, cycle), bodies, periodic.CELEC)


def vanderwaals(bodies: DataFrame, types: DataFrame, cuton: float, cutoff: float, cycle: float) -> DataFrame:
    return periodic.vanderwaals(bodies, bodies, types, cuton, cutoff, cycle)


vanderwaals_exclusion = periodic.vanderwaals_exclusion


def direct_vanderwaals(targets: DataFrame, sources: DataFrame, types: DataFrame, cuton: float, cutoff: float, cycle: float) -> DataFrame:
    """As vanderwaals, over all pairs and without a grid: for checks."""
    return periodic.direct_vanderwaals(targets, sources, types, cuton, cutoff, cycle)
