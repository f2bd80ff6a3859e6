"""Periodic images, Ewald sums, short-range forces and excluded pairs."""

from __future__ import annotations

from math import ceil, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.functions.vectors import norm2, wrap
from treespan.operators import pairs
from treespan.operators.tree import AXES
from treespan.plans.lineage import small

TWO_OVER_ROOT_PI = 2 / sqrt(pi)
#: Fixed value: Coulomb's constant in kcal A / (mol e^2).
CELEC = 332.0716
#: Types that go to tasks as arrays of all their pairs.
MOST_TYPES = 256


def images(spark: SparkSession, levels: int, cycle: float) -> DataFrame:
    """(ix, iy, iz, dx, dy, dz): shifts of all images, sum of 3^i for i below `levels` to either side."""
    reach = sum(3**i for i in range(levels))
    n = 2 * reach + 1
    one = F.col("id")
    at = [F.floor(one / n**k) % n - reach for k in (2, 1, 0)]
    return spark.range(n**3).select(*(c.cast("int").alias(f"i{a}") for a, c in zip(AXES, at)), *((c * cycle).cast("double").alias(f"d{a}") for a, c in zip(AXES, at)))


def with_images(bodies: DataFrame, levels: int, cycle: float) -> DataFrame:
    """Each body once for each image, shifted; the images are a table of fixed size."""
    every = bodies.crossJoin(F.broadcast(images(bodies.sparkSession, levels, cycle)))
    return every.withColumns({a: F.col(a) + F.col(f"d{a}") for a in AXES}).drop(*(f"d{a}" for a in AXES))


def _blocks(bodies: DataFrame, *more: str) -> pairs.Blocks:
    """Blocks in order of place; bodies without a place are in no pair."""
    placed = pairs.by_place(pairs.finite(bodies))
    if "src" in more:
        placed = placed.withColumn("src", F.coalesce("src", F.lit(0.0)))
    return pairs.blocks(placed, (*AXES, *more), ("key", "body_id"))


def pairs_within(targets: DataFrame, sources: DataFrame, cutoff: float, cycle: float | None = None, want: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs at a distance above 0 and below `cutoff`, from blocks of bodies that lie near each other.

    Columns: body_id and other, dx, dy, dz from source to target (the nearest image's if `cycle` is given), r2, and the
    sources' further columns with _s, the targets' with _t; or of these only those in `want`.
    """
    more = lambda df: [c for c in df.columns if c not in ("body_id", *AXES)]
    asked = lambda side, df: [c for c in more(df) if want is None or f"{c}_{side}" in want]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    of_t, of_s = asked("t", targets), asked("s", sources)
    both = sorted({*of_t, *of_s})
    columns = {"body_id": kind(targets, "body_id"), "other": kind(sources, "body_id")} | {c: "double" for c in (*(f"d{a}" for a in AXES), "r2")}
    columns |= {f"{a}_{side}": "double" for side in "ts" for a in AXES}
    columns |= {f"{c}_t": kind(targets, c) for c in of_t} | {f"{c}_s": kind(sources, c) for c in of_s}
    if want is not None:
        columns = {c: columns[c] for c in want}
    with_all = lambda df: df.select("body_id", *(F.col(a).cast("double").alias(a) for a in AXES), *(F.col(c) if c in df.columns else F.lit(None).cast(kind(targets if df is sources else sources, c)).alias(c) for c in both))
    t = pairs.blocks(pairs.by_place(pairs.finite(with_all(targets))), (*AXES, *both), ("key", "body_id"))
    s = t if sources is targets else pairs.blocks(pairs.by_place(pairs.finite(with_all(sources))), (*AXES, *both), ("key", "body_id"))
    return pairs.listed(t, s, cutoff, cycle, columns)


def _sums(targets: DataFrame, sources: DataFrame, kernel: pairs.Kernel, cutoff: float | None, cycle: float | None, weight: str = "src", both: bool = True) -> DataFrame:
    """A kernel's sums of bodies that are in a pair within the cutoff."""
    s = _blocks(sources, weight)
    t = s if targets is sources else _blocks(targets if weight in targets.columns else targets.withColumn(weight, F.lit(0.0)), weight)
    names = ("pot", *(f"acc_{a}" for a in AXES))
    return pairs.sums(t, None if t is s and both else s, kernel, (*names, "met"), cutoff, cycle, most=("met",), only="met").select("body_id", *names)


def coulomb(targets: DataFrame, sources: DataFrame, cutoff: float, cycle: float) -> DataFrame:
    """Potential and gradient of the sources of nearest images within a cutoff."""
    return _sums(targets, sources, pairs.laplace(0.0, cutoff, cycle), cutoff, cycle)


def counted(bodies: DataFrame, cutoff: float, cycle: float | None = None) -> DataFrame:
    """(body_id, n, furthest): how many others are within a cutoff, and the greatest squared distance of one."""
    t = _blocks(bodies)
    got = pairs.sums(t, None, pairs.counted(cutoff, cycle), ("n", "furthest"), cutoff, cycle, most=("furthest",), only="n")
    return got.withColumn("n", F.col("n").cast("long"))


def _summed(rows: DataFrame, pot: Column, force: Column) -> DataFrame:
    """Per body the sums of a potential and of -force times the distance vector."""
    terms = rows.select("body_id", pot.alias("pot"), *((-F.col(f"d{a}") * force).alias(f"acc_{a}") for a in AXES))
    return terms.groupBy("body_id").agg(*(F.sum(c).alias(c) for c in ("pot", *(f"acc_{a}" for a in AXES))))


def waves(spark: SparkSession, ksize: int) -> DataFrame:
    """(kx, ky, kz): wave vectors of length at most ksize in the half space, the null vector left out."""
    n = 2 * ksize + 1
    k = spark.range(n**3).select(*((F.floor(F.col("id") / n**i) % n - ksize).cast("int").alias(f"k{a}") for a, i in zip(AXES, (2, 1, 0))))
    kx, ky, kz = F.col("kx"), F.col("ky"), F.col("kz")
    half = (kx > 0) | ((kx == 0) & ((ky > 0) | ((ky == 0) & (kz > 0))))
    return k.where((kx * kx + ky * ky + kz * kz <= ksize * ksize) & half)


def structure_factors(bodies: DataFrame, ksize: int, cycle: float) -> DataFrame:
    """Each wave's re and im, the sums of q cos(k x) and q sin(k x): waves are a table of fixed size."""
    w = F.broadcast(waves(bodies.sparkSession, ksize))
    th = _phase(cycle)
    return bodies.crossJoin(w).groupBy("kx", "ky", "kz").agg(F.sum(F.col("src") * F.cos(th)).alias("re"), F.sum(F.col("src") * F.sin(th)).alias("im"))


def _phase(cycle: float) -> Column:
    return sum((F.col(f"k{a}") * F.col(a) for a in AXES), F.lit(0.0)) * (2 * pi / cycle)


def ewald_wave(targets: DataFrame, sources: DataFrame, ksize: int, alpha: float, sigma: float, cycle: float) -> DataFrame:
    """Potential and gradient of the smooth part."""
    scale = 2 * pi / cycle
    k2 = F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky") + F.col("kz") * F.col("kz")
    factor = F.lit(0.5 / pi / pi / sigma / cycle) * F.exp(-k2 * (scale * scale / (4 * alpha * alpha))) / k2
    w = structure_factors(sources, ksize, cycle).withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor})
    th = _phase(cycle)
    both = targets.select("body_id", *AXES).crossJoin(F.broadcast(w))
    pot = F.col("re") * F.cos(th) + F.col("im") * F.sin(th)
    slope = F.col("re") * F.sin(th) - F.col("im") * F.cos(th)
    terms = both.select("body_id", pot.alias("pot"), *((-slope * F.col(f"k{a}") * scale).alias(f"acc_{a}") for a in AXES))
    return terms.groupBy("body_id").agg(*(F.sum(c).alias(c) for c in ("pot", *(f"acc_{a}" for a in AXES))))


def ewald_real(targets: DataFrame, sources: DataFrame, alpha: float, cutoff: float, cycle: float) -> DataFrame:
    """Potential and gradient of the short-range part."""
    return _sums(targets, sources, pairs.ewald_real(alpha, cutoff, cycle), cutoff, cycle)


def ewald_self(bodies: DataFrame, alpha: float) -> DataFrame:
    zero = F.lit(0.0)
    return bodies.select("body_id", (F.lit(-TWO_OVER_ROOT_PI * alpha) * F.col("src")).alias("pot"), *(zero.alias(f"acc_{a}") for a in AXES))


def dipole(bodies: DataFrame) -> DataFrame:
    """One row: sums of q x, and the number of bodies."""
    return bodies.agg(*(F.sum(F.col(a) * F.col("src")).alias(f"d{a}") for a in AXES), F.count("*").alias("n"))


def dipole_correction(bodies: DataFrame, cycle: float) -> DataFrame:
    """The surface term: -c |d|^2 / (n q) for the potential, -c d for the gradient; none for bodies of no charge."""
    d = dipole(bodies).first()
    c = 4 * pi / (3 * cycle**3)
    v = [d[f"d{a}"] or 0.0 for a in AXES]
    pot = F.coalesce(F.try_divide(F.lit(-c * sum(x * x for x in v) / max(d["n"], 1)), F.col("src")), F.lit(0.0))
    return bodies.select("body_id", pot.alias("pot"), *(F.lit(-c * x).alias(f"acc_{a}") for a, x in zip(AXES, v)))


def _switched(r2: Column, rs: Column, gs: Column, fgs: Column, cuton: float, cutoff: float) -> tuple[Column, Column]:
    """Potential and force factor of a Lennard-Jones pair, switched off between cuton and cutoff."""
    on, off = cuton * cuton, cutoff * cutoff
    inv2 = F.lit(1.0) / (r2 * rs)
    inv6 = inv2 * inv2 * inv2
    t1 = (F.lit(off) - r2) / (off - on) ** 3
    t2 = t1 * (F.lit(off) - r2) * (F.lit(off - 3 * on) + 2 * r2)
    mid = r2 > on
    pot = F.when(mid, inv6 * (inv6 - 1) * t2).otherwise(inv6 * (inv6 - 1))
    force = F.when(mid, inv6 * (inv6 - 1) * 12 * (F.lit(on) - r2) * t1 - 6 * inv6 * (inv6 + (inv6 - 1) * t2) * t2 / r2).otherwise(inv2 * inv6 * (2 * inv6 - 1))
    return gs * pot, fgs * force


def vanderwaals(targets: DataFrame, sources: DataFrame, types: DataFrame, cuton: float, cutoff: float, cycle: float, every: bool = False) -> DataFrame:
    """Bodies have an `atype`; `types` (ti, tj, rscale, gscale, fgscale) has a row for each pair of types.

    Up to BROADCAST_ROWS different types of a row each go to all tasks as arrays; others are joined to a row for each pair.
    With `every`, no pair is left out by its block's or tile's box.
    """
    held = _tabled(types)
    if held is None:
        side = lambda df: df.select("body_id", *AXES, "atype")
        t = side(targets)
        s = t if sources is targets else side(sources)
        want = ("body_id", "dx", "dy", "dz", "r2", "atype_t", "atype_s")
        return _typed(pairs_within(t, s, cutoff, cycle, want), types, cuton, cutoff)
    kinds, (rscale, gscale, fgscale) = held
    at = F.create_map(*(F.lit(v) for kv in zip(kinds, range(len(kinds))) for v in kv)) if kinds else F.create_map()
    kind = F.try_element_at(at, F.col("atype")) if kinds else F.lit(None).cast("int")
    side = lambda df: df.select("body_id", *AXES, kind.alias("kind")).where("kind is not null")
    t = side(targets)
    s = t if sources is targets else side(sources)
    both = all((p == p.T).all() for p in (rscale, gscale, fgscale))
    return _sums(t, s, pairs.switched(rscale, gscale, fgscale, cuton, cutoff, cycle, every), None if every else cutoff, cycle, "kind", both)


def _tabled(types: DataFrame) -> tuple[list, list[np.ndarray]] | None:
    """Types and their parameters as square arrays, if they are few and each pair of types has one row."""
    few = types.select("ti", "tj", "rscale", "gscale", "fgscale").limit(MOST_TYPES**2 + 1).collect()
    kinds = sorted({r[0] for r in few} | {r[1] for r in few}) if all(None not in r for r in few) else None
    if kinds is None or len(few) != len(kinds) ** 2 or len({(r[0], r[1]) for r in few}) != len(few) or len(kinds) > MOST_TYPES:
        return None
    n, place = len(kinds), {k: i for i, k in enumerate(kinds)}
    out = [np.zeros((n, n)) for _ in range(3)]
    for r in few:
        for p, v in zip(out, r[2:]):
            p[place[r[0]], place[r[1]]] = v
    return kinds, out


def direct_vanderwaals(targets: DataFrame, sources: DataFrame, types: DataFrame, cuton: float, cutoff: float, cycle: float) -> DataFrame:
    """The same sums over all pairs of nearest images, those beyond the cutoff left out one by one: for checks."""
    return vanderwaals(targets, sources, types, cuton, cutoff, cycle, every=True)


def with_parameters(listed: DataFrame, types: DataFrame) -> DataFrame:
    """Pairs with their types' parameters; types (ti, tj, rscale, gscale, fgscale) are broadcast if they are few."""
    known = small(types.withColumnsRenamed({"ti": "atype_t", "tj": "atype_s"}))
    return listed.join(known, ["atype_t", "atype_s"])


def _typed(listed: DataFrame, types: DataFrame, cuton: float, cutoff: float) -> DataFrame:
    pot, force = _switched(F.col("r2"), F.col("rscale"), F.col("gscale"), F.col("fgscale"), cuton, cutoff)
    return _summed(with_parameters(listed, types), pot, force)


def _listed(bodies: DataFrame, excluded: DataFrame, cycle: float, *more: str) -> DataFrame:
    """Pairs (body_id, other) of a list, with distances to the nearest image."""
    side = lambda s, k: bodies.select(F.col("body_id").alias(k), *(F.col(c).alias(f"{c}_{s}") for c in (*AXES, *more)))
    listed = excluded.select("body_id", "other").join(side("t", "body_id"), "body_id").join(side("s", "other"), "other")
    d = wrap([F.col(f"{a}_t") - F.col(f"{a}_s") for a in AXES], F.lit(cycle))[0]
    return listed.withColumns({f"d{a}": c for a, c in zip(AXES, d)}).withColumn("r2", norm2([F.col(f"d{a}") for a in AXES])).where("r2 > 0")


def coulomb_exclusion(bodies: DataFrame, excluded: DataFrame, cycle: float) -> DataFrame:
    """What the listed pairs contribute, with the opposite sign: to be added to a full sum. Per unit charge of the target."""
    inv = F.lit(1.0) / F.sqrt(F.col("r2"))
    return _summed(_listed(bodies, excluded, cycle, "src"), -F.col("src_s") * inv, -F.col("src_s") * inv * inv * inv)


def vanderwaals_exclusion(bodies: DataFrame, excluded: DataFrame, types: DataFrame, cuton: float, cutoff: float, cycle: float) -> DataFrame:
    listed = _listed(bodies, excluded, cycle, "atype").where(F.col("r2") < cutoff * cutoff)
    got = _typed(listed, types, cuton, cutoff)
    return got.select("body_id", *((-F.col(c)).alias(c) for c in ("pot", *(f"acc_{a}" for a in AXES))))


def grid_cells(cutoff: float, cycle: float) -> int:
    return max(1, ceil(cycle / cutoff))
