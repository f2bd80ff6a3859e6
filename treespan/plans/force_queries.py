"""Queries of traversals, sums over pairs, and periodic forces."""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan import api
from treespan.functions import spherical as SH
from treespan.operators import expansions as X
from treespan.operators.harmonic import SPHERICAL
from treespan.operators import kernels as K
from treespan.operators import mapping as M
from treespan.operators import partition as P
from treespan.operators import periodic as E
from treespan.operators import traverse as V
from treespan.operators import tree as T
from treespan.plans import sql as S
from treespan.plans.registry import SQL, add
from treespan.plans.tree_queries import _HEADS, K3, tree_of
from treespan.sources import bodies as B

AX = ("x", "y", "z")
KINDS = ("pot", "acc_x", "acc_y", "acc_z")


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *((F.round(c, digits) + 0.0).alias(c) for c in df.columns if c not in keys))


def _r(names=KINDS, digits: int = 6) -> str:
    return ", ".join(f"ROUND({n}, {digits}) + 0.0 AS {n}" for n in names)


# direct sums
def direct_sql(eps: float, where: str = "TRUE") -> str:
    r2 = "(s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z)"
    acc = ", ".join(f"SUM((s.{a} - t.{a}) * s.src / (SQRT(r2) * r2)) AS acc_{a}" for a in AX)
    return f"""p AS (SELECT t.body_id, s.src, t.x AS tx, t.y AS ty, t.z AS tz, s.x, s.y, s.z, {r2} + {eps}::DOUBLE AS r2 FROM b t, b s WHERE {where}),
d AS (SELECT body_id, SUM(src / SQRT(r2)) AS pot, {', '.join(f'SUM((p.{a} - p.t{a}) * src / (SQRT(r2) * r2)) AS acc_{a}' for a in AX)} FROM p WHERE r2 <> 0 GROUP BY body_id)""" if acc else ""  # fmt: skip


_DIRECT = f"WITH {B.SQL['b3']}, {direct_sql(0.0)} SELECT body_id, {_r()} FROM d"
_SOFT = f"WITH {B.SQL['b3']}, {direct_sql(1e-6)} SELECT body_id, {_r(digits=4)} FROM d"


def _direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.b3(spark, sf_dir)
    return rounded(K.direct(b, b), "body_id")


def _direct_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.b3(spark, sf_dir)
    return rounded(K.direct(b, b, eps2=K.EPS2), "body_id", digits=4)


add("join_direct", _direct, _DIRECT)
add("agg_bh_force_direct", _direct_soft, _SOFT)


def _through_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of runs of leaves, then of their bodies."""
    t = tree_of(spark, sf_dir, "b3", 64)
    b = t.bodies_in_leaves()
    return rounded(K.direct(b, b, order=("leaf", "key", "body_id")), "body_id")


add("join_direct_tree", _through_tree, _DIRECT)
add("flt_r2_nonzero", lambda spark, sf_dir: (lambda b: K.direct(b, b).agg(F.count("*").alias("targets"), (F.round(F.sum("pot"), 4) + 0.0).alias("pot")))(B.b3(spark, sf_dir)),
    f"WITH {B.SQL['b3']}, {direct_sql(0.0)} SELECT COUNT(*) AS targets, ROUND(SUM(pot), 4) + 0.0 AS pot FROM d")


# cell pairs
def _dual(ncrit: int, theta: float, view: str = "b3", mutual: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = V.dual(tree_of(spark, sf_dir, view, ncrit), theta, mutual=mutual)
        return p.far.select("i", "j", F.lit("far").alias("state")).union(p.near.select("i", "j", F.lit("near").alias("state")))

    return run


def _dual_sql(ncrit: int, theta: float, view: str = "b3") -> str:
    return f"WITH RECURSIVE {S.tree(view, ncrit)}, {S.geometry()}, {S.dual(theta)}"


add("join_dtt", _dual(16, 0.4), f"{_dual_sql(16, 0.4)} SELECT i, j, state FROM pairs WHERE state <> 'split'")
add("join_product_mutual", _dual(16, 0.8, mutual=True), f"WITH RECURSIVE {S.tree('b3', 16)}, {S.geometry()}, {S.dual_mutual(0.8)} SELECT i, j, state FROM pairs")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(4, 0.8)(spark, sf_dir).groupBy("state").agg(F.count("*").alias("pairs"))


add("agg_count_kernels", _counts, f"{_dual_sql(4, 0.8)} SELECT state, COUNT(*) AS pairs FROM pairs WHERE state <> 'split' GROUP BY state")


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cells that the criterion accepts, with the share of their distance that their radii take."""
    t = tree_of(spark, sf_dir)
    r = V.cell_radius(t, t.cells)
    side = lambda s: r.select(F.col("key").alias(s), F.col("r").alias(f"r_{s}"), *(F.col(f"c{a}").alias(f"{a}_{s}") for a in AX))
    both = V.dual(t, 0.5).far.join(side("i"), "i").join(side("j"), "j")
    d2 = sum(((F.col(f"{a}_i") - F.col(f"{a}_j")) * (F.col(f"{a}_i") - F.col(f"{a}_j")) for a in AX), F.lit(0.0))
    return rounded(both.select("i", "j", ((F.col("r_i") + F.col("r_j")) / F.sqrt(d2)).alias("share")), "i", "j")


_CD2 = " + ".join(f"(a.c{x} - b.c{x}) * (a.c{x} - b.c{x})" for x in AX)
add("flt_mac_fmm", _accepted, f"{_dual_sql(16, 0.5)} SELECT p.i, p.j, ROUND((a.r + b.r) / SQRT({_CD2}), 6) + 0.0 AS share FROM pairs p JOIN n a ON a.key = p.i JOIN n b ON b.key = p.j WHERE p.state = 'far'")
add("agg_weight", lambda spark, sf_dir: _dual(16, 0.4)(spark, sf_dir).groupBy(F.col("i").alias("key")).agg(F.count("*").alias("weight")),
    f"{_dual_sql(16, 0.4)} SELECT i AS key, COUNT(*) AS weight FROM pairs WHERE state <> 'split' GROUP BY i")


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of bodies that the pairs of cells stand for: all, each once."""
    t = tree_of(spark, sf_dir)
    p = V.dual(t, 0.4)
    nb = t.cells.select("key", "nb")
    every = p.far.union(p.near).join(nb.select(F.col("key").alias("i"), F.col("nb").alias("a")), "i").join(nb.select(F.col("key").alias("j"), F.col("nb").alias("b")), "j")
    return every.agg(F.sum(F.col("a") * F.col("b")).alias("covered"))


add("join_dtt_cover", _cover, "SELECT COUNT(*) * COUNT(*) AS covered FROM embeddings")


# bodies and cells
def _bh(spark: SparkSession, sf_dir: str):
    t = tree_of(spark, sf_dir, "b3", 1)
    return t, V.by_bodies(t, 0.5)


def _bh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bh(spark, sf_dir)[1]
    return p.far.select("i", "j", F.lit("far").alias("state")).union(p.near.select("i", "j", F.lit("near").alias("state")))


_BH = f"WITH RECURSIVE {S.tree('b3', 1)}, {S.geometry()}, {S.body_walk(0.5)}"
add("join_bh_interact", _bh_pairs, f"{_BH} SELECT i, j, state FROM acts")


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that act on a body as wholes, with their width over the distance."""
    t = tree_of(spark, sf_dir, "b3", 4)
    g = t.with_geometry().select(F.col("key").alias("j"), "w0", *(f"c{a}" for a in AX))
    both = V.by_bodies(t, 0.7).far.join(g, "j").join(t.bodies.select(F.col("body_id").alias("i"), *AX), "i")
    d2 = sum(((F.col(f"c{a}") - F.col(a)) * (F.col(f"c{a}") - F.col(a)) for a in AX), F.lit(0.0))
    return rounded(both.select("i", "j", (F.col("w0") / F.sqrt(d2)).alias("seen")), "i", "j")


_BD2 = " + ".join(f"(g.c{a} - b.{a}) * (g.c{a} - b.{a})" for a in AX)
add("flt_mac_bh", _seen, f"WITH RECURSIVE {S.tree('b3', 4)}, {S.geometry()}, {S.body_walk(0.7)} SELECT acts.i, acts.j, ROUND(g.s0 / SQRT({_BD2}), 6) + 0.0 AS seen FROM acts JOIN g ON g.key = acts.j JOIN b ON b.body_id = acts.i WHERE acts.state = 'far'")
_MOMENTS = f"m AS (SELECT {S.prefix('key', 'd')} AS key, SUM(src) AS mass, SUM(x * src) AS sx, SUM(y * src) AS sy, SUM(z * src) AS sz FROM k, (SELECT UNNEST(range(0, 20)) AS d) GROUP BY 1), com AS (SELECT cells.key, mass, sx / mass AS x, sy / mass AS y, sz / mass AS z FROM m JOIN cells ON cells.key = m.key)"
_COM = f"WITH {S.tree('b3', 16)}, {_MOMENTS} SELECT key, {_r(('mass', 'x', 'y', 'z'))} FROM com"


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.moments(tree_of(spark, sf_dir)).drop("count"), "key")


add("agg_bh_com", _moments, _COM)
add("agg_count_cells", lambda spark, sf_dir: K.moments(tree_of(spark, sf_dir)).select("key", F.col("count").alias("nb")), f"WITH {S.tree('b3', 16)} SELECT key, nb FROM cells WHERE nb > 0")


def _bh_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.barnes_hut_sums(tree_of(spark, sf_dir, "b3", 1)), "body_id", digits=4)


def _bh_force_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With leaves of several bodies, by the rows of pairs that trees of any size go by."""
    t = tree_of(spark, sf_dir, "b3", 8)
    return rounded(K.barnes_hut(t, V.by_bodies(t, 0.5)), "body_id", digits=4)


_ACT = f"""{_BH}, {_MOMENTS}, s AS (SELECT acts.i, com.mass AS src, com.x, com.y, com.z FROM acts JOIN com ON com.key = acts.j),
q AS (SELECT t.body_id, s.src, s.x - t.x AS x, s.y - t.y AS y, s.z - t.z AS z, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) + 1e-6::DOUBLE AS r2 FROM s JOIN b t ON t.body_id = s.i),
d AS (SELECT body_id, SUM(src / SQRT(r2)) AS pot, {', '.join(f'SUM({a} * src / (SQRT(r2) * r2)) AS acc_{a}' for a in AX)} FROM q GROUP BY body_id)"""
add("agg_bh_force", _bh_force, f"{_ACT} SELECT body_id, {_r(digits=4)} FROM d")
_ACT8 = f"""WITH RECURSIVE {S.tree('b3', 8)}, {S.geometry()}, {S.body_walk(0.5)}, {_MOMENTS}, s AS (SELECT acts.i, com.mass AS src, com.x, com.y, com.z FROM acts JOIN com ON com.key = acts.j WHERE acts.state = 'far'
 UNION ALL SELECT acts.i, k.src, k.x, k.y, k.z FROM acts JOIN k ON (k.key >> {S.below('(acts.j & 31)')}) = (acts.j >> {S.below('(acts.j & 31)')}) WHERE acts.state = 'near'),""" + _ACT.split("FROM acts JOIN com ON com.key = acts.j),", 1)[1]
add("agg_bh_force_pairs", _bh_force_leaves, f"{_ACT8} SELECT body_id, {_r(digits=4)} FROM d")
add("agg_bh_force_walked", lambda spark, sf_dir: rounded(K.barnes_hut_sums(tree_of(spark, sf_dir, "b3", 8)), "body_id", digits=4), f"{_ACT8} SELECT body_id, {_r(digits=4)} FROM d")


def _bh_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative errors against the direct sum, and whether both are below the accuracy asked for."""
    t = tree_of(spark, sf_dir, "b3", 1)
    return verify(K.barnes_hut_sums(t), K.direct(t.bodies, t.bodies, eps2=K.EPS2), 1e-2)


def verify(got: DataFrame, want: DataFrame, most: float) -> DataFrame:
    """(bodies, pot_error, acc_error, good): relative L2 errors of potentials and gradients."""
    both = got.join(want.select("body_id", *(F.col(c).alias(f"want_{c}") for c in KINDS)), "body_id")
    off = lambda c: (F.col(c) - F.col(f"want_{c}")) * (F.col(c) - F.col(f"want_{c}"))
    sq = lambda c: F.col(f"want_{c}") * F.col(f"want_{c}")
    acc = KINDS[1:]
    out = both.agg(F.count("*").alias("bodies"), F.sqrt(F.sum(off("pot")) / F.sum(sq("pot"))).alias("pot_error"), F.sqrt(F.sum(sum((off(c) for c in acc), F.lit(0.0))) / F.sum(sum((sq(c) for c in acc), F.lit(0.0)))).alias("acc_error"))
    return out.withColumn("good", (F.col("pot_error") < most) & (F.col("acc_error") < most))


_ERR = f"""{_ACT}, dd AS (SELECT t.body_id, SUM(u.src / SQRT(r2)) AS pot, {', '.join(f'SUM((u.{a} - t.{a}) * u.src / (SQRT(r2) * r2)) AS acc_{a}' for a in AX)}
 FROM b t, LATERAL (SELECT s.*, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) + 1e-6::DOUBLE AS r2 FROM b s) u GROUP BY t.body_id)"""
add("agg_check_bh", lambda spark, sf_dir: _bh_errors(spark, sf_dir).select("bodies", (F.round("pot_error", 6) + 0.0).alias("pot_error"), (F.round("acc_error", 6) + 0.0).alias("acc_error")),
    f"{_ERR} SELECT COUNT(*) AS bodies, ROUND(SQRT(SUM(POWER(d.pot - dd.pot, 2)) / SUM(POWER(dd.pot, 2))), 6) + 0.0 AS pot_error, ROUND(SQRT(SUM({' + '.join(f'POWER(d.acc_{a} - dd.acc_{a}, 2)' for a in AX)}) / SUM({' + '.join(f'POWER(dd.acc_{a}, 2)' for a in AX)})), 6) + 0.0 AS acc_error FROM d JOIN dd ON dd.body_id = d.body_id")


def _bh2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and cell pairs in the plane by distance from the centre of mass."""
    t = T.build_tree(B.b3(spark, sf_dir).drop("z"), 1, 2)
    p = V.by_bodies(t, 0.5, centres=K.moments(t).select("key", "x", "y"))
    return p.far.select(F.lit("far").alias("state")).union(p.near.select(F.lit("near").alias("state"))).groupBy("state").agg(F.count("*").alias("pairs"))


_P2 = S.tree("b3", 1, 2)
add("join_bh_proto", _bh2, f"""WITH RECURSIVE {_P2}, {S.geometry(2)},
m AS (SELECT {S.prefix('key', 'd', 2)} AS key, SUM(src) AS mass, SUM(x * src) AS sx, SUM(y * src) AS sy FROM k, (SELECT UNNEST(range(0, 30)) AS d) GROUP BY 1),
n AS (SELECT g.key, g.parent, g.is_leaf, g.s0, sx / mass AS cx, sy / mass AS cy FROM g JOIN m ON m.key = g.key WHERE g.nb > 0),
walk AS (
 SELECT t.body_id AS i, 0::BIGINT AS j, CASE WHEN n.is_leaf THEN 'near' WHEN n.s0 < 0.5::DOUBLE * SQRT((n.cx - t.x) * (n.cx - t.x) + (n.cy - t.y) * (n.cy - t.y)) THEN 'far' ELSE 'split' END AS state, t.x, t.y FROM b t JOIN n ON n.key = 0
 UNION ALL SELECT t.i, n.key, CASE WHEN n.is_leaf THEN 'near' WHEN n.s0 < 0.5::DOUBLE * SQRT((n.cx - t.x) * (n.cx - t.x) + (n.cy - t.y) * (n.cy - t.y)) THEN 'far' ELSE 'split' END, t.x, t.y FROM walk t JOIN n ON n.parent = t.j WHERE t.state = 'split')
SELECT state, COUNT(*) AS pairs FROM walk WHERE state <> 'split' GROUP BY state""")  # fmt: skip


# expansions
def _p2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    m = X.p2m(t, 3)
    return rounded(m.select("key", *(F.col("m")[i].alias(f"m{i}") for i in range(10))), "key")


def _up(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.multipoles(tree_of(spark, sf_dir), 3)
    return rounded(m.select("key", *(F.col("m")[i].alias(f"m{i}") for i in range(10))), "key")


_D = {a: f"(g.c{a} - k.{a})" for a in AX}
_TERMS = ["1.0::DOUBLE", *(_D[a] for a in AX), *(f"{_D[a]} * {_D[b]}" + (" / 2" if a == b else "") for i, a in enumerate(AX) for b in AX[i:])]
_M = ", ".join(f"ROUND(SUM(k.src * {t}), 6) + 0.0 AS m{i}" for i, t in enumerate(_TERMS))
_UP = f"WITH {S.tree('b3', 16)}, {S.geometry()}, e AS (SELECT k.*, {S.prefix('key', 'd')} AS cell FROM k, (SELECT UNNEST(range(0, 20)) AS d)) SELECT g.key, {_M} FROM e k JOIN g ON g.key = k.cell"
add("agg_p2m", _p2m, f"{_UP} WHERE g.is_leaf GROUP BY g.key")
add("agg_m2m", _up, f"{_UP} GROUP BY g.key")


def _fmm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upward pass of charges of both signs, at the order that forces are computed with."""
    m = X.multipoles(tree_of(spark, sf_dir, "b3c"), X.ORDER)
    return rounded(m.select("key", *(F.col("m")[i].alias(f"m{i}") for i in range(len(X.indices(X.ORDER))))), "key", digits=7)


_NAMES = ("(g.cx - k.x)", "(g.cy - k.y)", "(g.cz - k.z)")
_M6 = ", ".join(f"ROUND(SUM(k.src * {S.monomial(_NAMES, a)}), 7) + 0.0 AS m{i}" for i, a in enumerate(S.multi(X.ORDER)))
add("agg_fmm_up", _fmm_up, f"WITH {S.tree('b3c', 16)}, {S.geometry()}, e AS (SELECT k.*, {S.prefix('key', 'd')} AS cell FROM k, (SELECT UNNEST(range(0, 20)) AS d)) SELECT g.key, {_M6} FROM e k JOIN g ON g.key = k.cell GROUP BY g.key")
add("agg_mass_norm", lambda spark, sf_dir: rounded(X.multipoles(tree_of(spark, sf_dir), 2).select("key", *((F.col("m")[i] / F.col("m")[0]).alias(f"m{i}") for i in range(4))), "key"),
    f"WITH {S.tree('b3', 16)}, {S.geometry()}, e AS (SELECT k.*, {S.prefix('key', 'd')} AS cell FROM k, (SELECT UNNEST(range(0, 20)) AS d)) SELECT g.key, " + ", ".join(f"ROUND(SUM(k.src * {t}) / SUM(k.src), 6) + 0.0 AS m{i}" for i, t in enumerate(_TERMS[:4])) + " FROM e k JOIN g ON g.key = k.cell GROUP BY g.key")


def _fmm(spark: SparkSession, sf_dir: str, order: int = X.ORDER) -> DataFrame:
    t = tree_of(spark, sf_dir)
    return X.fast_multipole(t, V.dual(t, 0.4), order)


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    return rounded(K.near_field(t, V.dual(t, 0.4).near), "body_id")


add("agg_p2p", _near, f"""{_dual_sql(16, 0.4)}, lf AS (SELECT k.body_id, k.x, k.y, k.z, k.src, c.key AS leaf FROM k, cells c WHERE c.is_leaf AND c.nb > 0 AND (k.key >> {S.below('c.depth')}) = (c.key >> {S.below('c.depth')})),
q AS (SELECT t.body_id, s.src, s.x - t.x AS x, s.y - t.y AS y, s.z - t.z AS z, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) AS r2 FROM pairs p JOIN lf t ON t.leaf = p.i JOIN lf s ON s.leaf = p.j WHERE p.state = 'near'),
d AS (SELECT body_id, SUM(src / SQRT(r2)) AS pot, {', '.join(f'SUM({a} * src / (SQRT(r2) * r2)) AS acc_{a}' for a in AX)} FROM q WHERE r2 <> 0 GROUP BY body_id) SELECT body_id, {_r()} FROM d""")  # fmt: skip
def _far(order: int, part: str):
    """Local expansions of targets or of leaves, or the far field at bodies."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tree_of(spark, sf_dir)
        far = V.dual(t, 0.4).far
        if part == "bodies":
            return rounded(X.far_field(t, far, order), "body_id")
        c = X.locals_(t, far, order)
        c = X.leaf_locals(t, c, order) if part == "leaves" else c
        return rounded(c.select("key", *(F.col("l")[i].alias(f"l{i}") for i in range(len(X.indices(order))))), "key", digits=5)

    return run


def _far_sql(order: int) -> str:
    return f"{_dual_sql(16, 0.4)}, {S.expansions(order)}"


_L3 = ", ".join(f"ROUND(l{i}, 5) + 0.0 AS l{i}" for i in range(10))
add("agg_m2l", _far(3, "targets"), f"{_far_sql(3)} SELECT key, {_L3} FROM lo")
add("agg_l2l", _far(3, "leaves"), f"{_far_sql(3)} SELECT key, {_L3} FROM lv")
add("agg_l2p", _far(3, "bodies"), f"{_far_sql(3)}, {S.at_bodies(3)} SELECT body_id, {_r()} FROM fb")
add("agg_fmm_down", _far(X.ORDER, "bodies"), f"{_far_sql(X.ORDER)}, {S.at_bodies(X.ORDER)} SELECT body_id, {_r()} FROM fb")
_FMM = f"{_far_sql(X.ORDER)}, {S.at_bodies(X.ORDER)}, {S.near_bodies()}, fm AS (SELECT body_id, SUM(pot) AS pot, {', '.join(f'SUM(acc_{a}) AS acc_{a}' for a in AX)} FROM (SELECT * FROM fb UNION ALL SELECT * FROM nbod) GROUP BY body_id)"
add("fmm", lambda spark, sf_dir: rounded(_fmm(spark, sf_dir), "body_id", digits=5), f"{_FMM} SELECT body_id, {_r(digits=5)} FROM fm")


def _m2p(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    return rounded(X.by_multipoles(t, V.by_bodies(t, 0.8).far, 4), "body_id")


_UNIT = [tuple(int(i == k) for i in range(3)) for k in range(3)]
_D4 = [("pot", (0, 0, 0)), *((f"acc_{a}", u) for a, u in zip(AX, _UNIT))]
_M2P = ", ".join("SUM(" + " + ".join(f"m{i} * {S.inverse_r(S._plus(a, u))}" for i, a in enumerate(S.multi(4))) + f") AS {n}" for n, u in _D4)
add("agg_m2p", _m2p, f"WITH RECURSIVE {S.tree('b3', 16)}, {S.geometry()}, {S.body_walk(0.8)}, pairs AS (SELECT NULL::BIGINT AS i, NULL::BIGINT AS j, 'far' AS state WHERE FALSE), {S.expansions(4)}, v AS (SELECT acts.i AS body_id, mm.*, b.x - mm.cx AS rx, b.y - mm.cy AS ry, b.z - mm.cz AS rz FROM acts JOIN mm ON mm.key = acts.j JOIN b ON b.body_id = acts.i WHERE acts.state = 'far'), q AS (SELECT v.*, rx * rx + ry * ry + rz * rz AS r2 FROM v), d AS (SELECT body_id, {_M2P} FROM q GROUP BY body_id) SELECT body_id, {_r()} FROM d")


def _fmm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether fast multipole sums are as close to direct ones as asked for, and the errors."""
    b = B.b3(spark, sf_dir)
    return rounded(verify(_fmm(spark, sf_dir), K.direct(b, b), 5e-3), "bodies", "good", digits=8)


_OFF = lambda names: " + ".join(f"POWER(fm.{n} - dd.{n}, 2)" for n in names)
_NORM = lambda names: " + ".join(f"POWER(dd.{n}, 2)" for n in names)
_POT_ERROR, _ACC_ERROR = (f"SQRT(SUM({_OFF(n)}) / SUM({_NORM(n)}))" for n in (KINDS[:1], KINDS[1:]))
add("agg_verify_fmm", _fmm_gate, f"{_FMM}, {direct_sql(0.0).replace('d AS (', 'dd AS (')} SELECT COUNT(*) AS bodies, ROUND({_POT_ERROR}, 8) + 0.0 AS pot_error, ROUND({_ACC_ERROR}, 8) + 0.0 AS acc_error, {_POT_ERROR} < 5e-3 AND {_ACC_ERROR} < 5e-3 AS good FROM fm JOIN dd ON dd.body_id = fm.body_id")


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.b3(spark, sf_dir)
    d = K.direct(b, b).join(b.select("body_id", "src"), "body_id")
    return d.agg((F.round(F.sum(F.col("pot") * F.col("src")), 3) + 0.0).alias("pot_q"), (F.round(F.sum(F.col("pot") * F.col("pot")), 0) + 0.0).alias("pot2"), (F.round(F.sum(F.col("acc_x") * F.col("acc_x") + F.col("acc_y") * F.col("acc_y") + F.col("acc_z") * F.col("acc_z")) / 1000, 0) + 0.0).alias("acc2"))


add("agg_verify_sums", _sums, f"WITH {B.SQL['b3']}, {direct_sql(0.0)} SELECT ROUND(SUM(pot * src), 3) + 0.0 AS pot_q, ROUND(SUM(pot * pot), 0) + 0.0 AS pot2, ROUND(SUM(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) / 1000, 0) + 0.0 AS acc2 FROM d JOIN b ON b.body_id = d.body_id")
def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies and forces, which carry each body's own strength, over that strength; charges of 0 have none."""
    b = B.b3c(spark, sf_dir).withColumn("src", F.col("src") - 0.5)
    sums = K.direct(b, b).join(b.select("body_id", "src"), "body_id").select("body_id", *((F.col(c) * F.col("src")).alias(c) for c in KINDS))
    return rounded(K.normalized(sums, b), "body_id")


_OWN = f"WITH {B.SQL['b3c']}, b0 AS (SELECT * REPLACE (src - 0.5::DOUBLE AS src) FROM b), {direct_sql(0.0).replace('FROM b t, b s', 'FROM b0 t, b0 s')}, e AS (SELECT d.body_id, b0.src, {', '.join(f'{c} * b0.src AS {c}' for c in KINDS)} FROM d JOIN b0 ON b0.body_id = d.body_id)"
add("agg_normalize", _normalized, f"{_OWN} SELECT body_id, {', '.join(f'CASE WHEN src = 0 THEN NULL ELSE ROUND({c} / src, 6) + 0.0 END AS {c}' for c in KINDS)} FROM e")
add("agg_direct_laplace", lambda spark, sf_dir: (lambda b: rounded(api.direct_laplace(b.where("body_id % 3 = 0"), b.where("body_id % 3 <> 0")), "body_id"))(B.b3(spark, sf_dir)), f"WITH {B.SQL['b3']}, {direct_sql(0.0, 't.body_id % 3 = 0 AND s.body_id % 3 <> 0')} SELECT body_id, {_r()} FROM d")
add("agg_allreduce", lambda spark, sf_dir: B.lineitems(spark, sf_dir).agg(F.count("*").alias("n"), *(f(a).alias(f"{n}_{a}") for a in AX for n, f in (("lo", F.min), ("hi", F.max)))), f"WITH {B.SQL['lineitems']} SELECT COUNT(*) AS n, " + ", ".join(f"MIN({a}) AS lo_{a}, MAX({a}) AS hi_{a}" for a in AX) + " FROM b")

# periodic
CYCLE, CUTOFF, CUTON, ALPHA, KSIZE = 1.0, 0.3, 0.2, 10.0, 4
SIGMA = 0.25 / pi


def _wrapped_sql(d: str) -> str:
    return f"CASE WHEN {d} < -0.5::DOUBLE THEN {d} + 1.0::DOUBLE WHEN {d} > 0.5::DOUBLE THEN {d} - 1.0::DOUBLE ELSE {d} END"


_WRAP = f"""w AS (SELECT t.body_id, s.body_id AS other, t.src AS tsrc, s.src, {', '.join(f'{_wrapped_sql(f"(t.{a} - s.{a})")} AS d{a}' for a in AX)} FROM b t, b s),
v AS (SELECT w.*, dx * dx + dy * dy + dz * dz AS r2 FROM w)"""
_NEAR = f"WITH {B.SQL['b3c']}, {_WRAP}"
for _n in ("join_neighbor_range",):
    add(_n, lambda spark, sf_dir: (lambda b: E.pairs_within(b, b, CUTOFF, CYCLE, ("body_id", "other")))(B.b3c(spark, sf_dir)), f"{_NEAR} SELECT body_id, other FROM v WHERE r2 > 0 AND r2 < 0.09::DOUBLE")
add("flt_cutoff", lambda spark, sf_dir: (lambda b: rounded(E.counted(b, 0.15, CYCLE), "body_id", "n"))(B.b3c(spark, sf_dir)),
    f"{_NEAR} SELECT body_id, COUNT(*) AS n, ROUND(MAX(r2), 6) + 0.0 AS furthest FROM v WHERE r2 > 0 AND r2 < 0.15::DOUBLE * 0.15::DOUBLE GROUP BY body_id")
_RS = f"(SQRT(r2) * {ALPHA}::DOUBLE)"
_FORCE = f"src * (1.1283791670955126::DOUBLE * EXP(-rs * rs) / (rs * rs) + tail / (rs * rs * rs)) * {ALPHA ** 3}::DOUBLE"
add("agg_ewald_real", lambda spark, sf_dir: (lambda b: rounded(E.ewald_real(b, b, ALPHA, CUTOFF, CYCLE), "body_id"))(B.b3c(spark, sf_dir)),
    f"{_NEAR}, rr AS (SELECT *, {_RS} AS rs FROM v WHERE r2 > 0 AND r2 < 0.09::DOUBLE), ee AS (SELECT *, {S.erfc('rs')} AS tail FROM rr), d AS (SELECT body_id, SUM(src * tail / rs * {ALPHA}::DOUBLE) AS pot, {', '.join(f'SUM(-d{a} * ({_FORCE})) AS acc_{a}' for a in AX)} FROM ee GROUP BY body_id) SELECT body_id, {_r()} FROM d")
_WAVES = f"kw AS (SELECT kx, ky, kz FROM (SELECT UNNEST(range(0, {KSIZE + 1})) AS kx), (SELECT UNNEST(range(-{KSIZE}, {KSIZE + 1})) AS ky), (SELECT UNNEST(range(-{KSIZE}, {KSIZE + 1})) AS kz) WHERE kx * kx + ky * ky + kz * kz <= {KSIZE * KSIZE} AND NOT (kx = 0 AND ky < 0) AND NOT (kx = 0 AND ky = 0 AND kz < 1))"
add("agg_ewald_waves", lambda spark, sf_dir: E.waves(spark, KSIZE), f"WITH {_WAVES} SELECT CAST(kx AS INTEGER) AS kx, CAST(ky AS INTEGER) AS ky, CAST(kz AS INTEGER) AS kz FROM kw")
_TH = f"((kx * x + ky * y + kz * z) * {2 * pi!r}::DOUBLE)"
_DFT = f"WITH {B.SQL['b3c']}, {_WAVES}, f AS (SELECT kx, ky, kz, SUM(src * COS({_TH})) AS re, SUM(src * SIN({_TH})) AS im FROM b, kw GROUP BY kx, ky, kz)"
add("agg_ewald_dft", lambda spark, sf_dir: rounded(E.structure_factors(B.b3c(spark, sf_dir), KSIZE, CYCLE), "kx", "ky", "kz"), f"{_DFT} SELECT CAST(kx AS INTEGER) AS kx, CAST(ky AS INTEGER) AS ky, CAST(kz AS INTEGER) AS kz, {_r(('re', 'im'))} FROM f")
_K2 = "(kx * kx + ky * ky + kz * kz)"
_FACTOR = f"({0.5 / pi / pi / SIGMA / CYCLE!r}::DOUBLE * EXP(-{_K2} * {(2 * pi) ** 2 / (4 * ALPHA * ALPHA)!r}::DOUBLE) / {_K2})"
_WAVE_SUM = f"{_DFT}, d AS (SELECT body_id, SUM({_FACTOR} * (re * COS({_TH}) + im * SIN({_TH}))) AS pot, {', '.join(f'SUM(-{_FACTOR} * (re * SIN({_TH}) - im * COS({_TH})) * k{a} * {2 * pi!r}::DOUBLE) AS acc_{a}' for a in AX)} FROM b, f GROUP BY body_id) SELECT body_id, {_r()} FROM d"
for _n in ("agg_ewald_idft", "agg_ewald_wave"):
    add(_n, lambda spark, sf_dir: (lambda b: rounded(E.ewald_wave(b, b, KSIZE, ALPHA, SIGMA, CYCLE), "body_id"))(B.b3c(spark, sf_dir)), _WAVE_SUM)
add("agg_ewald_self", lambda spark, sf_dir: rounded(E.ewald_self(B.b3c(spark, sf_dir), ALPHA).select("body_id", "pot"), "body_id"), f"WITH {B.SQL['b3c']} SELECT body_id, ROUND(-{E.TWO_OVER_ROOT_PI * ALPHA!r}::DOUBLE * src, 6) + 0.0 AS pot FROM b")
add("agg_dipole", lambda spark, sf_dir: rounded(E.dipole(B.b3c(spark, sf_dir)), "n"), f"WITH {B.SQL['b3c']} SELECT {', '.join(f'ROUND(SUM({a} * src), 6) + 0.0 AS d{a}' for a in AX)}, COUNT(*) AS n FROM b")
_C = 4 * pi / 3
add("agg_dipole_correct", lambda spark, sf_dir: rounded(E.dipole_correction(B.b3c(spark, sf_dir), CYCLE), "body_id"),
    f"WITH {B.SQL['b3c']}, s AS (SELECT SUM(x * src) AS dx, SUM(y * src) AS dy, SUM(z * src) AS dz, COUNT(*) AS n FROM b) SELECT body_id, ROUND(-{_C!r}::DOUBLE * (dx * dx + dy * dy + dz * dz) / n / src, 6) + 0.0 AS pot, {', '.join(f'ROUND(-{_C!r}::DOUBLE * d{a}, 6) + 0.0 AS acc_{a}' for a in AX)} FROM b, s")


def _types(spark: SparkSession) -> DataFrame:
    i, j = F.col("id") % 10, F.floor(F.col("id") / 10)
    return spark.range(100).select(i.cast("int").alias("ti"), j.cast("int").alias("tj"), (F.lit(40.0) + i + j).alias("rscale"), (F.lit(0.1) * (i + j + 1)).alias("gscale"), (F.lit(0.2) * (i + j + 1)).alias("fgscale"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.b3c(spark, sf_dir).withColumn("atype", (F.col("src") + 4.5).cast("int"))


_ON, _OFF = 0.04, 0.09
_T = "(CAST(tsrc + 4.5 AS INTEGER) + CAST(src + 4.5 AS INTEGER))"
_LJ = f"""u AS (SELECT body_id, other, dx, dy, dz, r2, 0.1::DOUBLE * ({_T} + 1) AS gs, 0.2::DOUBLE * ({_T} + 1) AS fgs, 1.0::DOUBLE / (r2 * (40.0::DOUBLE + {_T})) AS i2,
 (0.3::DOUBLE * 0.3::DOUBLE - r2) / POWER(0.3::DOUBLE * 0.3::DOUBLE - 0.2::DOUBLE * 0.2::DOUBLE, 3) AS t1 FROM {{of}}),
u2 AS (SELECT u.*, i2 * i2 * i2 AS i6, t1 * (0.3::DOUBLE * 0.3::DOUBLE - r2) * (0.3::DOUBLE * 0.3::DOUBLE - 3 * 0.2::DOUBLE * 0.2::DOUBLE + 2 * r2) AS t2 FROM u),
lj AS (SELECT body_id, dx, dy, dz, gs * i6 * (i6 - 1) * CASE WHEN r2 > 0.2::DOUBLE * 0.2::DOUBLE THEN t2 ELSE 1 END AS p,
 fgs * CASE WHEN r2 > 0.2::DOUBLE * 0.2::DOUBLE THEN i6 * (i6 - 1) * 12 * (0.2::DOUBLE * 0.2::DOUBLE - r2) * t1 - 6 * i6 * (i6 + (i6 - 1) * t2) * t2 / r2 ELSE i2 * i6 * (2 * i6 - 1) END AS f FROM u2)"""
# close pairs make sums of any size: results are compared to nine digits of the largest
_VDW = f"{_NEAR}, {_LJ.format(of='v WHERE r2 > 0 AND r2 < 0.3::DOUBLE * 0.3::DOUBLE')}"
_SIGN = "SELECT body_id, " + ", ".join(f"ROUND(SIGN({e}) * LN(1 + ABS({e})), 6) + 0.0 AS {n}" for n, e in (("pot", "{s}SUM(p)"), *((f"acc_{a}", f"{{s}}SUM(-d{a} * f)") for a in AX))) + " FROM lj GROUP BY body_id"


def logs(df: DataFrame) -> DataFrame:
    """Signed logarithms of sums that range over many orders."""
    return df.select("body_id", *((F.round(F.signum(c) * F.ln(1 + F.abs(c)), 6) + 0.0).alias(c) for c in KINDS))


add("agg_vdw", lambda spark, sf_dir: (lambda b: logs(E.vanderwaals(b, b, _types(spark), CUTON, CUTOFF, CYCLE)))(_typed(spark, sf_dir)), f"{_VDW} {_SIGN.format(s='')}")
# of every second body only, over all pairs
add("agg_direct_vdw", lambda spark, sf_dir: (lambda b: logs(api.direct_vanderwaals(b.where("body_id % 2 = 1"), b, _types(spark), CUTON, CUTOFF, CYCLE)))(_typed(spark, sf_dir)), f"{_VDW} {_SIGN.format(s='')}".replace("FROM lj GROUP", "FROM lj WHERE body_id % 2 = 1 GROUP"))
add("join_type_params", lambda spark, sf_dir: (lambda b: E.with_parameters(E.pairs_within(b, b, 0.1, CYCLE, ("body_id", "other", "atype_t", "atype_s")), rounded(_types(spark), "ti", "tj")).select("body_id", "other", "rscale", "gscale", "fgscale"))(_typed(spark, sf_dir)),
    f"{_NEAR} SELECT body_id, other, ROUND(40.0::DOUBLE + {_T}, 6) + 0.0 AS rscale, ROUND(0.1::DOUBLE * ({_T} + 1), 6) + 0.0 AS gscale, ROUND(0.2::DOUBLE * ({_T} + 1), 6) + 0.0 AS fgscale FROM v WHERE r2 > 0 AND r2 < 0.01::DOUBLE")


def _excluded(b: DataFrame) -> DataFrame:
    """Pairs of equal type at most two ids apart."""
    pairs = b.select("body_id", "atype", F.explode(F.array(*(F.lit(i) for i in (-2, -1, 1, 2)))).alias("o")).select("body_id", (F.col("body_id") + F.col("o")).alias("other"), "atype")
    return pairs.join(b.select(F.col("body_id").alias("other"), "atype"), ["other", "atype"]).select("body_id", "other")


_EX = f"{_NEAR}, x AS (SELECT * FROM v WHERE src = tsrc AND ABS(body_id - other) BETWEEN 1 AND 2 AND r2 > 0)"
add("join_exclusion", lambda spark, sf_dir: (lambda b: rounded(E.coulomb_exclusion(b, _excluded(b), CYCLE), "body_id"))(_typed(spark, sf_dir)),
    f"{_EX}, d AS (SELECT body_id, SUM(-src / SQRT(r2)) AS pot, {', '.join(f'SUM(d{a} * src / (SQRT(r2) * r2)) AS acc_{a}' for a in AX)} FROM x GROUP BY body_id) SELECT body_id, {_r()} FROM d")
add("join_exclusion_vdw", lambda spark, sf_dir: (lambda b: logs(E.vanderwaals_exclusion(b, _excluded(b), _types(spark), CUTON, CUTOFF, CYCLE)))(_typed(spark, sf_dir)),
    f"{_EX}, {_LJ.format(of='x WHERE r2 < 0.3::DOUBLE * 0.3::DOUBLE')} {_SIGN.format(s='-')}")
_ALL = f"{_NEAR}, d AS (SELECT body_id, SUM(src / SQRT(r2)) AS pot, {', '.join(f'SUM(-d{a} * src / (SQRT(r2) * r2)) AS acc_{a}' for a in AX)} FROM v WHERE r2 > 0 GROUP BY body_id)"


def _coulomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.b3c(spark, sf_dir)
    return rounded(E.coulomb(b, b, 10.0, CYCLE), "body_id")


add("agg_direct_coulomb", _coulomb, f"{_ALL} SELECT body_id, {_r()} FROM d")
add("join_periodic_images", lambda spark, sf_dir: rounded(E.with_images(B.b3(spark, sf_dir), 1, CYCLE).select("body_id", "ix", "iy", "iz", *AX), "body_id", "ix", "iy", "iz"),
    f"WITH {B.SQL['b3']} SELECT body_id, CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iy, CAST(l AS INTEGER) AS iz, ROUND(x + i, 6) + 0.0 AS x, ROUND(y + j, 6) + 0.0 AS y, ROUND(z + l, 6) + 0.0 AS z FROM b, (SELECT UNNEST(range(-1, 2)) AS i), (SELECT UNNEST(range(-1, 2)) AS j), (SELECT UNNEST(range(-1, 2)) AS l)")


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per owner: bodies as first dealt by id and as owned by their place, and its leaves and cells."""
    t = tree_of(spark, sf_dir)
    heads = P.heads(t.bodies.select("key"), K3, 8)
    ranks = spark.range(8).select(F.col("id").cast("int").alias("rank"))
    counted = lambda df, name: df.groupBy("rank").agg(F.count("*").alias(name))
    out = ranks.join(counted(t.bodies.select(F.pmod("body_id", F.lit(8)).cast("int").alias("rank")), "before"), "rank", "left")
    for name, df in (("after", t.bodies), ("leaves", t.leaves()), ("cells", t.cells)):
        out = out.join(counted(P.owned(df.select("key"), heads), name), "rank", "left")
    return out.na.fill(0)


_RANKS = f"WITH {S.tree('b3', 16)}, {_HEADS}, own AS (SELECT 'after' AS what, MAX(rank) AS rank FROM (SELECT ROW_NUMBER() OVER () AS n, key FROM k) k JOIN h ON h.head <= k.key GROUP BY n UNION ALL SELECT CASE WHEN c.is_leaf THEN 'leaf' ELSE 'cell' END, MAX(rank) FROM cells c JOIN h ON h.head <= c.key GROUP BY c.key, c.is_leaf)"
add("agg_load_balance", _load, f"{_RANKS} SELECT CAST(r AS INTEGER) AS rank, (SELECT COUNT(*) FROM b WHERE body_id % 8 = r) AS before, (SELECT COUNT(*) FROM own WHERE what = 'after' AND rank = r) AS after, (SELECT COUNT(*) FROM own WHERE what = 'leaf' AND rank = r) AS leaves, (SELECT COUNT(*) FROM own WHERE what <> 'after' AND rank = r) AS cells FROM (SELECT UNNEST(range(0, 8)) AS r)")


# expansions in solid harmonics are the Cartesian ones of the same order in fewer numbers
def _harmonics(kind: str):
    return lambda spark, sf_dir: rounded(SH.with_harmonics(B.b3(spark, sf_dir), 3, kind).select("body_id", *(F.col(part)[n * n + n + m].alias(f"{part}{n}{m}") for n in range(3) for m in range(n + 1) for part in ("re", "im"))), "body_id")


_RHO = "SQRT(x * x + y * y)"
_REGULAR = {"00": ("1.0::DOUBLE", "0.0::DOUBLE"), "10": ("-z", "0.0::DOUBLE"), "11": ("x / 2", "y / 2"), "20": ("(2 * z * z - x * x - y * y) / 4", "0.0::DOUBLE"), "21": ("-z * x / 2", "-z * y / 2"), "22": ("(x * x - y * y) / 8", "x * y / 4")}
_ANGLE = {"00": ("0.0::DOUBLE", "0.0::DOUBLE"), "10": (_RHO, "0.0::DOUBLE"), "11": (f"z * x / {_RHO} / 2", f"z * y / {_RHO} / 2"), "20": (f"-1.5::DOUBLE * z * {_RHO}", "0.0::DOUBLE"), "21": (f"-(z * z - x * x - y * y) * x / {_RHO} / 2", f"-(z * z - x * x - y * y) * y / {_RHO} / 2"), "22": (f"z * (x * x - y * y) / {_RHO} / 4", f"z * x * y / {_RHO} / 2")}
_SINGULAR = {"00": ("1 / r", "0.0::DOUBLE"), "10": ("-z / POWER(r, 3)", "0.0::DOUBLE"), "11": ("x / POWER(r, 3)", "y / POWER(r, 3)"), "20": ("(3 * z * z - r * r) / POWER(r, 5)", "0.0::DOUBLE"), "21": ("-3 * z * x / POWER(r, 5)", "-3 * z * y / POWER(r, 5)"), "22": ("3 * (x * x - y * y) / POWER(r, 5)", "6 * x * y / POWER(r, 5)")}
for _n, _kind, _forms in (("sph_eval_multipole", "regular", _REGULAR), ("sph_eval_multipole_theta", "by_angle", _ANGLE), ("sph_eval_local", "singular", _SINGULAR)):
    add(_n, _harmonics(_kind), f"WITH {B.SQL['b3']}, p AS (SELECT *, SQRT(x * x + y * y + z * z) AS r FROM b) SELECT body_id, " + ", ".join(f"ROUND({e}, 6) + 0.0 AS {part}{nm}" for nm, both in _forms.items() for part, e in zip(("re", "im"), both)) + " FROM p")


def _spherical(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    if part == "m2p":
        return rounded(X.by_multipoles(t, V.by_bodies(t, 0.8).far, 4, rules=SPHERICAL), "body_id")
    if part == "far":
        return rounded(X.far_field(t, V.dual(t, 0.4).far, X.ORDER, rules=SPHERICAL), "body_id")
    return rounded(X.fast_multipole(t, V.dual(t, 0.4), X.ORDER, rules=SPHERICAL), "body_id", digits=5)


add("sph_m2p", lambda spark, sf_dir: _spherical(spark, sf_dir, "m2p"), SQL["agg_m2p"])
add("sph_far", lambda spark, sf_dir: _spherical(spark, sf_dir, "far"), SQL["agg_fmm_down"])
add("sph_fmm", lambda spark, sf_dir: _spherical(spark, sf_dir, "all"), SQL["fmm"])


def _sph_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At order 10, errors against direct sums: whether they are within the gate, and what the direct sums are."""
    b = B.b3(spark, sf_dir)
    want = K.direct(b, b)
    gate = verify(api.laplace(b, ncrit=16, order=10, rules=SPHERICAL), want, 5e-3).select("good")
    return want.agg(F.count("*").alias("bodies"), (F.round(F.sum(F.col("pot") * F.col("pot")), 0) + 0.0).alias("pot2")).crossJoin(gate)


add("sph_gate", _sph_gate, f"WITH {B.SQL['b3']}, {direct_sql(0.0)} SELECT COUNT(*) AS bodies, ROUND(SUM(pot * pot), 0) + 0.0 AS pot2, TRUE AS good FROM d")

# Cartesian terms: powers over factorials, and derivatives of 1/r
_T20, _T10 = S.multi(4), S.multi(3)


def _terms(rule, order: int, digits: int):
    """A rule of expansions over each body's own vector."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = rule(np.stack([b.column(a).to_numpy() for a in AX], axis=1), order)
        return pa.RecordBatch.from_arrays([b.column("body_id"), pa.array(list(rows))], names=["body_id", "t"])

    return lambda spark, sf_dir: rounded(M.map_batches(B.b3(spark, sf_dir).select("body_id", *AX), batch, "body_id long, t array<double>").select("body_id", *(F.col("t")[i].alias(f"t{i}") for i in range(len(X.indices(order))))), "body_id", digits=digits)


add("cart_terms", _terms(X.powers, 4, 8), f"WITH {B.SQL['b3']} SELECT body_id, " + ", ".join(f"ROUND({S.monomial(AX, a)}, 8) + 0.0 AS t{i}" for i, a in enumerate(_T20)) + " FROM b")
add("cart_uniform", _terms(X.derivatives, 5, 4), f"WITH {B.SQL['b3']}, p AS (SELECT *, x * x + y * y + z * z AS r2 FROM b) SELECT body_id, " + ", ".join(f"ROUND({S.inverse_r(a, AX)}, 4) + 0.0 AS t{i}" for i, a in enumerate(S.multi(5))) + " FROM p")


def _periodic_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's local expansion from the images beyond the nearest, of two levels."""
    t = tree_of(spark, sf_dir, "b3c")
    return rounded(X.periodic_local(t, CYCLE, 2, 4).select("key", *(F.col("l")[i].alias(f"l{i}") for i in range(20))), "key")


_AT4 = {a: i for i, a in enumerate(S.multi(4))}
_BEYOND = "far AS (SELECT -(3 * a + d) * 1.0::DOUBLE AS rx, -(3 * b + e) * 1.0::DOUBLE AS ry, -(3 * c + f) * 1.0::DOUBLE AS rz FROM " + ", ".join(f"(SELECT UNNEST(range(-1, 2)) AS {v})" for v in "abcdef") + " WHERE a <> 0 OR b <> 0 OR c <> 0)"
_ROOT = ", ".join(f"SUM(k.src * {S.monomial(('(g.cx - k.x)', '(g.cy - k.y)', '(g.cz - k.z)'), a)}) AS m{i}" for a, i in _AT4.items())
_L4 = ", ".join("ROUND(SUM(" + " + ".join(f"m{j} * d{_AT4[S._plus(a, b)]}" for b, j in _AT4.items() if S._plus(a, b) in _AT4) + f"), 6) + 0.0 AS l{i}" for a, i in _AT4.items())
add("agg_periodic_m2l", _periodic_local, f"WITH {S.tree('b3c', 16)}, {S.geometry()}, {_BEYOND}, m AS (SELECT {_ROOT} FROM k, g WHERE g.key = 0), q AS (SELECT *, rx * rx + ry * ry + rz * rz AS r2 FROM far, m), fd AS (SELECT *, {', '.join(f'{S.inverse_r(a)} AS d{i}' for a, i in _AT4.items())} FROM q) SELECT 0::BIGINT AS key, {_L4} FROM fd")
