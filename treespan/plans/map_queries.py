"""Queries of functions over bodies, cells and pairs: each calls a verb of operators.mapping with a function of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.operators import mapping as M
from treespan.operators import traverse as V
from treespan.operators import tree as T
from treespan.plans import sql as S
from treespan.plans.force_queries import AX, rounded
from treespan.plans.registry import add
from treespan.plans.tree_queries import _LOCAL, _owned_tree, tree_of
from treespan.sources import bodies as B

_TREE = f"WITH {S.tree('b3', 16)}"
_GEO = f"{_TREE}, {S.geometry()}"


def _under(cell: str, below: str = "k") -> str:
    """Whether what has a finer key lies under a cell, in SQL."""
    return f"({below}.key >> {S.below(f'({cell}.key & 31)')}) = ({cell}.key >> {S.below(f'({cell}.key & 31)')})"


def _squared(a: M.At, b: M.At, names: tuple[str, ...] = AX, other: tuple[str, ...] | None = None) -> Column:
    return sum(((a(x) - b(y)) * (a(x) - b(y)) for x, y in zip(names, other or names)), F.lit(0.0))


CENTRE = ("cx", "cy", "cz")


def _map_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each body is from its leaf's centre, times its strength."""
    return rounded(M.map_bodies(tree_of(spark, sf_dir), lambda body, cell: {"off": body("src") * F.sqrt(_squared(body, cell, AX, CENTRE))}), "body_id")


add("map_bodies", _map_bodies, f"{_GEO} SELECT k.body_id, ROUND(k.src * SQRT({' + '.join(f'(k.{a} - g.c{a}) * (k.{a} - g.c{a})' for a in AX)}), 6) + 0.0 AS off FROM g JOIN k ON {_under('g')} WHERE g.is_leaf")
add("map_subcells", lambda spark, sf_dir: M.map_subcells(tree_of(spark, sf_dir), lambda parent, child: {"children": F.count("*"), "nb": F.sum(child("nb")), "most": F.max(child("nb"))}),
    f"{_TREE} SELECT parent AS key, COUNT(*) AS children, CAST(SUM(nb) AS BIGINT) AS nb, MAX(nb) AS most FROM cells WHERE parent >= 0 GROUP BY parent")


def _map_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height above the leaves, and leaves under each cell: no sum over bodies."""
    return M.upward(tree_of(spark, sf_dir), lambda body: {"height": F.max(F.lit(0)), "leaves": F.max(F.lit(1).cast("long"))}, lambda parent, child: {"height": F.max(child("height")) + 1, "leaves": F.sum(child("leaves"))})


add("map_cell", _map_cell, f"{_TREE} SELECT c.key, MAX(l.depth) - c.depth AS height, COUNT(*) AS leaves FROM cells c JOIN cells l ON l.is_leaf AND l.depth >= c.depth AND {_under('c', 'l')} GROUP BY c.key, c.depth")


def _locals(spark: SparkSession, sf_dir: str) -> tuple[T.Tree, DataFrame, DataFrame]:
    """The tree, its cells with owners, and the strength under each cell."""
    t = tree_of(spark, sf_dir)
    return t, _owned_tree(spark, sf_dir), M.reduce(t, lambda body: {"mass": body("src")})


def _map_up_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength under each cell that one owner has alone."""
    _, marked, mass = _locals(spark, sf_dir)
    return rounded(marked.where("local").select("key", F.col("owner").cast("int").alias("owner")).join(mass, "key"), "key", "owner")


def _map_up_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of each cell that several owners share, from the roots of what they have alone."""
    t, marked, mass = _locals(spark, sf_dir)
    roots = T.local_roots(marked).select("key").join(mass, "key")
    up = roots.select(F.explode(t.keys.ancestors(F.col("key"), include_self=False)).alias("key"), "mass")
    return rounded(up.groupBy("key").agg(F.sum("mass").alias("mass"), F.count("*").alias("roots")), "key", "roots")


add("map_up_local", _map_up_local, f"{_LOCAL} SELECT m.key, CAST(m.owner AS INTEGER) AS owner, ROUND(SUM(k.src), 6) + 0.0 AS mass FROM marked m JOIN k ON {_under('m')} WHERE m.local GROUP BY m.key, m.owner")
add("map_up_global", _map_up_global, f"{_LOCAL}, rm AS (SELECT r.key, SUM(k.src) AS mass FROM roots r JOIN k ON {_under('r')} GROUP BY r.key) SELECT m.key, ROUND(SUM(rm.mass), 6) + 0.0 AS mass, COUNT(*) AS roots FROM marked m JOIN rm ON {_under('m', 'rm')} WHERE NOT m.local GROUP BY m.key")


def _map_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of all cells above each, and how far its centre is from the root's."""
    t = tree_of(spark, sf_dir)
    root = lambda cell: {"above": F.lit(0).cast("long"), "x": cell("cx"), "own": cell("nb")}
    down = M.downward(t, root, lambda parent, child: {"above": parent("above") + parent("own"), "x": parent("x"), "own": child("nb")})
    return rounded(down.join(t.with_geometry().select("key", "cx"), "key").select("key", "above", (F.col("cx") - F.col("x")).alias("off")), "key", "above")


add("map_down", lambda spark, sf_dir: _map_down(spark, sf_dir), f"{_GEO} SELECT c.key, CAST(COALESCE(SUM(a.nb), 0) AS BIGINT) AS above, ROUND(c.cx - r.cx, 6) + 0.0 AS off FROM g c JOIN g r ON r.key = 0 LEFT JOIN cells a ON a.depth < c.depth AND {_under('a', 'c')} GROUP BY c.key, c.cx, r.cx")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    return t.with_geometry()


def _map_product2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances of the leaves' centres from those of the root's children."""
    g = _cells(spark, sf_dir)
    return rounded(M.product(g.where("is_leaf"), g.where("depth = 1"), lambda a, b: {"i": a("key"), "j": b("key"), "d2": _squared(a, b, CENTRE)}), "i", "j")


def _map_product1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of bodies in pairs of cells of one parent, each pair of cells once."""
    c = tree_of(spark, sf_dir).cells.where("parent >= 0")
    return M.product(c, c, lambda a, b: {"i": a("key"), "j": b("key"), "pairs": a("nb") * b("nb")}, ["parent"], "key")


_D2 = " + ".join(f"(p.c{a} - q.c{a}) * (p.c{a} - q.c{a})" for a in AX)
add("map_product2", _map_product2, f"{_GEO} SELECT p.key AS i, q.key AS j, ROUND({_D2}, 6) + 0.0 AS d2 FROM g p, g q WHERE p.is_leaf AND q.depth = 1")
add("map_product1", _map_product1, f"{_TREE} SELECT p.key AS i, q.key AS j, p.nb * q.nb AS pairs FROM cells p JOIN cells q ON q.parent = p.parent AND p.key <= q.key WHERE p.parent >= 0")


def _map_product_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the bodies of near leaves: how many there are, and the sum of their strengths over 1 + r^2."""
    t = tree_of(spark, sf_dir)
    fn = lambda a, b: {"others": F.count("*"), "sum": F.sum(b("src") / (F.lit(1.0) + _squared(a, b)))}
    return rounded(M.map_pairs(t, V.dual(t, 0.8).near, fn), "body_id", "others")


_LF = f"lf AS (SELECT k.body_id, k.x, k.y, k.z, k.src, c.key AS leaf FROM k JOIN cells c ON c.is_leaf AND c.nb > 0 AND {_under('c')})"
_R2 = " + ".join(f"(s.{a} - t.{a}) * (s.{a} - t.{a})" for a in AX)
add("map_product_bodies", _map_product_bodies, f"WITH RECURSIVE {S.tree('b3', 16)}, {S.geometry()}, {S.dual(0.8)}, {_LF} SELECT t.body_id, COUNT(*) AS others, ROUND(SUM(s.src / (1 + {_R2})), 6) + 0.0 AS sum FROM pairs p JOIN lf t ON t.leaf = p.i JOIN lf s ON s.leaf = p.j WHERE p.state = 'near' GROUP BY t.body_id")


def _map_cell_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the dual traversal by a rule of one's own: far where the distance is over three times the greater radius."""
    p = V.dual(tree_of(spark, sf_dir), accept=lambda d2, a, b: d2 > F.lit(9.0) * F.greatest(a, b) * F.greatest(a, b))
    return p.far.select("i", "j", F.lit("far").alias("state")).union(p.near.select("i", "j", F.lit("near").alias("state")))


_RULE = S.dual(0.5).replace("(a.r / 0.5::DOUBLE + b.r / 0.5::DOUBLE) * (a.r / 0.5::DOUBLE + b.r / 0.5::DOUBLE)", "9.0::DOUBLE * GREATEST(a.r, b.r) * GREATEST(a.r, b.r)")
add("map_cell_pair", _map_cell_pair, f"WITH RECURSIVE {S.tree('b3', 16)}, {S.geometry()}, {_RULE} SELECT i, j, state FROM pairs WHERE state <> 'split'")


def _map_pair_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell with the children of its siblings."""
    c = tree_of(spark, sf_dir).cells.where("parent >= 0").select("key", "parent", "nb")
    aunts = c.select(F.col("key").alias("aunt"), F.col("parent").alias("up"))
    nieces = c.join(aunts, F.col("parent") == F.col("aunt")).select("key", "nb", F.col("up").alias("parent"), "aunt")
    return M.product(c, nieces, lambda a, b: {"i": a("key"), "j": b("key"), "aunt": b("aunt"), "pairs": a("nb") * b("nb")}, ["parent"]).where("i <> aunt").drop("aunt")


add("map_pair_overloads", _map_pair_overloads, f"{_TREE} SELECT a.key AS i, n.key AS j, a.nb * n.nb AS pairs FROM cells a JOIN cells b ON b.parent = a.parent AND b.key <> a.key JOIN cells n ON n.parent = b.key WHERE a.parent >= 0")


def _merged(columns, op):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(M.reduce(tree_of(spark, sf_dir), columns, op), "key")

    return run


for _n, _value, _op, _sql in (
    ("map_reduce", lambda body: {"most": body("x") * body("src")}, F.max, "ROUND(MAX(k.x * k.src), 6) + 0.0 AS most"),
    ("reduce", lambda body: {"least_y": body("y"), "least_z": body("z")}, F.min, "ROUND(MIN(k.y), 6) + 0.0 AS least_y, ROUND(MIN(k.z), 6) + 0.0 AS least_z"),
    ("accumulate", lambda body: {"total": body("src") * body("src"), "n": F.lit(1.0)}, F.sum, "ROUND(SUM(k.src * k.src), 6) + 0.0 AS total, CAST(COUNT(*) AS DOUBLE) AS n"),
):
    add(_n, _merged(_value, _op), f"{_TREE} SELECT c.key, {_sql} FROM cells c JOIN k ON {_under('c')} GROUP BY c.key")


def _map_gpu_body1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch function over bodies."""

    def scaled(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("body_id"), pc.multiply(b.column("x"), b.column("src"))], names=["body_id", "v"])

    return rounded(M.map_batches(B.b3(spark, sf_dir).select("body_id", "x", "src"), scaled, "body_id long, v double"), "body_id")


def _within(skip_self: bool):
    """Per body a sum over the bodies of its leaf, itself included or not, by arrays of a leaf."""

    def of(rows: pa.Table) -> pa.Table:
        at = np.stack([rows.column(a).to_numpy() for a in AX], axis=1)
        src = rows.column("src").to_numpy()
        r2 = ((at[:, None] - at[None]) ** 2).sum(axis=2)
        terms = src[None] / (r2 + 1e-3)
        if skip_self:
            np.fill_diagonal(terms, 0.0)
        return pa.table({"body_id": rows.column("body_id"), "v": terms.sum(axis=1)})

    return lambda spark, sf_dir: rounded(M.map_leaves(tree_of(spark, sf_dir), of, "body_id long, v double"), "body_id", digits=5)


add("map_gpu_body1", _map_gpu_body1, f"WITH {B.SQL['b3']} SELECT body_id, ROUND(x * src, 6) + 0.0 AS v FROM b")
_WITHIN = f"{_TREE}, {_LF} SELECT t.body_id, ROUND(SUM(CASE WHEN {{when}} THEN s.src / ({_R2} + 1e-3::DOUBLE) ELSE 0 END), 5) + 0.0 AS v FROM lf t JOIN lf s ON s.leaf = t.leaf GROUP BY t.body_id"
add("map_gpu_body2", _within(False), _WITHIN.format(when="TRUE"))
add("map_cpu_mock", _within(True), _WITHIN.format(when="s.body_id <> t.body_id"))


def _map_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the plane, children before parents: the mean place of the bodies under each cell, by merging counts and means."""
    leaf = lambda body: {"n": F.count(body("body_id")).cast("double"), "mx": F.coalesce(F.avg(body("x")), F.lit(0.0)), "my": F.coalesce(F.avg(body("y")), F.lit(0.0))}

    def merge(parent: M.At, child: M.At) -> M.Columns:
        mean = lambda c: F.coalesce(F.try_divide(F.sum(child(c) * child("n")), F.sum(child("n"))), F.lit(0.0))
        return {"n": F.sum(child("n")), "mx": mean("mx"), "my": mean("my")}

    got = M.upward(tree_of(spark, sf_dir, "b2", 64), leaf, merge)
    return rounded(got.select("key", "n", (F.col("mx") * F.sqrt(F.lit(2.0))).alias("mx"), (F.col("my") * F.sqrt(F.lit(2.0))).alias("my")), "key")


_B2 = f"(k.key >> {S.below('c.depth', 2)}) = (c.key >> {S.below('c.depth', 2)})"
add("map_py", _map_py, f"WITH {S.tree('b2', 64, 2)}, h AS (SELECT {S.prefix('key', 'd', 2)} AS key, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my FROM k, (SELECT UNNEST(range(0, 30)) AS d) GROUP BY 1) SELECT c.key, CAST(COALESCE(n, 0) AS DOUBLE) AS n, ROUND(COALESCE(mx, 0) * SQRT(2.0::DOUBLE), 6) + 0.0 AS mx, ROUND(COALESCE(my, 0) * SQRT(2.0::DOUBLE), 6) + 0.0 AS my FROM cells c LEFT JOIN h ON h.key = c.key")
add("map_c", lambda spark, sf_dir: rounded(M.map_cells(tree_of(spark, sf_dir, "parts", 64), lambda cell: {"dense": F.ln(F.lit(1.0) + cell("nb") / (cell("w0") * cell("w0") * cell("w0")))}), "key"),
    f"WITH {S.tree('parts', 64)}, {S.geometry()} SELECT key, ROUND(LN(1.0::DOUBLE + nb / (s0 * s0 * s0)), 6) + 0.0 AS dense FROM g")
