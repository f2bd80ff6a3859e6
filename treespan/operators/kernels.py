"""Sums over pairs of bodies, and of bodies and cells: potentials and their gradients as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespan.operators import pairs
from treespan.operators.traverse import Interactions, View, in_sight
from treespan.operators.tree import AXES, Tree
from treespan.plans.lineage import BROADCAST_ROWS, materialize, small  # noqa: F401 - a test sets BROADCAST_ROWS here

#: Softening of the gravity sums.
EPS2 = 1e-6
#: Bodies of a leaf that are taken together, on average at most.
BLOCK = 128
#: Bodies of a group that a task walks down the tree at once.
WALKED = 1024


def squared(dim: int, a: str = "x", b: str = "t") -> Column:
    """Squared distance of columns x_s.. and x_t.."""
    return sum(((F.col(f"{c}_s") - F.col(f"{c}_t")) * (F.col(f"{c}_s") - F.col(f"{c}_t")) for c in AXES[:dim]), F.lit(0.0))


def laplace(acting: DataFrame, dim: int = 3, eps2: float = 0.0, strength: str = "src_s", by: str = "body_id") -> DataFrame:
    """Per target: pot, the sum of q / r, and acc_x.., that of q (source - target) / r^3; pairs of distance 0 count not.

    With `eps2` distances are softened, and coincident pairs count with the potential q / sqrt(eps2).
    """
    r2 = squared(dim) + F.lit(eps2)
    paired = acting.withColumn("__r2", r2)
    inv = F.lit(1.0) / F.sqrt(F.col("__r2"))
    ok = F.col("__r2") != 0
    q = F.col(strength)
    terms = {"pot": F.when(ok, q * inv).otherwise(0.0)}
    for a in AXES[:dim]:
        terms[f"acc_{a}"] = F.when(ok, (F.col(f"{a}_s") - F.col(f"{a}_t")) * inv * inv * inv * q).otherwise(0.0)
    return paired.select(by, *(t.alias(n) for n, t in terms.items())).groupBy(by).agg(*(F.sum(n).alias(n) for n in terms))


def _side(bodies: DataFrame, side: str, dim: int, *more: str) -> DataFrame:
    return bodies.select(*more, *(F.col(a).alias(f"{a}_{side}") for a in AXES[:dim]))


def direct(targets: DataFrame, sources: DataFrame, dim: int = 3, eps2: float = 0.0, order: tuple[str, ...] = ("body_id",)) -> DataFrame:
    """All pairs, block by block, in a written table: the number of pairs is quadratic, but no row is made for one.

    As laplace. Blocks are cut in an order of the bodies' columns.
    """
    axes = AXES[:dim]
    missing = F.lit(False)
    for a in axes:
        missing = missing | F.col(a).isNull()
    said = {"src": F.coalesce("src", F.lit(0.0))}
    s = pairs.blocks(sources.where(~missing).withColumns(said), (*axes, "src"), order)
    t = s if targets is sources else pairs.blocks(targets.where(~missing).withColumn("src", F.lit(0.0)), (*axes, "src"), order)
    names = ("pot", *(f"acc_{a}" for a in axes))
    sums = pairs.sums(t, None if t is s else s, pairs.laplace(eps2), (*names, "met"))
    # bodies without a place have pairs, but nothing to add up
    return sums.select("body_id", *names).union(targets.where(missing).select("body_id", *(F.lit(0.0) for _ in names)))


def moments(tree: Tree) -> DataFrame:
    """(key, mass, x, y(, z)) of each cell: total strength and its centre, one sum over all ancestors of the leaves' sums.

    Cells without bodies or of no strength have no centre.
    """
    sums = {"mass": F.col("src"), "count": F.lit(1).cast("long")} | {a: F.col(a) * F.col("src") for a in AXES[: tree.dim]}
    leaf = tree.bodies_in_leaves().select("leaf", *(v.alias(n) for n, v in sums.items())).groupBy("leaf").agg(*(F.sum(n).alias(n) for n in sums))
    up = leaf.select(F.explode(tree.keys.ancestors(F.col("leaf"))).alias("key"), *sums).groupBy("key").agg(*(F.sum(n).alias(n) for n in sums))
    return up.select("key", "mass", "count", *(F.try_divide(a, "mass").alias(a) for a in AXES[: tree.dim]))


def barnes_hut(tree: Tree, met: Interactions, targets: DataFrame | None = None, eps2: float = EPS2) -> DataFrame:
    """Softened monopole potentials and accelerations from the pairs of traverse.by_bodies, the self term included."""
    dim = tree.dim
    t = _side(tree.bodies if targets is None else targets, "t", dim, "body_id")
    far = met.far.join(moments(tree).select(F.col("key").alias("j"), F.col("mass").alias("src_s"), *(F.col(a).alias(f"{a}_s") for a in AXES[:dim])), "j")
    near = met.near.join(_side(tree.bodies_in_leaves(), "s", dim, F.col("leaf").alias("j"), F.col("src").alias("src_s")), "j")
    cols = ["i", "src_s", *(f"{a}_s" for a in AXES[:dim])]
    acting = far.select(*cols).union(near.select(*cols)).join(t, F.col("i") == F.col("body_id"))
    return laplace(acting, dim, eps2)


def _blocks(tree: Tree, side: str, values: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    """Bodies of leaves as arrays, about BLOCK at most in a row: leaves of the greatest depth may hold any number."""
    rows = tree.bodies_in_leaves()
    if side == "s":  # sources at one place act as one
        rows = rows.groupBy("leaf", *AXES[: tree.dim]).agg(F.sum("src").alias("src"))
    parts = small(tree.leaves().where("nb > 0").select(F.col("key").alias("leaf"), F.ceil(F.col("nb") / BLOCK).alias("__parts")), tree.n_cells)
    block = F.pmod(F.xxhash64(*by), F.col("__parts"))
    grouped = rows.join(parts, "leaf").groupBy("leaf", block.alias("__block")).agg(F.collect_list(F.struct(*(c.alias(n) for n, c in values.items()))).alias("__rows"))
    return grouped.select(F.col("leaf").alias(f"leaf_{side}"), *(F.col("__rows")[n].alias(n) for n in values))


def near_field(tree: Tree, near: DataFrame, sources: Tree | None = None, eps2: float = 0.0) -> DataFrame:
    """Per body the sums over the bodies of the leaves paired with its own, block by block of two leaves' bodies.

    As laplace: pairs of distance 0 count not, unless softened.
    """
    axes = AXES[: tree.dim]
    t = _blocks(tree, "t", {"body_id": F.col("body_id")} | {f"{a}_t": F.col(a) for a in axes}, ("body_id",))
    s = _blocks(sources or tree, "s", {"src": F.col("src")} | {f"{a}_s": F.col(a) for a in axes}, axes)
    pairs = near.join(t, F.col("i") == F.col("leaf_t")).join(s, F.col("j") == F.col("leaf_s")).drop("i", "j", "leaf_t", "leaf_s")
    names = ["body_id", "pot", *(f"acc_{a}" for a in axes)]

    def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        c = batch.column(name)
        return c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            ids, at_t = column(b, "body_id")
            q, at_s = column(b, "src")
            x_t, x_s = (np.stack([column(b, f"{a}_{side}")[0] for a in axes], axis=1) for side in "ts")
            out = np.zeros((len(ids), 1 + len(axes)))
            for k in range(b.num_rows):
                t, s = slice(at_t[k], at_t[k + 1]), slice(at_s[k], at_s[k + 1])
                d = x_s[None, s] - x_t[t][:, None]
                r2 = (d * d).sum(axis=2) + eps2
                inv = np.divide(1.0, np.sqrt(r2), out=np.zeros_like(r2), where=r2 != 0)
                out[t, 0] = inv @ q[s]
                out[t, 1:] = ((inv**3 * q[s])[:, :, None] * d).sum(axis=1)
            # a body's sums within the batch go as one row
            unique, of = np.unique(ids, return_inverse=True)
            sums = np.zeros((len(unique), out.shape[1]))
            np.add.at(sums, of, out)
            yield pa.RecordBatch.from_arrays([pa.array(unique), *(pa.array(sums[:, i]) for i in range(sums.shape[1]))], names=names)

    kind = tree.bodies.schema["body_id"].dataType.simpleString()
    sums = pairs.mapInArrow(run, f"body_id {kind}, " + ", ".join(f"{n} double" for n in names[1:]))
    return sums.groupBy("body_id").agg(*(F.sum(n).alias(n) for n in names[1:]))


def normalized(sums: DataFrame, bodies: DataFrame) -> DataFrame:
    """Sums that carry each target's own strength, over that strength; null where it is 0."""
    names = [c for c in sums.columns if c != "body_id"]
    return sums.join(bodies.select("body_id", F.col("src").alias("__own")), "body_id").select("body_id", *(F.try_divide(n, "__own").alias(n) for n in names))


def barnes_hut_sums(tree: Tree, theta: float = 0.5, eps2: float = EPS2, targets: DataFrame | None = None) -> DataFrame:
    """barnes_hut over traverse.by_bodies, without a row for each pair.

    Groups of bodies walk down the cells that they may look at, summing as they go; only leaves of several bodies come
    out as pairs.
    """
    axes = AXES[: tree.dim]
    com = moments(tree).select("key", "mass", *(F.col(a).alias(f"m{a}") for a in axes))
    more = ("mass", "nb", *(f"m{a}" for a in axes))
    cells = tree.with_geometry().where("nb > 0").withColumnRenamed("w0", "w").join(com, "key")
    who = (tree.bodies if targets is None else targets).select("body_id", *axes)
    kind = who.schema["body_id"].dataType.simpleString()
    names = ["body_id", "j", "pot", *(f"acc_{a}" for a in axes)]
    rows, at_once = in_sight(tree, theta, who, materialize(cells), more), WALKED

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(batch.num_rows):
                view = View(batch, at, axes)
                n = len(view.ids)
                mass, single, com_at = view.cell("mass"), view.cell("nb") == 1, [view.cell(f"m{a}") for a in axes]
                sums = np.zeros((1 + len(axes), n))
                for i, j, far in view.walk(theta, at_once):
                    acts = far | single[j]
                    a, b = i[acts], j[acts]
                    d = [m[b] - x[a] for m, x in zip(com_at, view.x)]
                    r2 = sum((c * c for c in d), 0.0) + eps2
                    inv = np.divide(1.0, np.sqrt(r2), out=np.zeros_like(r2), where=r2 != 0)
                    for k, term in enumerate((mass[b] * inv, *(mass[b] * inv**3 * c for c in d))):
                        sums[k] += np.bincount(a, term, n)
                    i, j = i[~acts], j[~acts]
                    if len(i):
                        empty = pa.nulls(len(i), pa.float64())
                        yield pa.RecordBatch.from_arrays([view.ids.take(pa.array(i)), pa.array(view.key[j]), *(empty for _ in sums)], names=names)
                yield pa.RecordBatch.from_arrays([view.ids, pa.nulls(n, pa.int64()), *(pa.array(v) for v in sums)], names=names)

    out = materialize(rows.mapInArrow(run, f"body_id {kind}, j long, " + ", ".join(f"{n} double" for n in names[2:])))
    near = out.where("j is not null").select("body_id", "j").join(who.distinct(), "body_id").select("body_id", "j", *(F.col(a).alias(f"{a}_t") for a in axes))
    near = laplace(near.join(_side(tree.bodies_in_leaves(), "s", tree.dim, F.col("leaf").alias("j"), F.col("src").alias("src_s")), "j"), tree.dim, eps2)
    every = out.where("j is null").drop("j").unionByName(near)
    return every.groupBy("body_id").agg(*(F.sum(n).alias(n) for n in names[2:]))
