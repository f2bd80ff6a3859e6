"""Cartesian expansions of 1/r: multipoles, local expansions and their shifts, over Arrow batches.

A cell's multipole has a coefficient for each multi-index of degree below the order. With s a source and c the centre,
M[a] = sum q (c - s)^a / a!; a local expansion gives the potential sum L[b] (x - c)^b / b!.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespan.operators.traverse import Interactions
from treespan.operators.tree import AXES, Tree
from treespan.operators.kernels import near_field

ORDER = 6


@lru_cache
def indices(order: int) -> tuple[tuple[int, int, int], ...]:
    """Multi-indices of degree below `order`, by degree."""
    every = product(range(order), repeat=3)
    return tuple(sorted((a for a in every if sum(a) < order), key=lambda a: (sum(a), tuple(-x for x in a))))


def _fact(a: tuple[int, ...]) -> int:
    return factorial(a[0]) * factorial(a[1]) * factorial(a[2])


@lru_cache
def _positions(order: int) -> dict[tuple[int, ...], int]:
    return {a: i for i, a in enumerate(indices(order))}


def powers(d: np.ndarray, order: int) -> np.ndarray:
    """d^a / a! for rows d of three coordinates: (rows, terms)."""
    one = np.ones((len(d), order, 3))
    for n in range(1, order):
        one[:, n] = one[:, n - 1] * d / n
    return np.stack([one[:, a, 0] * one[:, b, 1] * one[:, c, 2] for a, b, c in indices(order)], axis=1)


def derivatives(r: np.ndarray, order: int) -> np.ndarray:
    """The derivatives of 1/|r| by all multi-indices of degree below `order`: (rows, terms).

    With t = D / a!, the degree n obeys n r^2 t[a] + (2n - 1) sum r_i t[a - e_i] + (n - 1) sum t[a - 2 e_i] = 0.
    """
    at = _positions(order)
    r2 = (r * r).sum(axis=1)
    t = np.zeros((len(r), len(at)))
    t[:, 0] = 1 / np.sqrt(r2)
    for a, i in at.items():
        n = sum(a)
        if n:
            s = np.zeros(len(r))
            for k in range(3):
                if a[k] > 0:
                    s += (2 * n - 1) * r[:, k] * t[:, at[tuple(a[m] - (m == k) for m in range(3))]]
                if a[k] > 1:
                    s += (n - 1) * t[:, at[tuple(a[m] - 2 * (m == k) for m in range(3))]]
            t[:, i] = -s / (n * r2)
    return t * np.array([_fact(a) for a in indices(order)])


@lru_cache
def _sums(order: int) -> tuple[tuple[int, int, int], ...]:
    """(a, b, a + b) for all with |a| + |b| below the order."""
    at = _positions(order)
    return tuple((i, j, at[s]) for a, i in at.items() for b, j in at.items() if (s := tuple(x + y for x, y in zip(a, b))) in at)


def m2l(m: np.ndarray, r: np.ndarray, order: int) -> np.ndarray:
    """Local coefficients at a centre r beyond the multipoles' centres."""
    d = derivatives(r, order)
    out = np.zeros_like(m)
    for i, j, s in _sums(order):
        out[:, j] += m[:, i] * d[:, s]
    return out


def m2m(m: np.ndarray, d: np.ndarray, order: int) -> np.ndarray:
    """Multipoles about a centre that lies d beyond their own."""
    p = powers(d, order)
    out = np.zeros_like(m)
    for i, j, s in _sums(order):
        out[:, s] += m[:, i] * p[:, j]
    return out


def l2l(c: np.ndarray, d: np.ndarray, order: int) -> np.ndarray:
    """Local expansions about a centre that lies d beyond their own."""
    p = powers(d, order)
    out = np.zeros_like(c)
    for i, j, s in _sums(order):
        out[:, i] += c[:, s] * p[:, j]
    return out


def m2p(m: np.ndarray, r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Potential and gradient of multipoles at points r beyond their centres."""
    d = derivatives(r, order + 1)
    pot = (m * d[:, : m.shape[1]]).sum(axis=1)
    up = _positions(order + 1)
    grad = np.stack([sum(m[:, i] * d[:, up[tuple(a[n] + (n == k) for n in range(3))]] for i, a in enumerate(indices(order))) for k in range(3)], axis=1)
    return pot, grad


def l2p(c: np.ndarray, d: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Potential and gradient of local expansions at points d beyond their centres."""
    p = powers(d, order)
    pot = (c * p).sum(axis=1)
    at = _positions(order)
    grad = np.zeros((len(c), 3))
    for a, i in at.items():
        for k in range(3):
            if a[k]:
                grad[:, k] += c[:, i] * p[:, at[tuple(a[n] - (n == k) for n in range(3))]]
    return pot, grad


def _cartesian_p2m(q: np.ndarray, d: np.ndarray, order: int) -> np.ndarray:
    return q[:, None] * powers(d, order)


@dataclass(frozen=True)
class Rules:
    """Coefficients and shifts of one kind of expansion, over arrays of one row a cell or body.

    p2m takes strengths and vectors from source to centre, m2m and l2l the vector to the new centre, m2l that from the
    multipole's centre to the local one, m2p and l2p that from the centre to the point.
    """

    terms: Callable[[int], int]
    p2m: Callable
    m2m: Callable
    m2l: Callable
    l2l: Callable
    l2p: Callable
    m2p: Callable


CARTESIAN = Rules(lambda order: len(indices(order)), _cartesian_p2m, m2m, m2l, l2l, l2p, m2p)


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)


def _vector(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    return np.stack([batch.column(f"{prefix}{a}").to_numpy() for a in AXES], axis=1)


def _as_arrays(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def _summed(df: DataFrame, by: str, name: str, terms: int) -> DataFrame:
    """Element-wise sums of an array column, as plain sums that combine before the shuffle."""
    flat = df.groupBy(by).agg(*(F.sum(F.col(name)[i]).alias(f"__{i}") for i in range(terms)))
    return flat.select(by, F.array(*(f"__{i}" for i in range(terms))).alias(name))


def _centre(tree: Tree, key: Column, prefix: str) -> dict[str, Column]:
    depth = tree.keys.depth(key)
    return {f"{prefix}{a}": F.lit(tree.box.low[i]) + (tree.keys.index_fast(key, i) + 0.5) * (F.lit(tree.box.width[i]) / F.pow(F.lit(2.0), depth)) for i, a in enumerate(AXES)}


def p2m(tree: Tree, order: int = ORDER) -> DataFrame:
    """(key, m) of each leaf with bodies: sums of column expressions."""
    b = tree.bodies_in_leaves().withColumns(_centre(tree, F.col("leaf"), "c"))
    one = {}
    for a in AXES:
        one[a] = [F.lit(1.0)]
        for n in range(1, order):
            one[a].append(one[a][-1] * (F.col(f"c{a}") - F.col(a)) / float(n))
    terms = [F.sum(F.col("src") * one["x"][i] * one["y"][j] * one["z"][k]).alias(f"__{n}") for n, (i, j, k) in enumerate(indices(order))]
    return b.groupBy(F.col("leaf").alias("key")).agg(*terms).select("key", F.array(*(f"__{n}" for n in range(len(terms)))).alias("m"))


def leaf_multipoles(tree: Tree, order: int, rules: Rules) -> DataFrame:
    """(key, m) of each leaf with bodies by the rules' own p2m, batch by batch: a batch sends one row for each leaf."""
    b = tree.bodies_in_leaves().withColumns(_centre(tree, F.col("leaf"), "c"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            leaf = b.column("leaf").to_numpy()
            by = np.argsort(leaf, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], leaf[by][1:] != leaf[by][:-1]])) if len(by) else by
            m = rules.p2m(b.column("src").to_numpy(), _vector(b, "c") - _vector(b, ""), order)[by]
            if len(by):
                yield pa.RecordBatch.from_arrays([pa.array(leaf[by][first]), _as_arrays(np.add.reduceat(m, first, axis=0))], names=["key", "m"])

    return _summed(b.select("leaf", "src", *AXES, *(f"c{a}" for a in AXES)).mapInArrow(run, "key long, m array<double>"), "key", "m", rules.terms(order))


def multipoles(tree: Tree, order: int = ORDER, rules: Rules = CARTESIAN) -> DataFrame:
    """(key, m) of every cell with bodies: each leaf's multipole is shifted straight to all its ancestors, then summed."""
    leaves = p2m(tree, order) if rules is CARTESIAN else leaf_multipoles(tree, order, rules)
    up = leaves.select(F.col("key").alias("leaf"), "m", F.explode(tree.keys.ancestors(F.col("key"))).alias("key"))
    up = up.withColumns(_centre(tree, F.col("leaf"), "a") | _centre(tree, F.col("key"), "b"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("key"), _as_arrays(rules.m2m(_array(b, "m"), _vector(b, "b") - _vector(b, "a"), order))], names=["key", "m"])

    return _summed(up.mapInArrow(run, "key long, m array<double>"), "key", "m", rules.terms(order))


def locals_(tree: Tree, far: DataFrame, order: int = ORDER, sources: Tree | None = None, rules: Rules = CARTESIAN) -> DataFrame:
    """(key, l) of every target cell of the far pairs."""
    sources = sources or tree
    m = multipoles(sources, order, rules)
    pairs = far.join(m.select(F.col("key").alias("j"), "m"), "j").withColumns(_centre(tree, F.col("i"), "a") | _centre(sources, F.col("j"), "b"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("i"), _as_arrays(rules.m2l(_array(b, "m"), _vector(b, "a") - _vector(b, "b"), order))], names=["key", "l"])

    return _summed(pairs.mapInArrow(run, "key long, l array<double>"), "key", "l", rules.terms(order))


def leaf_locals(tree: Tree, local: DataFrame, order: int = ORDER, rules: Rules = CARTESIAN) -> DataFrame:
    """(key, l) of the leaves: each ancestor's local expansion is shifted straight to the leaf, then summed."""
    leaves = tree.leaves().where("nb > 0").select(F.col("key").alias("leaf"), F.explode(tree.keys.ancestors(F.col("key"))).alias("key"))
    down = leaves.join(local, "key").withColumns(_centre(tree, F.col("leaf"), "a") | _centre(tree, F.col("key"), "b"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("leaf"), _as_arrays(rules.l2l(_array(b, "l"), _vector(b, "a") - _vector(b, "b"), order))], names=["key", "l"])

    return _summed(down.mapInArrow(run, "key long, l array<double>"), "key", "l", rules.terms(order))


def _evaluated(rows: DataFrame, name: str, rule, order: int, by: str = "body_id") -> DataFrame:
    """Rule over rows of coefficients, a centre cx.. and a point x..: body_id, pot, acc_x..; kinds as in kernels.laplace."""
    kind = rows.schema[by].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            pot, grad = rule(_array(b, name), _vector(b, "") - _vector(b, "c"), order)
            yield pa.RecordBatch.from_arrays([b.column(by), pa.array(pot), *(pa.array(grad[:, k]) for k in range(3))], names=[by, "pot", "acc_x", "acc_y", "acc_z"])

    return rows.select(by, name, *AXES, *(f"c{a}" for a in AXES)).mapInArrow(run, f"{by} {kind}, pot double, acc_x double, acc_y double, acc_z double")


def far_field(tree: Tree, far: DataFrame, order: int = ORDER, sources: Tree | None = None, rules: Rules = CARTESIAN) -> DataFrame:
    return at_bodies(tree, locals_(tree, far, order, sources, rules), order, rules)


def at_bodies(tree: Tree, local: DataFrame, order: int = ORDER, rules: Rules = CARTESIAN) -> DataFrame:
    """Potentials and gradients at the bodies from cells' local expansions (key, l)."""
    leaves = leaf_locals(tree, local, order, rules)
    rows = tree.bodies_in_leaves().join(leaves.withColumnRenamed("key", "leaf"), "leaf").withColumns(_centre(tree, F.col("leaf"), "c"))
    return _evaluated(rows, "l", rules.l2p, order)


def by_multipoles(tree: Tree, far: DataFrame, order: int = ORDER, targets: DataFrame | None = None, rules: Rules = CARTESIAN) -> DataFrame:
    """Potentials of far pairs (body, cell) straight from the cells' multipoles."""
    t = (tree.bodies if targets is None else targets).select(F.col("body_id").alias("i"), *AXES)
    m = multipoles(tree, order, rules).withColumnRenamed("key", "j")
    rows = far.join(t, "i").join(m, "j").withColumnRenamed("i", "body_id").withColumns(_centre(tree, F.col("j"), "c"))
    return added(_evaluated(rows, "m", rules.m2p, order))


def added(*parts: DataFrame) -> DataFrame:
    """Sums by body."""
    names = ("pot", "acc_x", "acc_y", "acc_z")
    every = parts[0].select("body_id", *names)
    for p in parts[1:]:
        every = every.union(p.select("body_id", *names))
    return every.groupBy("body_id").agg(*(F.sum(n).alias(n) for n in names))


def fast_multipole(tree: Tree, pairs: Interactions, order: int = ORDER, sources: Tree | None = None, rules: Rules = CARTESIAN) -> DataFrame:
    """body_id, pot, acc_x.. of all pairs of traverse.dual."""
    return added(far_field(tree, pairs.far, order, sources, rules), near_field(tree, pairs.near, sources))


def periodic_local(tree: Tree, cycle: float, levels: int, order: int = ORDER, rules: Rules = CARTESIAN) -> DataFrame:
    """(key, l) of the root: what the tree's images beyond the nearest 27 do, out to `levels` levels.

    A level takes the 26 neighbours of a block of 3 x 3 x 3 images, image by image; the block then is the next
    level's image. With one level or none, nothing is beyond. The root's multipole, one row, comes to the driver.
    """
    got = multipoles(tree, order, rules).where("key = 0").select("m").collect()
    m = np.array(got[0].m if got else [0.0] * rules.terms(order))[None]
    out = np.zeros_like(m)
    block = np.array(list(product((-1.0, 0.0, 1.0), repeat=3)))
    for _ in range(levels - 1):
        beyond = np.array([3 * far + near for far in block if far.any() for near in block]) * cycle
        out += rules.m2l(np.repeat(m, len(beyond), axis=0), -beyond, order).sum(axis=0, keepdims=True)
        m = rules.m2m(np.repeat(m, len(block), axis=0), -block * cycle, order).sum(axis=0, keepdims=True)
        cycle *= 3
    return tree.cells.sparkSession.createDataFrame([(0, [float(x) for x in out[0]])], "key long, l array<double>")
