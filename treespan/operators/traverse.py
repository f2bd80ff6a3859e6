"""Hierarchical joins: pairs of cells, or of bodies and cells, refined level by level until accepted or at leaves.

Each round is one DataFrame expression over the frontier; cells are broadcast only while few. What a round leaves
for the next is written to the shared folder, so lineage stays one round long. Bodies go down in groups: rounds find
the cells that a group may look at, then a task walks each of its bodies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespan.operators.tree import AXES, Tree, build_tree
from treespan.plans.lineage import BROADCAST_ROWS, materialize, small

#: Cells count as this much wider than they are where cells of two trees are compared.
LEEWAY = 1.00001
#: Pairs that the driver goes on to before tasks do, and pairs that a task splits at once.
SEEDS = 2048
WALKED = 1024
#: Target bodies that go down a tree with the same cells, at most and at least (as long as there are several tasks).
GROUP, LEAST_GROUP = 4096, 256
#: Trees of so few cells go to each group whole.
FEW = 16_384
#: Pairs of bodies and cells that a task goes on with at once.
MOST_PAIRS = 1 << 18
#: What is sent to all tasks in each round of a loop counts as so many times its rows.
SENT_OFTEN = 10


@dataclass
class Interactions:
    """Pairs (i, j) of target and source: far ones, taken as wholes, and near ones, taken body by body."""

    far: DataFrame
    near: DataFrame


def cell_radius(tree: Tree, cells: DataFrame) -> DataFrame:
    """Adds r, half the greatest width with leeway."""
    widths = [F.col(f"w{i}") for i in range(tree.dim)]
    return tree.with_geometry(cells).withColumn("r", F.greatest(*widths) / 2 * LEEWAY)


def far_by_radii(theta: float) -> Callable[[Column, Column, Column], Column]:
    """Accepts (squared distance, r_i, r_j) if the distance is above the radii over theta."""
    return lambda d2, a, b: d2 > (a / theta + b / theta) * (a / theta + b / theta)


def dual(tree: Tree, theta: float = 0.4, accept: Callable[[Column, Column, Column], Column] | None = None, sources: Tree | None = None, mutual: bool = False) -> Interactions:
    """Pairs of cells of the tree (and of `sources`, by default itself) that cover each ordered pair of bodies once.

    A pair is far if `accept` says so; near if both are leaves; else the source is split if the target is a leaf,
    the target if the source is a leaf or isn't larger, else the source. With `mutual` each unordered pair of one
    tree's cells is looked at once and both orders are returned: the pairs cover the same pairs of bodies.

    Small trees are walked by tasks that have all cells; larger ones, and rules of one's own, go by joins round by round.
    """
    few = max(tree.n_cells, (sources or tree).n_cells) <= BROADCAST_ROWS
    if accept is None and not mutual and few:
        return _walked(tree, sources or tree, far_by_radii(theta))
    accept = accept or far_by_radii(theta)
    dim = tree.dim
    side = lambda t, s: small(cell_radius(t, t.cells).select(F.col("key").alias(s), F.col("is_leaf").alias(f"leaf_{s}"), F.col("r").alias(f"r_{s}"), *(F.col(f"c{a}").alias(f"{a}_{s}") for a in AXES[:dim])), t.n_cells)
    ci, cj = side(tree, "i"), side(sources or tree, "j")
    spark = tree.cells.sparkSession
    frontier = spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    rounds = []
    children = lambda k: F.transform(F.sequence(F.lit(0), F.lit(tree.keys.fan - 1)), lambda n: tree.keys.child(k, n))
    d2 = sum(((F.col(f"{a}_i") - F.col(f"{a}_j")) * (F.col(f"{a}_i") - F.col(f"{a}_j")) for a in AXES[:dim]), F.lit(0.0))
    # which child lies where is known by its key, but children without bodies may not be there
    while True:
        seen = frontier.join(ci, "i").join(cj, "j")
        state = F.when(accept(d2, F.col("r_i"), F.col("r_j")), "far").when(F.col("leaf_i") & F.col("leaf_j"), "near").otherwise("split")
        split_i = F.when(F.col("leaf_j"), F.lit(True)).when(F.col("leaf_i"), F.lit(False)).otherwise(F.col("r_i") >= F.col("r_j"))
        done = materialize(seen.select("i", "j", state.alias("state"), split_i.alias("split_i")))
        rounds.append(done.where("state <> 'split'").select("i", "j", "state"))
        rest = done.where("state = 'split'")
        if rest.isEmpty():
            break
        pair = lambda a, b: F.struct(a.alias("i"), b.alias("j"))
        by_i = F.transform(children(F.col("i")), lambda c: pair(c, F.col("j")))
        by_j = F.transform(children(F.col("j")), lambda c: pair(F.col("i"), c))
        nxt = F.when(F.col("split_i"), by_i).otherwise(by_j)
        if mutual and sources is None:
            both = F.filter(F.flatten(F.transform(children(F.col("i")), lambda a: F.transform(children(F.col("j")), lambda b: pair(a, b)))), lambda p: p["i"] <= p["j"])
            nxt = F.when(F.col("i") == F.col("j"), both).otherwise(nxt)
        frontier = rest.select(F.inline(nxt))
    pairs = rounds[0]
    for r in rounds[1:]:
        pairs = pairs.union(r)
    if mutual and sources is None:
        pairs = pairs.union(pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "state"))
    return Interactions(pairs.where("state = 'far'").select("i", "j"), pairs.where("state = 'near'").select("i", "j"))


class Cells:
    """The cells of a small tree as arrays; the children of one follow each other in `child`."""

    def __init__(self, tree: Tree):
        axes = AXES[: tree.dim]
        rows = cell_radius(tree, tree.cells).orderBy("depth", "key").select("key", "parent", "is_leaf", "r", *(f"c{a}" for a in axes)).toArrow()
        get = lambda n: rows.column(n).to_numpy()
        self.key, self.leaf, self.r = get("key"), get("is_leaf"), get("r")
        self.centre = [get(f"c{a}") for a in axes]
        by_key = np.argsort(self.key)
        up = by_key[np.searchsorted(self.key[by_key], get("parent")[1:])]  # of all but the root, which is first
        self.child = np.argsort(up, kind="stable") + 1
        self.count = np.bincount(up, minlength=len(self.key))
        self.first = np.cumsum(self.count) - self.count

    def children(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `at` each child is of, and the children."""
        n = self.count[at]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(at)), n), self.child[np.repeat(self.first[at], n) + steps]


def _step(a: Cells, b: Cells, accept: Callable, i: np.ndarray, j: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """The far and the near among pairs, and what the others are split into."""
    d2 = np.zeros(len(i))
    for x, y in zip(a.centre, b.centre):
        d2 += (x[i] - y[j]) * (x[i] - y[j])
    far = accept(d2, a.r[i], b.r[j])
    near = ~far & a.leaf[i] & b.leaf[j]
    rest = ~far & ~near
    split_i = rest & (b.leaf[j] | (~a.leaf[i] & (a.r[i] >= b.r[j])))
    split_j = rest & ~split_i
    of_i, down_i = a.children(i[split_i])
    of_j, down_j = b.children(j[split_j])
    return (i[far], j[far]), (i[near], j[near]), (np.concatenate([down_i, i[split_j][of_j]]), np.concatenate([j[split_i][of_i], down_j]))


def _walked(tree: Tree, sources: Tree, accept: Callable) -> Interactions:
    """dual where both trees are few cells, which go to all tasks: the driver splits the first pairs, tasks the others."""
    spark = tree.cells.sparkSession
    a = Cells(tree)
    b = a if sources is tree else Cells(sources)
    done: list[tuple[np.ndarray, np.ndarray, int]] = []
    todo = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while 0 < len(todo[0]) < SEEDS:
        far, near, todo = _step(a, b, accept, *todo)
        done += [(*far, 0), (*near, 1)]
    held = spark.sparkContext.broadcast((a, b))  # at most BROADCAST_ROWS rows of a few numbers each

    def rows(found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        a, b = held.value
        i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        state = np.concatenate([np.full(len(f[0]), f[2], np.int32) for f in found] or [np.zeros(0, np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(a.key[i], pa.int64()), pa.array(b.key[j], pa.int64()), pa.array(state, pa.int32())], names=["i", "j", "state"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = held.value
        for part in parts:
            i, j = (part.column(k).to_numpy() for k in (0, 1))
            stack = [(i[k : k + WALKED], j[k : k + WALKED]) for k in range(0, len(i), WALKED)]
            found: list[tuple[np.ndarray, np.ndarray, int]] = []
            while stack:
                i, j = stack.pop()
                if len(i) > 256 * WALKED:  # so that what is held stays small
                    half = len(i) // 2
                    stack += [(i[:half], j[:half]), (i[half:], j[half:])]
                    continue
                far, near, more = _step(a, b, accept, i, j)
                found += [(*far, 0), (*near, 1)]
                if len(more[0]):
                    stack.append(more)
                if sum(len(f[0]) for f in found) > 256 * WALKED:
                    yield rows(found)
                    found = []
            yield rows(found)

    schema = "i long, j long, state int"
    early = spark.createDataFrame(pa.Table.from_batches([rows(done)]))
    pairs = early.select(F.col("i"), F.col("j"), F.col("state").cast("int").alias("state"))
    if len(todo[0]):
        seeds = spark.createDataFrame(pa.table({"i": todo[0], "j": todo[1]})).repartition(2 * spark.sparkContext.defaultParallelism)
        pairs = pairs.union(seeds.mapInArrow(run, schema))
    pairs = materialize(pairs)
    return Interactions(pairs.where("state = 0").select("i", "j"), pairs.where("state = 1").select("i", "j"))


def in_sight(tree: Tree, theta: float, targets: DataFrame, cells: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of up to some thousand target bodies that lie near each other, with all cells that one of them may look at.

    Columns are arrays: ids and the axes, and of the cells key, parent, is_leaf, w, c and an axis, and `more`. `cells`
    has these, none empty. A cell that is far from all of a group's box is not opened, so what a group gets grows with
    the group and the depth of the tree, not with the number of cells.
    """
    axes = AXES[: tree.dim]
    spark = tree.cells.sparkSession
    n = targets.count()
    size = min(GROUP, max(LEAST_GROUP, n // (8 * spark.sparkContext.defaultParallelism)))
    groups = build_tree(targets.select("body_id", *axes), size, tree.dim, emit_empty=False)
    inside = groups.bodies_in_leaves()
    # more bodies at one place than a group may have go in parts that see the same
    parts = small(groups.leaves().where("nb > 0").select(F.col("key").alias("leaf"), F.ceil(F.col("nb") / size).alias("__parts")), groups.n_cells)
    part = F.pmod(F.xxhash64("body_id"), F.col("__parts"))
    bodies = inside.join(parts, "leaf").groupBy("leaf", part.alias("part")).agg(F.collect_list(F.struct(F.col("body_id").alias("ids"), *axes)).alias("__rows"))
    bodies = bodies.select("leaf", *(F.col("__rows")[c].alias(c) for c in ("ids", *axes)))
    held = ["key", "parent", "is_leaf", "w", *(f"c{a}" for a in axes), *more]
    if tree.n_cells <= FEW:
        view = cells.agg(F.collect_list(F.struct(*held)).alias("__cells"))
        rows = bodies.crossJoin(F.broadcast(view))
    else:
        rows = bodies.join(_views(tree, theta, inside, cells.select(*held)), "leaf")
    rows = rows.select(*bodies.columns, *(F.col("__cells")[c].alias(f"cell_{c}") for c in held))
    tasks = max(1, min(groups.n_cells, max(4 * spark.sparkContext.defaultParallelism, groups.n_cells // 4)))
    return rows.repartition(tasks, "leaf", F.col("ids")[0])


def _views(tree: Tree, theta: float, inside: DataFrame, cells: DataFrame) -> DataFrame:
    """(leaf, __cells): for each group of bodies the cells that one of them may look at, found round by round."""
    axes, held = AXES[: tree.dim], cells.columns
    boxes = materialize(inside.groupBy("leaf").agg(*(f(a).alias(f"{name}_{a}") for a in axes for name, f in (("lo", F.min), ("hi", F.max)))), few_files=True)
    box = [c for c in boxes.columns if c != "leaf"]
    # sent to all tasks once a round, so only if very few
    looked = small(cells, tree.n_cells * SENT_OFTEN)
    gaps = [F.greatest(F.col(f"lo_{a}") - F.col(f"c{a}"), F.col(f"c{a}") - F.col(f"hi_{a}"), F.lit(0.0)) for a in axes]
    near = F.sqrt(sum((g * g for g in gaps), F.lit(0.0))) * (1 - 1e-9)
    frontier = boxes.withColumn("key", F.lit(0).cast("long"))
    rounds = []
    while True:
        met = frontier.join(looked, "key")
        done = materialize(met.withColumn("open", ~F.col("is_leaf") & ~F.coalesce(F.col("w") < theta * near, F.lit(False))))
        rounds.append(done.select("leaf", *held))
        rest = done.where("open")
        if rest.isEmpty():
            break
        frontier = rest.select("leaf", *box, F.explode(tree.keys.children(F.col("key"))).alias("key"))
    every = rounds[0]
    for r in rounds[1:]:
        every = every.union(r)
    return every.groupBy("leaf").agg(F.collect_list(F.struct(*held)).alias("__cells"))


class View:
    """The cells that a group of bodies may look at, as arrays; the children of one follow each other in `child`."""

    def __init__(self, batch: pa.RecordBatch, at: int, axes: tuple[str, ...]):
        get = lambda n: batch.column(n)[at].values.to_numpy(zero_copy_only=False)
        self.ids = batch.column("ids")[at].values
        self.x = [get(a) for a in axes]
        key = get("cell_key")
        order = np.lexsort((key, key & 31))  # the root first
        self.cell = lambda name: get(f"cell_{name}")[order]
        self.key, self.leaf, self.w = key[order], self.cell("is_leaf").astype(bool), self.cell("w")
        self.centre = [self.cell(f"c{a}") for a in axes]
        by_key = np.argsort(self.key)
        up = by_key[np.searchsorted(self.key[by_key], self.cell("parent")[1:])]
        self.child = np.argsort(up, kind="stable") + 1
        self.count = np.bincount(up, minlength=len(self.key))
        self.first = np.cumsum(self.count) - self.count

    def walk(self, theta: float, at_once: int = WALKED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of body and cell, and whether the cell is far: down to far cells or leaves, not many at a time."""
        stack = [(np.arange(a, min(a + at_once, len(self.ids))), None) for a in range(0, len(self.ids), at_once)]
        while stack:
            i, j = stack.pop()
            j = np.zeros(len(i), np.int64) if j is None else j
            d2 = np.zeros(len(i))
            for c, x in zip(self.centre, self.x):
                off = c[j] - x[i]
                d2 += off * off
            leaf = self.leaf[j]
            far = ~leaf & (self.w[j] < theta * np.sqrt(d2))
            acts = far | leaf
            if acts.any():
                yield i[acts], j[acts], far[acts]
            i, j = i[~acts], j[~acts]
            if not len(i):
                continue
            n = self.count[j]
            at = np.repeat(self.first[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, j = np.repeat(i, n), self.child[at]
            stack += [(i[k : k + MOST_PAIRS], j[k : k + MOST_PAIRS]) for k in range(0, len(i), MOST_PAIRS)]


def by_bodies(tree: Tree, theta: float = 0.5, targets: DataFrame | None = None, centres: DataFrame | None = None) -> Interactions:
    """For each target body the cells of the tree that act on it: far as a whole, near with their bodies.

    Targets (body_id, x, y(, z)) are the tree's bodies by default. A cell is far if its first width over the
    distance from its centre is below theta; `centres` (key, x, y(, z)) may give other centres. Empty leaves act
    on nothing and are left out.

    Bodies walk in groups, each with the cells that it may look at, so no pair is made but those returned.
    """
    axes = AXES[: tree.dim]
    cells = tree.with_geometry().where("nb > 0").withColumnRenamed("w0", "w")
    if centres is not None:
        cells = cells.drop(*(f"c{a}" for a in axes)).join(centres.select("key", *(F.col(a).alias(f"c{a}") for a in axes)), "key")
    who = tree.bodies if targets is None else targets
    kind = who.schema["body_id"].dataType.simpleString()
    rows = in_sight(tree, theta, who, cells)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(batch.num_rows):
                view = View(batch, at, axes)
                for i, j, far in view.walk(theta):
                    yield pa.RecordBatch.from_arrays([view.ids.take(pa.array(i)), pa.array(view.key[j]), pa.array(far)], names=["i", "j", "far"])

    pairs = materialize(rows.mapInArrow(run, f"i {kind}, j long, far boolean"))
    return Interactions(pairs.where("far").select("i", "j"), pairs.where("not far").select("i", "j"))
