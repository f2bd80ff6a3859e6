"""What owners of parts of a tree would send each other, as tables of keys."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treespan.functions.geometry import Box, point_distance2, slid_distance2
from treespan.functions.keys import Keys
from treespan.operators.partition import numbered
from treespan.operators.tree import AXES, Tree
from treespan.plans.lineage import materialize, small


def requests(pairs: DataFrame, owner: Column, source_owner: Column) -> DataFrame:
    """(owner, key): source cells of pairs (i, j) that owners of targets need and don't own; expressions over the pairs."""
    return pairs.select(owner.alias("owner"), F.col("j").alias("key"), source_owner.alias("of")).where("owner <> of").select("owner", "key").distinct()


def missing(needed: DataFrame, local: DataFrame) -> DataFrame:
    """(owner, key) needed but not among the local ones."""
    return needed.join(local, ["owner", "key"], "left_anti")


def responses(needed: DataFrame, cells: DataFrame, keys: Keys) -> DataFrame:
    """Each needed key with the deepest cell that is it or lies above it, as `found`."""
    up = needed.withColumn("found", F.explode(keys.ancestors(F.col("key"))))
    known = up.join(small(cells.select(F.col("key").alias("found"))), "found")
    return known.groupBy(*needed.columns).agg(F.max_by("found", keys.depth(F.col("found"))).alias("found"))


def conservative(tree: Tree, boxes: DataFrame, theta: float, nearest: bool = False) -> DataFrame:
    """(box, key): cells that a region may need: those all of whose ancestors are too near to it to stand for their bodies.

    `boxes` (box, lox.., hix..) are few. A cell is near where its radius over theta is not below its distance from
    the box: from the box's centre slid toward it, or with `nearest` from the box's nearest point.
    """
    g = tree.with_geometry()
    r = F.greatest(*(F.col(f"w{i}") for i in range(tree.dim))) / 2 * 1.00001 / theta
    each = g.withColumn("r", r).crossJoin(F.broadcast(boxes))
    box = Box([F.col(f"lo{a}") for a in AXES[: tree.dim]], [F.col(f"hi{a}") for a in AXES[: tree.dim]])
    c = [F.col(f"c{a}") for a in AXES[: tree.dim]]
    d2 = point_distance2(box, c) if nearest else slid_distance2(box, Box(c, c))
    opened = each.select("box", "key", ((d2 <= F.col("r") * F.col("r")) & ~F.col("is_leaf")).alias("opened"))
    up = tree.cells.select("key", F.explode(tree.keys.ancestors(F.col("key"), include_self=False)).alias("above"))
    closed = up.join(opened.where("not opened").select("box", F.col("key").alias("above")), "above").select("box", "key").distinct()
    return each.select("box", "key").join(closed, ["box", "key"], "left_anti")


def graft(roots: DataFrame, keys: Keys) -> DataFrame:
    """Cells (key, parent) of a global tree over roots of local ones."""
    every = roots.select(F.explode(keys.ancestors(F.col("key"))).alias("key")).distinct()
    return every.select("key", F.when(F.col("key") == 0, F.lit(-1).cast("long")).otherwise(keys.parent(F.col("key"))).alias("parent"))


def received(rows: DataFrame, target: str, order: list[str], place: str = "place") -> DataFrame:
    """Rows with their place among those that one target gets, in the given order (sources first): by ranges, not by target."""
    firsts = rows.groupBy(target).agg(F.count("*").alias("__n"))
    before = firsts.select(target, (F.sum("__n").over(Window.orderBy(target)) - F.col("__n")).alias("__first"))
    return numbered(rows, [target, *order], place).join(F.broadcast(before), target).withColumn(place, F.col(place) - F.col("__first")).drop("__first")


def to_all(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """A copy of each row for each target; targets are few."""
    return rows.crossJoin(F.broadcast(targets))


def matrix(pairs: DataFrame, source: str, target: str) -> DataFrame:
    return pairs.groupBy(source, target).agg(F.count("*").alias("rows"))


def _places(tree_keys: Keys, cells: DataFrame) -> DataFrame:
    """(key, x, y, z): cells of a level and their places in its grid, written once, so that no join repeats the bit work of keys."""
    return materialize(cells.select("key", *(tree_keys.index_fast(F.col("key"), k).alias(a) for k, a in enumerate(AXES[: tree_keys.dim]))))


def _beside(at: DataFrame, dim: int, side: int) -> DataFrame:
    """Each row at its place and at those next to it in a grid of `side` a row."""
    axes = AXES[:dim]
    steps = F.array(*(F.struct(*(F.lit(o).alias(a) for a, o in zip(axes, step))) for step in product((-1, 0, 1), repeat=dim)))
    moved = at.withColumn("step", F.explode(steps)).withColumns({a: F.col(a) + F.col("step")[a] for a in axes}).drop("step")
    return moved.where(reduce(lambda p, q: p & q, [F.col(a).between(0, side - 1) for a in axes]))


def neighbours(tree_keys: Keys, cells: DataFrame, level: int) -> DataFrame:
    """(i, j): cells of a level and those next to them, themselves included, by offsets and an equi-join."""
    at = _places(tree_keys, cells)
    near = _beside(at.withColumnRenamed("key", "i"), tree_keys.dim, 1 << level)
    return near.join(at.withColumnRenamed("key", "j"), list(AXES[: tree_keys.dim])).select("i", "j")


def far_lists(tree_keys: Keys, cells: DataFrame, level: int) -> DataFrame:
    """(i, j): children of cells next to a cell's parent that aren't next to the cell. Cells meet by their parents' places."""
    axes = AXES[: tree_keys.dim]
    at = _places(tree_keys, cells)
    side = lambda name: at.select(F.col("key").alias(name), *(F.col(a).alias(name + a) for a in axes), *(F.shiftright(a, 1).alias(a) for a in axes))
    pairs = _beside(side("i"), tree_keys.dim, 1 << (level - 1)).join(side("j"), list(axes))
    return pairs.where(reduce(lambda p, q: p | q, [F.abs(F.col("i" + a) - F.col("j" + a)) > 1 for a in axes])).select("i", "j")
