"""Adaptive trees over bodies, as plain tables.

Bodies get the key of their finest cell. A cell of the tree is a key prefix whose parent holds more than `ncrit`
bodies, so a tree is a count for each prefix and needs no recursion: bodies are first counted in cells of a level
that is fine enough for most, the counts are added up for all levels above in one aggregation, and only bodies in
cells that are still too full go on to finer levels.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespan.functions.keys import Keys
from treespan.plans.lineage import discard, materialize, small

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    """Low corner and widths by axis."""

    low: tuple[float, ...]
    width: tuple[float, ...]


@dataclass
class Tree:
    """Bodies with their `key`, and cells: key, parent (-1 for the root's), depth, is_leaf, nb."""

    keys: Keys
    box: Box
    ncrit: int
    bodies: DataFrame
    cells: DataFrame
    n_cells: int = field(default=0)
    _placed: DataFrame | None = field(default=None, repr=False)

    @property
    def dim(self) -> int:
        return self.keys.dim

    def leaves(self) -> DataFrame:
        return self.cells.where("is_leaf")

    def with_geometry(self, cells: DataFrame | None = None) -> DataFrame:
        """Cells with centre cx, cy(, cz) and width w0, w1(, w2)."""
        cells = self.cells if cells is None else cells
        out = {}
        for i in range(self.dim):
            side = F.lit(self.box.width[i]) / F.pow(F.lit(2.0), F.col("depth"))
            out[f"c{AXES[i]}"] = F.lit(self.box.low[i]) + (self.keys.index_fast(F.col("key"), i) + 0.5) * side
            out[f"w{i}"] = side
        return cells.withColumns(out)

    def bodies_in_leaves(self) -> DataFrame:
        """Bodies with the key of their `leaf`, written once: every sum over the tree's bodies reads it.

        An equi-join on the prefixes between the least and greatest leaf depth.
        """
        if self._placed is None:
            low, high = self.leaves().where("nb > 0").agg(F.min("depth"), F.max("depth")).first()
            if low is None:
                placed = self.bodies.withColumn("leaf", F.lit(None).cast("long")).limit(0)
            elif low == high:
                placed = self.bodies.withColumn("leaf", self.keys.prefix(F.col("key"), low))
            else:
                prefixes = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda d: self.keys.prefix(F.col("key"), d))
                asked = self.bodies.withColumn("leaf", F.explode(prefixes))
                placed = asked.join(small(self.leaves().where("nb > 0").select(F.col("key").alias("leaf")), self.n_cells), "leaf")
            self._placed = materialize(placed)
        return self._placed


def bounding_box(bodies: DataFrame, dim: int = 3, kind: str = "cube") -> Box:
    """One aggregation to the driver: `cube` spans all coordinates alike, `tight` each axis by itself.

    Bodies with a null or NaN coordinate are no bodies; a table without any has the unit box, and a box without
    width gets width 1.
    """
    axes = AXES[:dim]
    got = placed(bodies, dim).agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max)))).first()
    low, high = [got[f"min_{a}"] for a in axes], [got[f"max_{a}"] for a in axes]
    if low[0] is None:
        return Box((0.0,) * dim, (1.0,) * dim)
    if kind == "cube":
        low, high = [min(low)] * dim, [max(high)] * dim
    return Box(tuple(low), tuple((h - l) or 1.0 for l, h in zip(low, high)))


def placed(bodies: DataFrame, dim: int = 3) -> DataFrame:
    good = F.lit(True)
    for a in AXES[:dim]:
        good = good & F.col(a).isNotNull() & ~F.isnan(a)
    return bodies.where(good)


def with_keys(bodies: DataFrame, box: Box, keys: Keys) -> DataFrame:
    anchor = [keys.quantize(F.col(a), F.lit(lo), F.lit(w)) for a, lo, w in zip(AXES, box.low, box.width)]
    # never null: else a join on it would have it computed once more to filter nulls
    return bodies.withColumn("key", F.coalesce(keys.encode(anchor), F.lit(0).cast("long")))


def prefix_counts(finest: DataFrame, keys: Keys, ncrit: int, n: int, max_depth: int) -> DataFrame:
    """(key, nb) of every prefix with bodies down to where counts are at most ncrit, and a few more.

    `finest` is a written table of (key, nb), a row for each key of the deepest level that bodies have.
    """
    out, top, rest = None, 0, finest
    fine = min(max_depth, max(1, ceil(log(max(n, 2) / ncrit, keys.fan))) + 3) if n > ncrit else 0
    while True:
        cells = rest.groupBy(keys.prefix(F.col("key"), fine).alias("key")).agg(F.sum("nb").alias("nb"))
        levels = F.transform(F.sequence(F.lit(top), F.lit(fine)), lambda d: keys.prefix(F.col("key"), d))
        counts = materialize(cells.select(F.explode(levels).alias("key"), "nb").groupBy("key").agg(F.sum("nb").alias("nb")))
        out = counts if out is None else out.union(counts)
        full = counts.where((keys.depth(F.col("key")) == fine) & (F.col("nb") > ncrit)).select(F.col("key").alias("full"))
        if fine == max_depth or (n_full := full.count()) == 0:
            return out
        rest = rest.withColumn("full", keys.prefix(F.col("key"), fine)).join(small(full, n_full), "full", "left_semi").drop("full")
        top, fine = fine + 1, min(max_depth, fine + 4)


def build_tree(bodies: DataFrame, ncrit: int = 16, dim: int = 3, box: Box | str = "cube", emit_empty: bool = True, max_depth: int | None = None) -> Tree:
    """The tree of cells of at most `ncrit` bodies, or of the greatest depth where more share a place.

    With `emit_empty` a split cell has all its children, those without bodies included. A table without bodies has
    a root that is an empty leaf.
    """
    if ncrit < 1:
        raise ValueError("ncrit must be at least 1")
    keys = Keys(dim)
    deepest = keys.max_depth if max_depth is None else min(max_depth, keys.max_depth)
    box = bounding_box(bodies, dim, box) if isinstance(box, str) else box
    keyed = with_keys(placed(bodies, dim), box, keys)
    # bodies are read, encoded and counted once; all else is about their distinct keys
    finest = materialize(keyed.groupBy("key").agg(F.count("*").alias("nb")))
    n = finest.agg(F.sum("nb")).first()[0] or 0
    counts = prefix_counts(finest, keys, ncrit, n, deepest)
    spark = bodies.sparkSession
    depth = keys.depth(F.col("key"))
    split = counts.where((F.col("nb") > ncrit) & (depth < deepest)).select("key")
    below = split.select(F.col("key").alias("parent"), F.explode(keys.children(F.col("key"))).alias("key"))
    below = below.join(counts, "key", "left" if emit_empty else "inner").select("key", "parent", F.coalesce("nb", F.lit(0)).alias("nb"))
    root = spark.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("parent"), F.lit(n).cast("long").alias("nb"))
    cells = root.unionByName(below).select("key", "parent", depth.alias("depth"), ((F.col("nb") <= ncrit) | (depth >= deepest)).alias("is_leaf"), "nb")
    cells = materialize(cells)
    discard(finest)
    return Tree(keys, box, ncrit, keyed, cells, cells.count())


def local_tree(cells: DataFrame, keys: Keys, owner: Column) -> DataFrame:
    """Cells with `ranks`, how many owners the leaves under each have, and `local`, whether it is one.

    `owner` is an expression over a leaf's columns.
    """
    leaves = cells.where("is_leaf").select("key", owner.alias("owner"))
    under = leaves.select(F.explode(keys.ancestors(F.col("key"))).alias("key"), "owner").distinct()
    ranks = under.groupBy("key").agg(F.count("*").alias("ranks"), F.min("owner").alias("owner"))
    return cells.join(ranks, "key").withColumn("local", F.col("ranks") == 1)


def local_roots(marked: DataFrame) -> DataFrame:
    """Local cells whose parent isn't local: the roots of the greatest subtrees of one owner."""
    up = marked.select(F.col("key").alias("parent"), F.col("local").alias("parent_local"))
    return marked.join(up, "parent", "left").where("local and not coalesce(parent_local, false)").drop("parent_local")


def global_tree(leaves: DataFrame, keys: Keys) -> DataFrame:
    """All ancestors, themselves included, of the given keys."""
    return leaves.select(F.explode(keys.ancestors(F.col("key"))).alias("key")).distinct()


def fixed_level(keyed: DataFrame, keys: Keys, level: int) -> DataFrame:
    """Cells (key, depth, nb) from the leaves of one level up."""
    leaves = keyed.groupBy(keys.prefix(F.col("key"), level).alias("key")).agg(F.count("*").alias("nb"))
    up = F.transform(F.sequence(F.lit(0), F.lit(level)), lambda d: keys.prefix(F.col("key"), d))
    cells = leaves.select(F.explode(up).alias("key"), "nb").groupBy("key").agg(F.sum("nb").alias("nb"))
    return cells.select("key", keys.depth(F.col("key")).alias("depth"), "nb")


def complete_region(x: int, y: int, keys: Keys) -> list[int]:
    """The fewest cells that cover what lies between the cells x and y, both left out, in order of keys."""
    below = lambda d: keys.dim * (keys.max_depth - d) + DEPTH
    span = lambda k: (k >> DEPTH << DEPTH, (k >> DEPTH << DEPTH) + (1 << below(k & 31)))
    low, high = span(x)[1], span(y)[0]
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        a, b = span(k)
        if b <= low or a >= high:
            continue
        if low <= a and b <= high:
            out.append(k)
        elif k & 31 < keys.max_depth:
            todo += [(k + 1) | i << below((k & 31) + 1) for i in range(keys.fan)]
    return sorted(out)


DEPTH = 5
