"""Functions of one's own over trees: what to compute at bodies, at cells on the way up or down, and for pairs.

Such a function gets, for each thing that it looks at, a lookup of columns by name (`cell("nb")`), and returns named
columns. It is called once, to make the plan; Spark then evaluates its columns for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespan.operators.tree import Tree
from treespan.plans.lineage import discard, materialize, small

#: A lookup of columns by name.
At = Callable[[str], Column]
Columns = dict[str, Column]


def _at(prefix: str = "") -> At:
    return lambda name: F.col(prefix + name)


def _as(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _named(columns: Columns) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def map_bodies(tree: Tree, fn: Callable[[At, At], Columns]) -> DataFrame:
    """(body_id, the columns of fn(body, cell)): each body with the leaf that holds it, geometry included."""
    leaves = small(_as(tree.with_geometry(tree.leaves().where("nb > 0")), "cell_"), tree.n_cells)
    rows = tree.bodies_in_leaves().join(leaves, F.col("leaf") == F.col("cell_key"))
    return rows.select("body_id", *_named(fn(_at(), _at("cell_"))))


def map_cells(tree: Tree, fn: Callable[[At], Columns]) -> DataFrame:
    """(key, the columns of fn(cell))."""
    return tree.with_geometry().select("key", *_named(fn(_at())))


def map_subcells(tree: Tree, fn: Callable[[At, At], Columns]) -> DataFrame:
    """(key, the columns of fn(parent, child)) of each cell that isn't a leaf; fn aggregates over its children."""
    return _merged(tree, tree.with_geometry(), fn)


def _merged(tree: Tree, children: DataFrame, fn: Callable[[At, At], Columns]) -> DataFrame:
    parents = _as(tree.with_geometry(tree.cells.where("not is_leaf")), "parent_")
    rows = _as(children, "child_").join(small(parents, tree.n_cells), F.col("child_parent") == F.col("parent_key"))
    return rows.groupBy(*parents.columns).agg(*_named(fn(_at("parent_"), _at("child_")))).withColumnRenamed("parent_key", "key").drop(*(c for c in parents.columns if c != "parent_key"))


def upward(tree: Tree, leaf: Callable[[At], Columns], merge: Callable[[At, At], Columns]) -> DataFrame:
    """(key, attributes) of every cell, children before parents.

    `leaf(body)` aggregates over a leaf's bodies (over one row of nulls if it has none); `merge(parent, child)`
    aggregates over the children's attributes and geometry and may use the parent's geometry. Both name the same
    columns, of the same types. It takes a round for each level, whatever the function; where a plain sum, least or
    greatest value is asked for, `reduce` is one aggregation.
    """
    bodies = tree.bodies_in_leaves()
    leaves = tree.leaves().select(F.col("key").alias("__leaf")).join(bodies, F.col("__leaf") == F.col("leaf"), "left")
    own = materialize(leaves.groupBy(F.col("__leaf").alias("key")).agg(*_named(leaf(_at()))))
    names = [c for c in own.columns if c != "key"]
    cells = tree.with_geometry()
    deepest = tree.cells.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        here = own.join(tree.cells.where(F.col("depth") == depth).select("key"), "key")
        if levels:
            below = levels[-1].join(cells.where(F.col("depth") == depth + 1), "key")
            here = here.unionByName(_merged(tree, below, merge).select("key", *names))
        levels.append(materialize(here))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    out = materialize(out)
    discard(own, *levels)
    return out


def downward(tree: Tree, root: Callable[[At], Columns], fn: Callable[[At, At], Columns]) -> DataFrame:
    """(key, attributes) of every cell, parents before children: the root's are root(cell), others' fn(parent, child).

    The parent's lookup has its attributes and geometry, the child's its geometry; so attributes have names of their own.
    """
    cells = tree.with_geometry()
    if clash := set(root(_at())) & set(cells.columns):
        raise ValueError(f"cells have columns of these names: {sorted(clash)}")
    here = materialize(cells.where("parent < 0").select("key", *_named(root(_at()))))
    names = [c for c in here.columns if c != "key"]
    levels = [here]
    for depth in range(1, tree.cells.agg(F.max("depth")).first()[0] + 1):
        parents = _as(cells.where(F.col("depth") == depth - 1).join(levels[-1], "key"), "parent_")
        children = _as(cells.where(F.col("depth") == depth), "child_")
        rows = children.join(parents, F.col("child_parent") == F.col("parent_key"))
        levels.append(materialize(rows.select(F.col("child_key").alias("key"), *_named(fn(_at("parent_"), _at("child_")))).select("key", *names)))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def reduce(tree: Tree, value: Callable[[At], Columns], op: Callable[[str], Column] = F.sum) -> DataFrame:
    """(key, one column for each of value(body)) of every cell with bodies, merged by `op` (F.sum, F.min, F.max, ...).

    `op` must not depend on order or grouping: leaves are merged first, then all ancestors of a leaf at once.
    """
    columns = value(_at())
    leaves = tree.bodies_in_leaves().select("leaf", *_named(columns)).groupBy("leaf").agg(*(op(n).alias(n) for n in columns))
    up = leaves.select(F.explode(tree.keys.ancestors(F.col("leaf"))).alias("key"), *columns)
    return up.groupBy("key").agg(*(op(n).alias(n) for n in columns))


def product(left: DataFrame, right: DataFrame, fn: Callable[[At, At], Columns], on: list[str] | None = None, once: str | None = None) -> DataFrame:
    """The columns of fn(left row, right row) for pairs of rows.

    Pairs are those of equal `on`, or all of them: then the right side must be few rows, which is checked. With `once`,
    a pair and its reverse are looked at once: that column of the left row is at most the right one's.
    """
    a, b = _as(left, "left_"), _as(right, "right_")
    if on:
        condition = F.lit(True)
        for c in on:
            condition = condition & (F.col(f"left_{c}") == F.col(f"right_{c}"))
        rows = a.join(b, condition)
    else:
        n = b.limit(MOST_ROWS + 1).count()
        if n > MOST_ROWS:
            raise ValueError(f"a product of all pairs takes at most {MOST_ROWS} rows on the right; give columns to join on")
        rows = a.crossJoin(F.broadcast(b))
    if once:
        rows = rows.where(F.col(f"left_{once}") <= F.col(f"right_{once}"))
    return rows.select(*_named(fn(_at("left_"), _at("right_"))))


#: Rows of the right side of a product of all pairs.
MOST_ROWS = 10_000


def map_pairs(tree: Tree, pairs: DataFrame, fn: Callable[[At, At], Columns], sources: Tree | None = None) -> DataFrame:
    """(body_id, the columns of fn(target, source)): fn aggregates over the bodies of the leaves j paired with a body's leaf i."""
    t = _as(tree.bodies_in_leaves(), "target_")
    s = _as((sources or tree).bodies_in_leaves(), "source_")
    rows = pairs.join(t, F.col("i") == F.col("target_leaf")).join(s, F.col("j") == F.col("source_leaf"))
    return rows.groupBy(F.col("target_body_id").alias("body_id")).agg(*_named(fn(_at("target_"), _at("source_"))))


def map_batches(bodies: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over Arrow batches of bodies, each of any number of rows: for functions that columns can't express."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield fn(b)

    return bodies.mapInArrow(run, schema)


def map_leaves(tree: Tree, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn over the bodies of each leaf as one Arrow table: at most ncrit rows, but for bodies that share a place."""
    return tree.bodies_in_leaves().groupBy("leaf").applyInArrow(fn, schema)
