"""Connected components of a graph in a table, by contraction; nothing of the graph comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespan.llm.common import discard, materialize

#: Links that one task joins at once; more are contracted first.
FEW = 1 << 18


def firsts(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the least item that pairs join it to."""
    least = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = least[i], least[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
            least = least[least]
    while not np.array_equal(least, again := least[least]):
        least = again
    return least


def _rooted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of links (a, b), all of them in this task."""
    batches = [b for b in parts if b.num_rows]
    if not batches:
        return
    a, b = (np.concatenate([x.column(n).to_numpy() for x in batches]) for n in ("a", "b"))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = node[firsts(len(node), iter([(at[: len(a)], at[len(a) :])]))]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of a link between two different nodes, the same root throughout a component.

    While there are more than FEW links, each round every node takes the neighbour (or itself) of least hash, the
    links move to those, and links within one go. Hashes differ by round, so about half the nodes at least go each
    round, and a star goes in one. What a round makes is written to the shared folder. The last links are joined in
    one task. Nodes are longs; nulls link nothing; repeated links and both directions do no harm.
    """
    cur = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), few_files=True)
    steps: list[DataFrame] = []
    while (left := cur.count()) > FEW:
        mark = lambda c, k=len(steps): F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("v"))
        ends = cur.union(cur.select("b", "a"))
        low = ends.groupBy("a").agg(F.min(mark(F.col("b"))).alias("m"))
        step = materialize(low.select(F.col("a").alias("node"), F.least(F.col("m"), mark(F.col("a")))["v"].alias("root")), few_files=True)
        steps.append(step)
        moved = cur.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        before, cur = cur, materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), few_files=True)
        discard(before)
    if left or not steps:
        steps.append(materialize(cur.coalesce(1).mapInArrow(_rooted, "node long, root long")))
    full = steps[-1]
    for step in reversed(steps[:-1]):
        later = full.select(F.col("node").alias("root"), F.col("root").alias("__later"))
        full = step.join(later, "root", "left").select("node", F.coalesce("__later", "root").alias("root"))
    return full
