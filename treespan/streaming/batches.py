"""Trees of streams: each micro-batch of bodies is built into a tree of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from treespan.operators.tree import Box, Tree, build_tree


def tree_per_batch(stream: DataFrame, each: Callable[[Tree, int], None], ncrit: int = 16, dim: int = 3, box: Box | str = "cube") -> DataStreamWriter:
    """A writer that calls `each(tree, batch_id)` for every micro-batch with bodies.

    A batch may come again after a failure, with the same id: what `each` writes should go by that id.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # a source is read once a batch
        try:
            if not held.isEmpty():
                each(build_tree(held, ncrit, dim, box), batch_id)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(run)


def cells_to_parquet(stream: DataFrame, path: str, ncrit: int = 16, dim: int = 3) -> DataStreamWriter:
    """Writes each batch's cells to a folder of its own under `path`; a batch that comes again replaces what it wrote."""
    return tree_per_batch(stream, lambda tree, n: tree.cells.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}"), ncrit, dim)
