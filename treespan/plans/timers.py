"""Wall seconds of named parts of a step, and the reports made of them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.functions.keys import Keys
from treespan.operators import partition
from treespan.operators.tree import Tree
from treespan.sources.files import write_csv

#: The columns of the reports of seconds, by report.
TIMED = {
    "tree_construction": ("all", "sample", "exchange", "grow-local", "grow-global"),
    "let_construction": ("LET-All", "LET-Trav-main", "LET-Trav-sub", "LET-Req-all", "LET-Req-comm", "LET-Res-all", "LET-Res-acomm", "LET-Res-bcomm", "LET-Reg"),
    "map2": ("all", "let", "net_traverse", "device_call"),
}


class Timers:
    """Seconds by report and part; parts that were not timed have 0."""

    def __init__(self) -> None:
        self.seconds: dict[tuple[str, str], float] = {}

    @contextmanager
    def part(self, report: str, name: str) -> Iterator[None]:
        if name not in TIMED[report]:
            raise ValueError(f"{report} has no part {name}")
        began = perf_counter()
        try:
            yield
        finally:
            at = report, name
            self.seconds[at] = self.seconds.get(at, 0.0) + perf_counter() - began

    def table(self, spark: SparkSession) -> DataFrame:
        """(report, part, seconds) of all parts."""
        rows = [(r, p, self.seconds.get((r, p), 0.0)) for r, parts in TIMED.items() for p in parts]
        return spark.createDataFrame(rows, "report string, part string, seconds double")


def reports(tree: Tree, owners: int, timers: Timers | None = None, sampling_rate: float = 0.01) -> dict[str, DataFrame]:
    """The six tables of a run: hostnames, misc, load_balancing by owner, and seconds of three kinds of work.

    Owners are those of partition.heads; before the exchange bodies are dealt to them by their ids.
    """
    spark, keys = tree.cells.sparkSession, Keys(tree.dim)
    heads = partition.heads(tree.bodies.select("key"), keys, owners)
    ranks = spark.range(owners).select(F.col("id").cast("int").alias("Rank"))
    counted = lambda df, name: df.groupBy(F.col("rank").alias("Rank")).agg(F.count("*").alias(name))
    load = ranks.join(counted(tree.bodies.select(F.pmod("body_id", F.lit(owners)).cast("int").alias("rank")), "NumBodies1"), "Rank", "left")
    for name, df in (("NumBodies2", tree.bodies), ("NumLeaves", tree.leaves()), ("NumCells", tree.cells)):
        load = load.join(counted(partition.owned(df.select("key"), heads), name), "Rank", "left")
    out = {
        "hostnames": spark.createDataFrame([(0, spark.sparkContext.getConf().get("spark.driver.host", "localhost"))], "Rank int, HostName string"),
        "misc": tree.bodies.agg(F.lit(sampling_rate).alias("SamplingRate"), F.count("*").alias("NB")),
        "load_balancing": load.na.fill(0),
    }
    seconds = (timers or Timers()).seconds
    for report, parts in TIMED.items():
        out[report] = spark.createDataFrame([(0, *(seconds.get((report, p), 0.0) for p in parts))], ", ".join(["Rank int", *(f"`{p}` double" for p in parts)]))
    return out


def write_reports(tables: dict[str, DataFrame], folder: str, prefix: str = "", suffix: str = "") -> None:
    """One CSV with a header for each table: folder/prefix name suffix .csv."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{prefix}{name}{suffix}.csv")
