"""Orders, scans and divisions of bodies among owners, without a single partition for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treespan.functions.keys import Keys
from treespan.operators.tree import AXES, Box
from treespan.plans.lineage import materialize


#: Operators of scans: how values of a partition, and partitions' results, come together.
OPERATORS = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}


def scan(df: DataFrame, order: str | list[str], value: str, name: str, inclusive: bool = True, op: str = "sum") -> DataFrame:
    """Adds running results of `value` in the given order, which must tell all rows apart.

    `op` is sum, min, max, product or minus: the first value less all later ones. Sums may be exclusive, too: of the
    rows before. Rows are dealt out by ranges of the order; each partition's result comes from one aggregation with a
    row for each partition, and running results are local.
    """
    if op == "minus":
        first = df.agg(F.min_by(value, F.struct(*([order] if isinstance(order, str) else order)))).first()[0]
        # first - (the sum of the later ones) is twice the first less the sum of all
        return scan(df, order, value, name).withColumn(name, F.lit(first) * 2 - F.col(name))
    if not inclusive and op != "sum":
        raise ValueError("only sums can be exclusive")
    order = [order] if isinstance(order, str) else list(order)
    merge = OPERATORS[op]
    part, at = "__part", "__before"
    # written once, so that ranges and results are of the same partitions
    dealt = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    whole = dealt.groupBy(part).agg(merge(value).alias("__whole"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(part, merge("__whole").over(earlier).alias(at))
    local = merge(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    two = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest, "product": lambda a, b: a * b}[op]
    total = F.when(F.col(at).isNull(), local).otherwise(two(F.col(at), local))
    if not inclusive:
        total = total - F.col(value)
    return dealt.join(F.broadcast(before), part).withColumn(name, total).drop(part, at)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 0, in an order that tells all rows apart."""
    one = "__one"
    return scan(df.withColumn(one, F.lit(1).cast("long")), order, one, name, inclusive=False).drop(one)


def sample_first(df: DataFrame, order: str, share: float = 0.01, least: int = 100) -> DataFrame:
    """The first rows in an order: a share of all, but at least so many."""
    n = df.count()
    return df.orderBy(order).limit(max(int(n * share), min(least, n)))


def strided(df: DataFrame, order: str, most: int) -> DataFrame:
    """At most so many rows at equal distances in an order."""
    step = max(df.count() // most, 1)
    return numbered(df, [order], "__n").where((F.col("__n") % step == 0) & (F.col("__n") < step * most)).drop("__n")


def heads(keyed: DataFrame, keys: Keys, owners: int, level: int = 4) -> DataFrame:
    """(rank, head): the first cell of each owner, so that cells of a level are dealt out in order with even counts.

    Owner r begins at the first cell where the running count is above r times an owner's share; the first at 0.
    The cells of one level, not the bodies, are what the running count goes over.
    """
    cells = keyed.groupBy(keys.prefix(F.col("key"), level).alias("cell")).agg(F.count("*").alias("nb"))
    share = keyed.count() // owners
    run = scan(cells, "cell", "nb", "scan")
    ranks = keyed.sparkSession.range(owners).select(F.col("id").cast("int").alias("rank"))
    first = run.join(F.broadcast(ranks), F.col("scan") > F.col("rank") * F.lit(share)).groupBy("rank").agg(F.min("cell").alias("head"))
    return first.select("rank", F.when(F.col("rank") == 0, F.lit(0).cast("long")).otherwise(F.col("head")).alias("head"))


def owned(df: DataFrame, owner_heads: DataFrame, key: str = "key") -> DataFrame:
    """Adds the rank of the last owner whose head is not after the key: an as-of join with as many heads as owners.

    Heads come to the driver, one number for each owner, and become an array that each row looks its key up in.
    """
    rows = sorted((r["head"], r["rank"]) for r in owner_heads.collect())
    # of owners with the same head, the last has it
    named = {h: r for h, r in rows}
    at = F.array(*(F.lit(h).cast("long") for h in named))
    ranks = F.array(*(F.lit(r).cast("int") for r in named.values()))
    return df.withColumn("rank", F.get(ranks, F.size(F.filter(at, lambda h: h <= F.col(key))) - 1))


def octsection(bodies: DataFrame, box: Box, levels: int) -> DataFrame:
    """Adds the rank of a grid that halves the axes in turn, `levels` times in all, the first axis lowest."""
    parts = [1 << ((levels - i + 2) // 3) for i in range(3)]
    rank, unit = F.lit(0), 1
    for a, lo, w, n in zip(AXES, box.low, box.width, parts):
        cell = F.least(F.floor((F.col(a) - lo) / w * n), F.lit(n - 1)).cast("int")
        rank = rank + cell * unit
        unit *= n
    return bodies.withColumn("rank", rank)


def bisection(bodies: DataFrame, levels: int) -> DataFrame:
    """Adds a rank by halving each part's bodies along its widest axis, `levels` times; ties go by body_id."""
    cur = bodies.withColumn("rank", F.lit(0))
    for _ in range(levels):
        width = cur.groupBy("rank").agg(*((F.max(a) - F.min(a)).alias(f"w{a}") for a in AXES), F.count("*").alias("m"))
        x, y, z = (F.col(f"w{a}") for a in AXES)
        axis = F.when((x >= y) & (x >= z), F.col("x")).when(y >= z, F.col("y")).otherwise(F.col("z"))
        wide = cur.join(F.broadcast(width), "rank").withColumn("__v", axis)  # 2^levels rows at most
        places = scan(wide.withColumn("__one", F.lit(1).cast("long")), ["rank", "__v", "body_id"], "__one", "__place")
        before = width.select("rank", "m").collect()
        skip, base = {}, 0
        for r in sorted(before):
            skip[r["rank"]] = base
            base += r["m"]
        start = F.element_at(F.create_map(*(F.lit(v) for kv in skip.items() for v in kv)), F.col("rank")) if skip else F.lit(0)
        upper = (F.col("__place") - start) > F.floor(F.col("m") / 2)
        cur = places.withColumn("rank", F.col("rank") * 2 + upper.cast("int")).select(*bodies.columns, "rank")
    return cur


def target_groups(placed: DataFrame, keys: Keys, level: int, most: int) -> DataFrame:
    """(cell, part, first, bodies): bodies of a cell of a level in groups of at most `most` in order of place."""
    cell = keys.prefix(F.col("key"), level)
    low = placed.groupBy(cell.alias("cell")).agg(F.min("place").alias("low"))
    grouped = placed.withColumn("cell", cell).join(low, "cell").withColumn("part", F.floor((F.col("place") - F.col("low")) / most))
    return grouped.groupBy("cell", "part").agg(F.min("place").alias("first"), F.count("*").alias("bodies"))


def process_grid(spark: SparkSession, most: int) -> DataFrame:
    """(n, px, py, pz): grids of n = 2^a 3^b processes, prime factors going to the axis of fewest, largest first."""
    rows = []
    for n in range(1, most + 1):
        rest, factors = n, []
        for p in (3, 2):
            while rest % p == 0:
                rest //= p
                factors.append(p)
        if rest == 1:
            grid = [1, 1, 1]
            for f in factors:
                grid[grid.index(min(grid))] *= f
            rows.append((n, *sorted(grid, reverse=True)))
    return spark.createDataFrame(rows, "n int, px int, py int, pz int")
