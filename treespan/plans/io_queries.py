"""Queries of sources and sinks; sinks write to the shared folder and read back what they wrote."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.operators import expansions as X
from treespan.operators import kernels as K
from treespan.operators import traverse as V
from treespan.plans import sql as S
from treespan.plans.force_queries import rounded
from treespan.plans.lineage import new_path
from treespan.plans.registry import add
from treespan.plans.timers import TIMED, Timers, reports, write_reports
from treespan.plans.tree_queries import K3, tree_of
from treespan.sources import bodies as B
from treespan.sources import files as W
from treespan.sources import generate as G

N = 1000
# the generator in steps, its product in two halves of 24 bits
_NEXT = "((((1502 * (s % 16777216) + 15525485 * (s // 16777216)) % 16777216) * 16777216 + 15525485 * (s % 16777216) + 11) % 281474976710656)"


def lcg(numbers: int, seed: int = 0) -> str:
    """Recursive CTE u (n, v) of the generator's numbers."""
    first = _NEXT.replace("s //", f"{(seed << 16) | 0x330E}::BIGINT //").replace("(s %", f"({(seed << 16) | 0x330E}::BIGINT %")
    return f"g AS (SELECT 0::BIGINT AS n, {first} AS s UNION ALL SELECT n + 1, {_NEXT} FROM g WHERE n < {numbers - 1}), u AS (SELECT n, s / 281474976710656.0::DOUBLE AS v FROM g)"


def _draws(each: int, seed: int = 0, n: int = N) -> str:
    cols = ", ".join(f"MAX(CASE WHEN n % {each} = {k} THEN v END) AS u{k}" for k in range(each))
    return f"WITH RECURSIVE {lcg(n * each, seed)}, r AS (SELECT n // {each} AS id, {cols} FROM u GROUP BY 1)"


def _xyz(*exprs: str, names=("x", "y", "z")) -> str:
    return ", ".join(f"ROUND({e}, 6) + 0.0 AS {a}" for a, e in zip(names, exprs))


_CUBE = [f"u{k} * 2 * {pi!r}::DOUBLE - {pi!r}::DOUBLE" for k in range(3)]
add("src_lattice", lambda spark, sf_dir: rounded(G.lattice(spark, N), "body_id"), "SELECT n AS body_id, " + _xyz("((n // 100) / 9.0::DOUBLE) * 2 - 1", "((n // 10 % 10) / 9.0::DOUBLE) * 2 - 1", "((n % 10) / 9.0::DOUBLE) * 2 - 1") + " FROM (SELECT UNNEST(range(0, 1000)) AS n)")
add("src_cube", lambda spark, sf_dir: rounded(G.cube(spark, N), "body_id"), f"{_draws(3)} SELECT id AS body_id, {_xyz(*_CUBE)} FROM r")
_R = "(SQRT(" + " + ".join(f"(u{k} * 2 - 1) * (u{k} * 2 - 1)" for k in range(3)) + ") * 1.1::DOUBLE)"
add("src_sphere", lambda spark, sf_dir: rounded(G.sphere(spark, N), "body_id"), f"{_draws(3)} SELECT id AS body_id, {_xyz(*(f'(u{k} * 2 - 1) / {_R}' for k in range(3)))} FROM r")
_PL = f"""{_draws(3, n=1110)}, p AS (SELECT id, u0, u1, u2, 1 / SQRT(POWER(u0, -2.0::DOUBLE / 3.0::DOUBLE) - 1) AS rad FROM r),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY id) - 1 AS body_id, (1 - 2 * u1) * rad AS h FROM p WHERE rad < 100)"""
_FLAT = "SQRT(GREATEST(rad * rad - h * h, 0))"
_SC = f"{3 * pi / 16!r}::DOUBLE"
add("src_plummer", lambda spark, sf_dir: rounded(G.plummer(spark, N), "body_id"), f"{_PL} SELECT body_id, {_xyz(f'{_FLAT} * COS({2 * pi!r}::DOUBLE * u2) * {_SC}', f'{_FLAT} * SIN({2 * pi!r}::DOUBLE * u2) * {_SC}', f'h * {_SC}')} FROM o WHERE body_id < {N}")
add("src_charge", lambda spark, sf_dir: rounded(G.with_charges(spark.range(N).withColumnRenamed("id", "body_id"), N), "body_id"), f"{_draws(1)} SELECT id AS body_id, ROUND(u0 - 0.5, 6) + 0.0 AS src FROM r")
add("src_target_reset", lambda spark, sf_dir: G.with_targets(spark.range(N).withColumnRenamed("id", "body_id")).select("body_id", "ibody", "weight", F.aggregate("trg", F.lit(0.0), lambda a, b: a + b).alias("trg")), f"SELECT n AS body_id, CAST(n AS INTEGER) AS ibody, 1.0::DOUBLE AS weight, 0.0::DOUBLE AS trg FROM (SELECT UNNEST(range(0, {N})) AS n)")
add("src_init", lambda spark, sf_dir: rounded(G.generate(spark, N, "c", 3).select("body_id", "x", "y", "z", "src"), "body_id"),
    f"{_draws(3, 3)}, r1 AS (SELECT n AS id, v FROM u WHERE n < {N}) SELECT r.id AS body_id, {_xyz(*_CUBE)}, ROUND(r1.v - 0.5, 6) + 0.0 AS src FROM r JOIN r1 ON r1.id = r.id")
_BHR = f"{_draws(4)} SELECT id AS body_id, {_xyz('u0', 'u1', 'u2')}, ROUND(u3 / {N} * 1000, 6) + 0.0 AS src FROM r"
add("src_bh_random", lambda spark, sf_dir: rounded(G.random_masses(spark, N).withColumn("src", F.col("src") * 1000), "body_id"), _BHR)
add("src_direct_random", lambda spark, sf_dir: G.random_floats(spark, N).select("body_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "src"))), f"{_draws(4)} SELECT id AS body_id, " + ", ".join(f"CAST(CAST(u{k} AS FLOAT) AS DOUBLE) AS {c}" for k, c in enumerate(("x", "y", "z", "src"))) + " FROM r")
add("src_py", lambda spark, sf_dir: rounded(G.random_masses(spark, N, dim=2, equal=True), "body_id"), f"{_draws(2)} SELECT id AS body_id, {_xyz('u0', 'u1')}, ROUND(1.0::DOUBLE / {N}, 6) + 0.0 AS src FROM r")
add("src_wrapper_neutral", lambda spark, sf_dir: rounded(G.neutral(G.random_masses(spark, N).withColumn("src", F.col("src") * N)), "body_id"), f"{_draws(4)} SELECT id AS body_id, {_xyz('u0', 'u1', 'u2')}, ROUND(u3 - (SELECT AVG(u3) FROM r), 6) + 0.0 AS src FROM r")
add("src_arrays", lambda spark, sf_dir: G.from_arrays(spark, np.arange(30.0), np.arange(10.0)), "SELECT n AS body_id, 3.0::DOUBLE * n AS x, 3.0::DOUBLE * n + 1 AS y, 3.0::DOUBLE * n + 2 AS z, 1.0::DOUBLE * n AS src FROM (SELECT UNNEST(range(0, 10)) AS n)")
_ALL = f"WITH {B.SQL['b3']} SELECT body_id, x, y, z, src FROM b"
add("src_parquet", lambda spark, sf_dir: B.b3(spark, sf_dir), _ALL)


def _through_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    W.write_values(B.b3(spark, sf_dir), "body_id", ["x", "y", "z", "src"], path)
    return W.read_values(spark, path, ["x", "y", "z", "src"])


for _n in ("src_read_sources", "sink_write_sources"):
    add(_n, _through_values, _ALL)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.b3(spark, sf_dir)
    path = new_path(spark)
    names = ["pot", "acc_x", "acc_y", "acc_z"]
    W.write_values(K.direct(b, b), "body_id", names, path)
    return rounded(W.read_values(spark, path, names), "body_id")


from treespan.plans.registry import SQL as _SQL  # noqa: E402

for _n in ("src_read_targets", "sink_write_targets"):
    add(_n, _targets, _SQL["join_direct"])


def _xyz_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appended dumps, counted by line."""
    b, path = B.b3(spark, sf_dir), new_path(spark)
    W.dump_xyz(b, path)
    W.dump_xyz(b, path, append=True)
    lines = spark.read.text(path).select(F.split("value", " ").alias("v"))
    return lines.select(*((F.round(F.col("v")[i].cast("double"), 4) + 0.0).alias(a) for i, a in enumerate("xyz"))).groupBy("x", "y", "z").agg(F.count("*").alias("n"))


add("sink_dump_xyz", _xyz_dump, f"WITH {B.SQL['b3']} SELECT ROUND(x, 4) + 0.0 AS x, ROUND(y, 4) + 0.0 AS y, ROUND(z, 4) + 0.0 AS z, 2 * COUNT(*) AS n FROM b GROUP BY 1, 2, 3")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    W.write_csv(B.b3(spark, sf_dir), path)
    return spark.read.schema("body_id long, x double, y double, z double, src double").option("header", True).csv(path)


add("sink_csv", _csv, _ALL)


def _rank_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    W.write_rank_csv(B.b3(spark, sf_dir).repartition(4, "body_id"), path)
    read = spark.read.schema("body_id long, x double, y double, z double, src double, Rank int").option("header", True).csv(path)
    return read.agg(F.count("*").alias("bodies"), F.countDistinct("Rank").alias("ranks"))


add("sink_rank_csv", _rank_csv, "SELECT COUNT(*) AS bodies, 4 AS ranks FROM embeddings")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six reports, written and read back: rows and columns of each, and the numbers that don't change from run to run."""
    path, timers = new_path(spark), Timers()
    with timers.part("tree_construction", "all"):
        t = tree_of(spark, sf_dir)
    tables = reports(t, 8, timers)
    write_reports(tables, path, suffix="_1")
    out = None
    for name in tables:
        read = spark.read.option("header", True).csv(f"{path}/{name}_1.csv")
        sums = [F.sum(F.col(c).cast("long")) for c in ("NB", "NumBodies1", "NumBodies2", "NumLeaves", "NumCells") if c in read.columns]
        one = read.agg(F.count("*").alias("rows"), sum(sums, F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("name"), F.lit(len(read.columns)).alias("columns"), "rows", "total")
        out = one if out is None else out.union(one)
    return out


add("sink_report", _report, f"""WITH {S.tree('b3', 16)}, n AS (SELECT (SELECT COUNT(*) FROM b) AS bodies, COUNT(*) AS cells, COUNT(*) FILTER (WHERE is_leaf) AS leaves FROM cells)
SELECT 'hostnames' AS name, 2 AS columns, 1::BIGINT AS rows, 0::BIGINT AS total UNION ALL SELECT 'misc', 2, 1, bodies FROM n UNION ALL SELECT 'load_balancing', 5, 8, 2 * bodies + leaves + cells FROM n
UNION ALL SELECT 'tree_construction', 6, 1, 0 UNION ALL SELECT 'let_construction', 10, 1, 0 UNION ALL SELECT 'map2', 5, 1, 0""")  # fmt: skip
add("sink_copyback", lambda spark, sf_dir: (lambda t: rounded(t.bodies.select("body_id", "key").join(K.direct(t.bodies, t.bodies), "body_id").orderBy("key", "body_id"), "body_id", "key"))(tree_of(spark, sf_dir)),
    f"""WITH {S.keyed('b3')}, p AS (SELECT t.body_id, s.src, s.x - t.x AS x, s.y - t.y AS y, s.z - t.z AS z, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) AS r2 FROM b t, b s),
d AS (SELECT body_id, SUM(src / SQRT(r2)) AS pot, {', '.join(f'SUM({a} * src / (SQRT(r2) * r2)) AS acc_{a}' for a in 'xyz')} FROM p WHERE r2 <> 0 GROUP BY body_id)
SELECT d.body_id, k.key, {', '.join(f'ROUND({c}, 6) + 0.0 AS {c}' for c in ('pot', 'acc_x', 'acc_y', 'acc_z'))} FROM d JOIN k ON k.body_id = d.body_id""")  # fmt: skip


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipoles, local expansions and bodies of the cells, dumped and read back."""
    t, path = tree_of(spark, sf_dir), new_path(spark)
    W.write_json(X.multipoles(t, 3), f"{path}/m")
    W.write_json(X.locals_(t, V.dual(t, 0.4).far, 3), f"{path}/l")
    W.write_json(t.bodies_in_leaves().groupBy(F.col("leaf").alias("key")).agg(F.array_sort(F.collect_list("body_id")).alias("bodies")), f"{path}/b")
    read = lambda part, kind: spark.read.schema(f"key long, {kind}").json(f"{path}/{part}")
    r = lambda c: F.round(c, 5) + 0.0
    m, l, b = read("m", "m array<double>"), read("l", "l array<double>"), read("b", "bodies array<long>")
    both = t.cells.select("key").join(m, "key", "left").join(l, "key", "left").join(b, "key", "left")
    return both.select("key", r(F.col("m")[0]).alias("m0"), r(F.col("m")[3]).alias("m3"), r(F.col("l")[0]).alias("l0"), r(F.col("l")[9]).alias("l9"), F.array_join("bodies", ",").alias("bodies"))


add("sink_debug_dump", _json, f"WITH RECURSIVE {S.tree('b3', 16)}, {S.geometry()}, {S.dual(0.4)}, {S.expansions(3)}, lb AS (SELECT c.key, STRING_AGG(CAST(k.body_id AS VARCHAR), ',' ORDER BY k.body_id) AS bodies FROM cells c JOIN k ON (k.key >> {S.below('c.depth')}) = (c.key >> {S.below('c.depth')}) WHERE c.is_leaf GROUP BY c.key) SELECT c.key, ROUND(m0, 5) + 0.0 AS m0, ROUND(m3, 5) + 0.0 AS m3, ROUND(l0, 5) + 0.0 AS l0, ROUND(l9, 5) + 0.0 AS l9, bodies FROM cells c LEFT JOIN mm ON mm.key = c.key LEFT JOIN lo ON lo.key = c.key LEFT JOIN lb ON lb.key = c.key")


def _cells_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, path = tree_of(spark, sf_dir), new_path(spark)
    t.with_geometry().select("key", "depth", "is_leaf", "nb", "cx", "cy", "cz").write.parquet(path)
    return rounded(spark.read.parquet(path).withColumn("depth", F.col("depth").cast("int")), "key", "depth", "is_leaf", "nb")


add("sink_cells_dump", _cells_dump, f"WITH {S.tree('b3', 16)}, {S.geometry()} SELECT key, depth, is_leaf, nb, " + ", ".join(f"ROUND(c{a}, 6) + 0.0 AS c{a}" for a in "xyz") + " FROM g")
def _vtk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a VTK file, written and read back; points in thousandths, as text forms of numbers differ."""
    path = new_path(spark)
    W.write_vtk(B.b3(spark, sf_dir), path)
    parts = F.split("value", " ")
    point = F.col("value").rlike("^[-0-9.eE]+ [-0-9.eE]+ [-0-9.eE]+$")
    said = F.when(point, F.concat_ws(" ", *(F.floor(F.get(parts, F.lit(i)).try_cast("double") * 1000).cast("string") for i in range(3)))).otherwise(F.col("value"))
    return spark.read.text(path).select(said.alias("line")).groupBy("line").agg(F.count("*").alias("n"))


_HEAD = " UNION ALL ".join(f"SELECT '{h}' AS line" for h in ("# vtk DataFile Version 3.0", "bodies", "ASCII", "DATASET POLYDATA"))
add("sink_vtk", _vtk, f"WITH {B.SQL['b3']}, v AS ({_HEAD} UNION ALL SELECT CONCAT('POINTS ', CAST(COUNT(*) AS VARCHAR), ' double') FROM b UNION ALL SELECT CONCAT_WS(' ', {', '.join(f'CAST(CAST(FLOOR({a} * 1000) AS BIGINT) AS VARCHAR)' for a in 'xyz')}) FROM b) SELECT line, COUNT(*) AS n FROM v GROUP BY line")


def _timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of a step took time: all that were run."""
    timers = Timers()
    with timers.part("tree_construction", "all"):
        t = tree_of(spark, sf_dir)
    with timers.part("map2", "all"):
        with timers.part("map2", "net_traverse"):
            V.dual(t, 0.8).far.count()
    return timers.table(spark).select("report", "part", (F.col("seconds") > 0).alias("timed"))


_PARTS = ", ".join(f"('{r}', '{p}', {str((r, p) in (('tree_construction', 'all'), ('map2', 'all'), ('map2', 'net_traverse'))).upper()})" for r, parts in TIMED.items() for p in parts)
add("sink_timers", _timers, f"SELECT * FROM (VALUES {_PARTS}) t(report, part, timed)")
add("date_now", lambda spark, sf_dir: spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("now")))
assert K3.dim == 3
