"""Queries of trees: their cells, leaves, owners and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treespan.functions.keys import Keys
from treespan.operators import partition as P
from treespan.operators import tree as T
from treespan.plans import sql as S
from treespan.plans.registry import add
from treespan.sources import bodies as B

K3 = Keys(3)
VIEWS = {"b3": (B.b3, 3), "b3c": (B.b3c, 3), "b2": (B.b2, 2), "lineitems": (B.lineitems, 3), "coincident": (B.coincident, 3), "parts": (B.parts, 3)}


def tree_of(spark: SparkSession, sf_dir: str, view: str = "b3", ncrit: int = 16, **more) -> T.Tree:
    make, dim = VIEWS[view]
    return T.build_tree(make(spark, sf_dir), ncrit, dim, **more)


def _cells(df: DataFrame) -> DataFrame:
    return df.select("key", "parent", F.col("depth").cast("int").alias("depth"), "is_leaf", "nb")


for _name, _view, _ncrit in (("tree_partition", "b3", 16), ("tree_grow", "lineitems", 16), ("tree_refine", "coincident", 64), ("tree_py", "b2", 16), ("tree_c", "parts", 16)):
    add(_name, lambda spark, sf_dir, v=_view, n=_ncrit: _cells(tree_of(spark, sf_dir, v, n).cells), f"WITH {S.tree(_view, _ncrit, VIEWS[_view][1])} SELECT * FROM cells")
add("tree_octree_upstream", lambda spark, sf_dir: _cells(tree_of(spark, sf_dir, "b3", 64, emit_empty=False).cells), f"WITH {S.tree('b3', 64, empty=False)} SELECT * FROM cells")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in the order of their levels: each one's place, the range of its level, and the range of its bodies in key order."""
    t = tree_of(spark, sf_dir, "parts", 64, emit_empty=False)
    cells = P.numbered(t.cells.select("key", F.col("depth").cast("int").alias("depth")), ["depth", "key"], "place")
    ranges = cells.groupBy("depth").agg(F.min("place").alias("level_first"), F.max("place").alias("level_last"))
    placed = P.numbered(t.bodies.select("body_id", "key"), ["key", "body_id"], "at")
    bodies = placed.select(F.explode(K3.ancestors(F.col("key"))).alias("key"), "at").groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return cells.join(F.broadcast(ranges), "depth").join(bodies, "key")


add("tree_gpu", _levels, f"WITH {S.tree('parts', 64, empty=False)}, p AS (SELECT key, ROW_NUMBER() OVER (ORDER BY key, body_id) - 1 AS pos FROM k), l AS (SELECT key, depth, ROW_NUMBER() OVER (ORDER BY depth, key) - 1 AS place FROM cells) SELECT l.key, l.depth, l.place, MIN(place) OVER (PARTITION BY l.depth) AS level_first, MAX(place) OVER (PARTITION BY l.depth) AS level_last, r.first, r.last FROM l JOIN (SELECT {S.prefix('key', 'd')} AS key, MIN(pos) AS first, MAX(pos) AS last FROM p, (SELECT UNNEST(range(0, 20)) AS d) GROUP BY 1) r ON r.key = l.key")
add("tree_leaves", lambda spark, sf_dir: tree_of(spark, sf_dir).leaves().select("key", "nb"), f"WITH {S.tree('b3', 16)} SELECT key, nb FROM cells WHERE is_leaf")
add("tree_stats", lambda spark, sf_dir: tree_of(spark, sf_dir, "lineitems", 64).cells.agg(F.sum(F.when(F.col("is_leaf"), F.col("nb"))).alias("bodies"), F.count("*").alias("cells"), F.max("depth").cast("int").alias("depth")),
    f"WITH {S.tree('lineitems', 64)} SELECT CAST(SUM(nb) FILTER (WHERE is_leaf) AS BIGINT) AS bodies, COUNT(*) AS cells, MAX(depth) AS depth FROM cells")
add("tree_histogram", lambda spark, sf_dir: tree_of(spark, sf_dir, "lineitems").leaves().groupBy(F.col("depth").cast("int").alias("depth")).agg(F.count("*").alias("leaves"), F.sum("nb").alias("bodies"), (F.round(F.avg("nb") / 16, 6) + 0.0).alias("filled")),
    f"WITH {S.tree('lineitems', 16)} SELECT depth, COUNT(*) AS leaves, CAST(SUM(nb) AS BIGINT) AS bodies, ROUND(AVG(nb) / 16, 6) + 0.0 AS filled FROM cells WHERE is_leaf GROUP BY depth")
add("tree_histogram_regions", lambda spark, sf_dir: tree_of(spark, sf_dir, "lineitems").cells.groupBy(K3.msbits(F.col("key"), 6).alias("region")).agg(F.count("*").alias("cells")),
    f"WITH {S.tree('lineitems', 16)} SELECT (key >> 56) AS region, COUNT(*) AS cells FROM cells GROUP BY 1")


def _box(name: str, kind: str, view: str, leeway: float = 0.0) -> None:
    make, dim = VIEWS[view]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        box = T.bounding_box(make(spark, sf_dir), dim, kind)
        rows = [(i, round(lo - leeway * w, 6) + 0.0, round(lo + w + leeway * w, 6) + 0.0) for i, (lo, w) in enumerate(zip(box.low, box.width))]
        return spark.createDataFrame(rows, "axis int, low double, high double")

    parts = " UNION ALL ".join(f"SELECT {i} AS axis, ROUND(lo{i} - {leeway} * w{i}, 6) + 0.0 AS low, ROUND(lo{i} + w{i} + {leeway} * w{i}, 6) + 0.0 AS high FROM box" for i in range(dim))
    add(name, run, f"WITH {S.keyed(view, dim, kind)} {parts}")


_box("tree_bbox", "cube", "b3")
_box("tree_bbox_global", "cube", "lineitems")
_box("tree_bbox_upstream", "tight", "lineitems")
_box("tree_bbox_leeway", "tight", "parts", 1e-6)


def _keyed(spark: SparkSession, sf_dir: str, view: str = "b3") -> DataFrame:
    make, dim = VIEWS[view]
    b = make(spark, sf_dir)
    return T.with_keys(b, T.bounding_box(b, dim), Keys(dim))


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.numbered(_keyed(spark, sf_dir).select("body_id", "key"), ["key", "body_id"], "place")


# the first bodies in the given order, a hundredth but at least 100
add("tree_sample", lambda spark, sf_dir: P.sample_first(_keyed(spark, sf_dir, "parts"), "body_id").select("body_id", "key"),
    f"WITH {S.keyed('parts')} SELECT body_id, key FROM (SELECT body_id, key, ROW_NUMBER() OVER (ORDER BY body_id) AS n, COUNT(*) OVER () AS m FROM k) WHERE n <= GREATEST(CAST(FLOOR(m * 0.01) AS BIGINT), LEAST(100, m))")
_SCAN = f"""hn AS (SELECT {S.prefix('key', '4')} AS cell, COUNT(*) AS nb FROM k GROUP BY 1),
hs AS (SELECT cell, nb, SUM(nb) OVER (ORDER BY cell) AS scan, SUM(nb) OVER () AS m FROM hn)"""
_HEADS = f"{_SCAN}, h AS (SELECT r AS rank, CASE WHEN r = 0 THEN 0 ELSE MIN(cell) END AS head FROM hs, (SELECT UNNEST(range(0, 8)) AS r) WHERE scan > (m // 8) * r GROUP BY r)"
_OWNED = f"WITH {S.keyed('lineitems')}, {_HEADS}"
add("tree_partition_space", lambda spark, sf_dir: P.heads(_keyed(spark, sf_dir, "lineitems"), K3, 8),
    f"{_OWNED} SELECT CAST(rank AS INTEGER) AS rank, head FROM h")
add("tree_exchange", lambda spark, sf_dir: P.owned(_keyed(spark, sf_dir, "lineitems"), P.heads(_keyed(spark, sf_dir, "lineitems"), K3, 8)).groupBy("rank").agg(F.count("*").alias("bodies"), F.min("key").alias("first"), F.max("key").alias("last")),
    f"{_OWNED}, o AS (SELECT k.key, MAX(rank) AS rank FROM (SELECT DISTINCT key FROM k) k JOIN h ON h.head <= k.key GROUP BY k.key) SELECT CAST(rank AS INTEGER) AS rank, COUNT(*) AS bodies, MIN(k.key) AS first, MAX(k.key) AS last FROM k JOIN o ON o.key = k.key GROUP BY rank")
add("join_owner_asof", lambda spark, sf_dir: P.owned(tree_of(spark, sf_dir, "lineitems", 64).leaves().select("key"), P.heads(_keyed(spark, sf_dir, "lineitems"), K3, 8)).select("key", "rank"),
    f"WITH {S.tree('lineitems', 64)}, {_HEADS} SELECT c.key, CAST(MAX(rank) AS INTEGER) AS rank FROM cells c JOIN h ON h.head <= c.key WHERE c.is_leaf GROUP BY c.key")
add("tree_sort_bodies", lambda spark, sf_dir: _sorted(spark, sf_dir), f"WITH {S.keyed('b3')} SELECT body_id, key, ROW_NUMBER() OVER (ORDER BY key, body_id) - 1 AS place FROM k")


# owners of leaves by a coarse cell: two of eight octants an owner
def _owned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    return T.local_tree(t.cells, K3, F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.call_function("shiftright", K3.digit(F.col("key"), 1), F.lit(1))))


_LOCAL = f"""WITH {S.tree('b3', 16)}, l AS (SELECT key, CASE WHEN depth = 0 THEN 0 ELSE CAST(key >> 60 AS INTEGER) END AS owner FROM cells WHERE is_leaf),
r AS (SELECT {S.prefix('key', 'd')} AS key, COUNT(DISTINCT owner) AS ranks, MIN(owner) AS owner FROM l, (SELECT UNNEST(range(0, 20)) AS d) WHERE d <= (key & 31) GROUP BY 1),
marked AS (SELECT cells.*, r.owner, r.ranks, r.ranks = 1 AS local FROM cells JOIN r ON r.key = cells.key),
roots AS (SELECT m.key, m.owner, m.nb FROM marked m LEFT JOIN marked p ON p.key = m.parent WHERE m.local AND NOT COALESCE(p.local, FALSE))"""
add("tree_local_roots", lambda spark, sf_dir: T.local_roots(_owned_tree(spark, sf_dir)).select("key", F.col("owner").cast("int").alias("owner"), "nb"), f"{_LOCAL} SELECT key, CAST(owner AS INTEGER) AS owner, nb FROM roots")
add("agg_lroot_bool", lambda spark, sf_dir: _owned_tree(spark, sf_dir).select("key", "local"), f"{_LOCAL} SELECT key, local FROM marked")
add("tree_global_leaves", lambda spark, sf_dir: T.local_roots(_owned_tree(spark, sf_dir)).select("key").distinct(), f"{_LOCAL} SELECT DISTINCT key FROM roots")
add("set_union", lambda spark, sf_dir: (lambda r: r.where("owner < 2").select("key").union(r.where("owner > 0").select("key")).distinct())(T.local_roots(_owned_tree(spark, sf_dir))), f"{_LOCAL} SELECT key FROM roots WHERE owner < 2 UNION SELECT key FROM roots WHERE owner > 0")
add("tree_global_grow", lambda spark, sf_dir: T.global_tree(T.local_roots(_owned_tree(spark, sf_dir)), K3), f"{_LOCAL} SELECT DISTINCT {S.prefix('key', 'd')} AS key FROM roots, (SELECT UNNEST(range(0, 20)) AS d) WHERE d <= (key & 31)")


def _boxes(df: DataFrame, t: T.Tree) -> DataFrame:
    g = t.with_geometry(df)
    r = lambda c: F.round(c, 6) + 0.0
    return g.select("key", *(c for i, a in enumerate("xyz") for c in (r(F.col(f"c{a}") - F.col(f"w{i}") / 2).alias(f"lo{a}"), r(F.col(f"c{a}") + F.col(f"w{i}") / 2).alias(f"hi{a}"))))


_BOXES = ", ".join(f"ROUND(c{a} - s{i} / 2, 6) + 0.0 AS lo{a}, ROUND(c{a} + s{i} / 2, 6) + 0.0 AS hi{a}" for i, a in enumerate("xyz"))


def _local_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    mine = T.local_tree(t.cells, K3, F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.call_function("shiftright", K3.digit(F.col("key"), 1), F.lit(1))))
    return _boxes(T.local_roots(mine), t)


add("tree_local_bb", _local_boxes, f"{_LOCAL}, {S.geometry()} SELECT g.key, {_BOXES} FROM g JOIN roots ON roots.key = g.key")


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an owner finds each cell of a finer tree: among its own, else among cells got for it, else in the global tree."""
    fine, marked = tree_of(spark, sf_dir, "b3", 4).cells.select("key"), _owned_tree(spark, sf_dir)
    own = marked.where("local and owner = 0").select("key", F.lit("local").alias("a"))
    got = marked.where("local and owner > 0").select("key", F.lit("got").alias("b"))
    every = T.global_tree(T.local_roots(marked), K3).select("key", F.lit("global").alias("c"))
    return fine.join(own, "key", "left").join(got, "key", "left").join(every, "key", "left").select("key", F.coalesce("a", "b", "c", F.lit("none")).alias("found"))


add("tree_lookup", _lookup, f"""{_LOCAL}, below4 AS (SELECT c.key AS parent, ((c.key + 1) | (i << {S.below('(c.key & 31) + 1')})) AS key FROM counts c, (SELECT UNNEST(range(0, 8)) AS i) WHERE c.nb > 4 AND (c.key & 31) < 19),
fine AS (SELECT 0::BIGINT AS key UNION ALL SELECT key FROM below4), gtree AS (SELECT DISTINCT {S.prefix('key', 'd')} AS key FROM roots, (SELECT UNNEST(range(0, 20)) AS d) WHERE d <= (key & 31))
SELECT f.key, CASE WHEN m.local AND m.owner = 0 THEN 'local' WHEN m.local THEN 'got' WHEN g.key IS NOT NULL THEN 'global' ELSE 'none' END AS found FROM fine f LEFT JOIN marked m ON m.key = f.key LEFT JOIN gtree g ON g.key = f.key""")  # fmt: skip


def _accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    kids = t.cells.where("parent >= 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("nsubcells"))
    r = lambda c: F.round(c, 6) + 0.0
    return t.with_geometry().join(kids, "key", "left").select("key", "parent", F.col("depth").cast("int").alias("depth"), "is_leaf", "nb", F.coalesce("nsubcells", F.lit(0)).alias("nsubcells"), *(r(F.col(f"c{a}")).alias(f"c{a}") for a in "xyz"), r(F.col("w0")).alias("w0"))


add("tree_accessors", _accessors, f"WITH {S.tree('b3', 16)}, {S.geometry()} SELECT g.key, g.parent, g.depth, g.is_leaf, g.nb, (SELECT COUNT(*) FROM cells c WHERE c.parent = g.key) AS nsubcells, " + ", ".join(f"ROUND(c{a}, 6) + 0.0 AS c{a}" for a in "xyz") + ", ROUND(s0, 6) + 0.0 AS w0 FROM g")
add("tree_fixed_level", lambda spark, sf_dir: T.fixed_level(_keyed(spark, sf_dir, "lineitems"), K3, 4).withColumn("depth", F.col("depth").cast("int")),
    f"WITH {S.keyed('lineitems')} SELECT {S.prefix('key', 'd')} AS key, CAST(d AS INTEGER) AS depth, COUNT(*) AS nb FROM k, (SELECT UNNEST(range(0, 5)) AS d) GROUP BY 1, 2")


def _uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of body places in the leaves of level 3."""
    placed = _sorted(spark, sf_dir)
    return placed.groupBy(K3.prefix(F.col("key"), 3).alias("leaf")).agg(F.min("place").alias("first"), F.max("place").alias("last"))


_PLACES = f"WITH {S.keyed('b3')}, p AS (SELECT body_id, key, ROW_NUMBER() OVER (ORDER BY key, body_id) - 1 AS place FROM k)"
add("tree_uniform", _uniform, f"{_PLACES} SELECT {S.prefix('key', '3')} AS leaf, MIN(place) AS first, MAX(place) AS last FROM p GROUP BY 1")
add("tree_target_groups", lambda spark, sf_dir: P.target_groups(_sorted(spark, sf_dir), K3, 2, 32),
    f"{_PLACES}, m AS (SELECT {S.prefix('key', '2')} AS cell, place, ROW_NUMBER() OVER (PARTITION BY {S.prefix('key', '2')} ORDER BY place) - 1 AS n FROM p) SELECT cell, n // 32 AS part, MIN(place) AS first, COUNT(*) AS bodies FROM m GROUP BY 1, 2")
add("part_octsection", lambda spark, sf_dir: P.octsection(B.parts(spark, sf_dir), T.bounding_box(B.parts(spark, sf_dir), 3, "tight"), 3).select("body_id", "rank"),
    f"WITH {S.keyed('parts', 3, 'tight')} SELECT body_id, CAST(" + " + ".join(f"LEAST(CAST(FLOOR(({a} - lo{i}) / w{i} * 2) AS BIGINT), 1) * {1 << i}" for i, a in enumerate("xyz")) + " AS INTEGER) AS rank FROM k, box")
add("part_uniform", lambda spark, sf_dir: P.process_grid(spark, 36), "SELECT * FROM (VALUES (1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1), (4, 2, 2, 1), (6, 3, 2, 1), (8, 2, 2, 2), (9, 3, 3, 1), (12, 3, 2, 2), (16, 4, 2, 2), (18, 3, 3, 2), (24, 4, 3, 2), (27, 3, 3, 3), (32, 4, 4, 2), (36, 4, 3, 3)) t(n, px, py, pz)")
_BISECT = """WITH {b}, s0 AS (SELECT body_id, x, y, z, 0 AS rank FROM b),
{levels} SELECT body_id, CAST(rank AS INTEGER) AS rank FROM s3"""
_LEVEL = """e{n} AS (SELECT rank, MAX(x) - MIN(x) AS wx, MAX(y) - MIN(y) AS wy, MAX(z) - MIN(z) AS wz FROM s{n} GROUP BY rank),
v{n} AS (SELECT s.*, CASE WHEN wx >= wy AND wx >= wz THEN x WHEN wy >= wz THEN y ELSE z END AS v FROM s{n} s JOIN e{n} e ON e.rank = s.rank),
o{n} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rank ORDER BY v, body_id) AS rn, COUNT(*) OVER (PARTITION BY rank) AS m FROM v{n}),
s{m} AS (SELECT body_id, x, y, z, rank * 2 + CASE WHEN rn > m // 2 THEN 1 ELSE 0 END AS rank FROM o{n})"""
add("part_bisection", lambda spark, sf_dir: P.bisection(B.parts(spark, sf_dir), 3).select("body_id", "rank"), _BISECT.format(b=B.SQL["parts"], levels=",\n".join(_LEVEL.format(n=n, m=n + 1) for n in range(3))))
add("part_unpartition", lambda spark, sf_dir: P.numbered(P.octsection(B.parts(spark, sf_dir), T.bounding_box(B.parts(spark, sf_dir), 3, "tight"), 3), ["body_id"], "place").select("body_id", "place"), f"WITH {B.SQL['parts']} SELECT body_id, ROW_NUMBER() OVER (ORDER BY body_id) - 1 AS place FROM b")
add("sort_unsort", lambda spark, sf_dir: P.numbered(_sorted(spark, sf_dir), ["body_id"], "original").select("body_id", "original", "place"), f"{_PLACES} SELECT body_id, ROW_NUMBER() OVER (ORDER BY body_id) - 1 AS original, place FROM p")

# sorts, limits and scans
add("sort_by_keys", lambda spark, sf_dir: _keyed(spark, sf_dir, "parts").select("key", "body_id").orderBy("key", "body_id"), f"WITH {S.keyed('parts')} SELECT key, body_id FROM k")


def _placed(spark: SparkSession, sf_dir: str, order: list[str]) -> DataFrame:
    cell, rank = K3.prefix(F.col("key"), 1).alias("cell"), F.pmod("body_id", F.lit(4)).alias("rank")
    return P.numbered(_keyed(spark, sf_dir).select("body_id", "key", cell, rank), order, "place").select("body_id", "place")


for _n, _o in (("sort_by_perm", ["key", "body_id"]), ("sort_counting", ["cell", "body_id"]), ("sort_irank", ["rank", "body_id"]), ("sort_ibody", ["body_id"])):
    add(_n, lambda spark, sf_dir, o=_o: _placed(spark, sf_dir, o),
        f"WITH {S.keyed('b3')}, q AS (SELECT body_id, key, {S.prefix('key', '1')} AS cell, body_id % 4 AS rank FROM k) SELECT body_id, ROW_NUMBER() OVER (ORDER BY {', '.join(_o)}) - 1 AS place FROM q")
# the digits of the key, most significant first, then places in that order
_DIGITS = [f"d{i}" for i in range(4)]
add("sort_radix", lambda spark, sf_dir: P.numbered(_keyed(spark, sf_dir, "parts").select("body_id", *(F.shiftright("key", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).alias(d) for i, d in enumerate(_DIGITS))), [*_DIGITS, "body_id"], "place"),
    f"WITH {S.keyed('parts')} SELECT body_id, {', '.join(f'(key >> {48 - 16 * i}) & 65535 AS {d}' for i, d in enumerate(_DIGITS))}, ROW_NUMBER() OVER (ORDER BY key, body_id) - 1 AS place FROM k")
add("lim_first_n", lambda spark, sf_dir: B.b3(spark, sf_dir).select("body_id").orderBy("body_id").limit(100), f"WITH {B.SQL['b3']} SELECT body_id FROM b ORDER BY body_id LIMIT 100")
add("lim_stride", lambda spark, sf_dir: P.strided(B.b3(spark, sf_dir).select("body_id"), "body_id", 100), f"WITH {B.SQL['b3']}, n AS (SELECT body_id, ROW_NUMBER() OVER (ORDER BY body_id) - 1 AS n, COUNT(*) OVER () AS m FROM b) SELECT body_id FROM n WHERE n % GREATEST(m // 100, 1) = 0 AND n // GREATEST(m // 100, 1) < 100")
add("lim_np_check", lambda spark, sf_dir: B.parts(spark, sf_dir).agg(F.least(F.lit(100), F.count("*")).alias("n")), f"WITH {B.SQL['parts']} SELECT LEAST(100, COUNT(*)) AS n FROM b")


def _leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_of(spark, sf_dir, "lineitems").leaves().select("key", "nb")


_LEAF = f"WITH {S.tree('lineitems', 16)}, l AS (SELECT key, nb FROM cells WHERE is_leaf)"
add("win_inclusive_scan", lambda spark, sf_dir: P.scan(_leaf_counts(spark, sf_dir), "key", "nb", "scan"), f"{_LEAF} SELECT key, nb, CAST(SUM(nb) OVER (ORDER BY key) AS BIGINT) AS scan FROM l")
_OPS = {"min": "MIN(nb)", "max": "MAX(nb)", "minus": "2 * FIRST(nb) - SUM(nb)"}


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running results of several operators over the leaves' counts."""
    out = _leaf_counts(spark, sf_dir)
    for op in _OPS:
        out = P.scan(out, "key", "nb", op, op=op)
    return out


add("win_scan_operators", _scans, f"{_LEAF} SELECT key, nb, " + ", ".join(f"CAST({e.replace(')', ') OVER (ORDER BY key)')} AS BIGINT) AS {op}" for op, e in _OPS.items()) + " FROM l")
add("win_exclusive_scan", lambda spark, sf_dir: P.scan(_leaf_counts(spark, sf_dir), "key", "nb", "scan", inclusive=False), f"{_LEAF} SELECT key, nb, CAST(SUM(nb) OVER (ORDER BY key) - nb AS BIGINT) AS scan FROM l")
add("win_gpu_scan", lambda spark, sf_dir: P.scan(_leaf_counts(spark, sf_dir).withColumn("nb", (F.col("nb") > 0).cast("long")), "key", "nb", "scan"), f"{_LEAF} SELECT key, CAST(nb > 0 AS BIGINT) AS nb, CAST(SUM(CAST(nb > 0 AS BIGINT)) OVER (ORDER BY key) AS BIGINT) AS scan FROM l")
add("win_octant_offset", lambda spark, sf_dir: tree_of(spark, sf_dir).cells.where("parent >= 0").select("key", "parent", "nb", (F.sum("nb").over(Window.partitionBy("parent").orderBy("key")) - F.col("nb")).alias("offset")),
    f"WITH {S.tree('b3', 16)} SELECT key, parent, nb, CAST(SUM(nb) OVER (PARTITION BY parent ORDER BY key) - nb AS BIGINT) AS \"offset\" FROM cells WHERE parent >= 0")
add("win_histogram_scan", lambda spark, sf_dir: P.scan(B.parts(spark, sf_dir).groupBy(F.floor(F.col("x") * 16).alias("bin")).agg(F.count("*").alias("n")), "bin", "n", "scan"), f"WITH {B.SQL['parts']}, h AS (SELECT CAST(FLOOR(x * 16) AS BIGINT) AS bin, COUNT(*) AS n FROM b GROUP BY 1) SELECT bin, n, CAST(SUM(n) OVER (ORDER BY bin) AS BIGINT) AS scan FROM h")
add("win_body_index", lambda spark, sf_dir: _sorted(spark, sf_dir).select("body_id", F.col("place").alias("ibody")), f"{_PLACES} SELECT body_id, place AS ibody FROM p")
