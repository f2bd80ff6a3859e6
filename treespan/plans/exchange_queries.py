"""Queries of products of cells, of filters, and of what owners of parts exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.operators import exchange as E
from treespan.operators import expansions as X
from treespan.operators import kernels as K
from treespan.operators import partition as P
from treespan.operators import periodic
from treespan.operators import traverse as V
from treespan.operators import tree as T
from treespan.plans import sql as S
from treespan.plans.force_queries import AX, _dual_sql, rounded
from treespan.plans.lineage import small
from treespan.plans.registry import add
from treespan.plans.tree_queries import K3, _HEADS, _LOCAL, _keyed, _owned_tree, tree_of
from treespan.sources import bodies as B

_TREE = f"WITH {S.tree('b3', 16)}"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_of(spark, sf_dir).cells


# products
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).where("depth = 1").select("key", "nb")


def _product(spark: SparkSession, sf_dir: str, how: str = "all") -> DataFrame:
    a = _top(spark, sf_dir).withColumnsRenamed({"key": "i", "nb": "a"})
    b = _top(spark, sf_dir).withColumnsRenamed({"key": "j", "nb": "b"})
    pairs = a.crossJoin(F.broadcast(b))  # eight children of the root each
    if how == "once":
        pairs = pairs.where("i <= j")
    return pairs.select("i", "j", (F.col("a") * F.col("b")).alias("pairs"))


_PRODUCT = f"{_TREE} SELECT p.key AS i, q.key AS j, p.nb * q.nb AS pairs FROM cells p, cells q WHERE p.depth = 1 AND q.depth = 1"
add("join_product", _product, _PRODUCT)
add("join_product_dedup", lambda spark, sf_dir: _product(spark, sf_dir, "once"), f"{_PRODUCT} AND p.key <= q.key")


def _mutual_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of bodies under pairs of cells that were each looked at in one order only: all."""
    t = tree_of(spark, sf_dir)
    p = V.dual(t, 0.8, mutual=True)
    nb = t.cells.select("key", "nb")
    every = p.far.union(p.near).join(nb.select(F.col("key").alias("i"), F.col("nb").alias("a")), "i").join(nb.select(F.col("key").alias("j"), F.col("nb").alias("b")), "j")
    return every.agg(F.sum(F.col("a") * F.col("b")).alias("covered"))


add("join_product_mutual_cover", _mutual_cover, "SELECT COUNT(*) * COUNT(*) AS covered FROM embeddings")
# a cell's number when children come before parents, and when parents come first
add("map_preorder", lambda spark, sf_dir: P.numbered(_cells(spark, sf_dir).select("key", K3.remove_depth(F.col("key")).alias("at"), "depth"), ["at", "depth"], "place").select("key", "place"), f"{_TREE} SELECT key, ROW_NUMBER() OVER (ORDER BY key >> 5, depth) - 1 AS place FROM cells")
add("map_postorder", lambda spark, sf_dir: P.numbered(_cells(spark, sf_dir).select("key", K3.remove_depth(K3.last(F.col("key"))).alias("at"), (-F.col("depth")).alias("up")), ["at", "up"], "place").select("key", "place"),
    f"{_TREE} SELECT key, ROW_NUMBER() OVER (ORDER BY (key >> 5) + (1::BIGINT << (3 * (19 - depth))), depth DESC) - 1 AS place FROM cells")

# filters
add("flt_positive", lambda spark, sf_dir: B.b3c(spark, sf_dir).where("src >= 0").select("body_id", "src"), f"WITH {B.SQL['b3c']} SELECT body_id, src FROM b WHERE src >= 0")
add("flt_negative", lambda spark, sf_dir: B.b3c(spark, sf_dir).where("src < 0").select("body_id", "src"), f"WITH {B.SQL['b3c']} SELECT body_id, src FROM b WHERE src < 0")
add("flt_leaf", lambda spark, sf_dir: _cells(spark, sf_dir).where("is_leaf").select("key", "nb"), f"{_TREE} SELECT key, nb FROM cells WHERE is_leaf")
add("flt_root", lambda spark, sf_dir: _cells(spark, sf_dir).where("key = 0").select("key", "nb"), f"{_TREE} SELECT key, nb FROM cells WHERE parent < 0")
add("flt_local", lambda spark, sf_dir: _owned_tree(spark, sf_dir).where("local").select("key", "nb"), f"{_LOCAL} SELECT key, nb FROM marked WHERE local")
add("flt_owner_mask", lambda spark, sf_dir: B.b3(spark, sf_dir).withColumn("icpumap", F.pmod("body_id", F.lit(2))).where("icpumap = 1").select("body_id"), f"WITH {B.SQL['b3']} SELECT body_id FROM b WHERE body_id % 2 = 1")


def _gpu_mac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves against cells: near if the centre of mass lies within l / theta + s of the leaf's box, or of few bodies."""
    t = tree_of(spark, sf_dir)
    g = t.with_geometry(t.cells.where("nb > 0"))
    com = K.moments(t).select("key", *(F.col(a).alias(f"m{a}") for a in AX))
    src = g.join(com, "key")
    reach = F.col("w0") / 0.4 + F.sqrt(sum(((F.col(f"m{a}") - F.col(f"c{a}")) * (F.col(f"m{a}") - F.col(f"c{a}")) for a in AX), F.lit(0.0)))
    src = src.select(F.col("key").alias("j"), "nb", reach.alias("reach"), *(f"m{a}" for a in AX))
    trg = g.where("is_leaf").select(F.col("key").alias("i"), *(F.col(f"c{a}").alias(f"t{a}") for a in AX), F.col("w0").alias("tw"))
    d = [F.greatest(F.abs(F.col(f"m{a}") - F.col(f"t{a}")) - F.col("tw") / 2, F.lit(0.0)) for a in AX]
    near = (sum((x * x for x in d), F.lit(0.0)) < F.col("reach") * F.col("reach")) | (F.col("nb") < 3)
    return trg.crossJoin(small(src, t.n_cells)).groupBy("i").agg(F.count("*").alias("cells"), F.sum(near.cast("long")).alias("near"))


_COMS = f"m AS (SELECT {S.prefix('key', 'd')} AS key, SUM(src) AS mass, SUM(x * src) AS sx, SUM(y * src) AS sy, SUM(z * src) AS sz FROM k, (SELECT UNNEST(range(0, 20)) AS d) GROUP BY 1), j AS (SELECT g.*, sx / mass AS mx, sy / mass AS my, sz / mass AS mz FROM g JOIN m ON m.key = g.key)"
_GPU = " + ".join(f"POWER(GREATEST(ABS(j.m{a} - t.c{a}) - t.s0 / 2, 0), 2)" for a in AX)
_OFFSET = " + ".join(f"POWER(j.m{a} - j.c{a}, 2)" for a in AX)
add("flt_mac_gpu", _gpu_mac, f"{_TREE}, {S.geometry()}, {_COMS} SELECT t.key AS i, COUNT(*) AS cells, CAST(SUM(CASE WHEN {_GPU} < POWER(j.s0 / 0.4::DOUBLE + SQRT({_OFFSET}), 2) OR j.nb < 3 THEN 1 ELSE 0 END) AS BIGINT) AS near FROM g t, j WHERE t.is_leaf AND t.nb > 0 GROUP BY t.key")


def _close(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree_of(spark, sf_dir)
    g = t.with_geometry(t.leaves().where("nb > 0"))
    centres = g.select(F.col("key").alias("body_id"), *(F.col(f"c{x}").alias(x) for x in AX))
    # a leaf is close to itself, too
    near = periodic.pairs_within(centres, centres, 0.2, want=("body_id", "other")).select(F.col("body_id").alias("i"), F.col("other").alias("j"))
    return near.union(centres.select(F.col("body_id").alias("i"), F.col("body_id").alias("j")))


add("flt_mac_proto", _close, f"{_TREE}, {S.geometry()} SELECT p.key AS i, q.key AS j FROM g p, g q WHERE p.is_leaf AND q.is_leaf AND p.nb > 0 AND q.nb > 0 AND {' + '.join(f'(p.c{a} - q.c{a}) * (p.c{a} - q.c{a})' for a in AX)} < 0.2::DOUBLE * 0.2::DOUBLE")


def _rmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest distance of a leaf's bodies from its centre, at most the half diagonal."""
    t = tree_of(spark, sf_dir)
    g = t.with_geometry(t.leaves()).select(F.col("key").alias("leaf"), *(f"c{a}" for a in AX))
    d2 = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in AX), F.lit(0.0))
    return rounded(t.bodies_in_leaves().join(g, "leaf").groupBy(F.col("leaf").alias("key")).agg(F.sqrt(F.max(d2)).alias("rmax")), "key")


add("flt_rmax", _rmax, f"{_TREE}, {S.geometry()} SELECT g.key, ROUND(SQRT(MAX({' + '.join(f'(k.{a} - g.c{a}) * (k.{a} - g.c{a})' for a in AX)})), 6) + 0.0 AS rmax FROM g JOIN k ON (k.key >> {S.below('g.depth')}) = (g.key >> {S.below('g.depth')}) WHERE g.is_leaf GROUP BY g.key")


def _ropt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells' radii over an opening that balances errors: x solves x^(p+2) - x^(p+1) = c q^(-2/3), by five Newton steps from x = 1 / theta + 1."""
    t = tree_of(spark, sf_dir)
    order, theta = 6, 0.4
    total = B.b3(spark, sf_dir).agg(F.sum("src")).first()[0]
    c = (1 - theta) ** 2 / theta ** (order + 2) / total ** (1 / 3)
    m = K.moments(t).select("key", F.pow("mass", F.lit(1 / 3)).alias("q"))
    f = lambda x, q: (x * x - 2 * x + 1) * F.pow(x, order) - F.lit(c) * q
    df = lambda x: (order + 2) * F.pow(x, order + 1) - 2 * (order + 1) * F.pow(x, order) + order * F.pow(x, order - 1)
    x = m.withColumn("x", F.lit(1 / theta))
    for _ in range(5):
        x = x.withColumn("x", F.col("x") - f(F.col("x"), F.col("q")) / df(F.col("x")))
    return rounded(x.select("key", "x"), "key", digits=5)


_ST = "s{n} AS (SELECT key, q, c, x - ((x * x - 2 * x + 1) * POWER(x, 6) - c * q) / (8 * POWER(x, 7) - 14 * POWER(x, 6) + 6 * POWER(x, 5)) AS x FROM s{m})"
add("flt_ropt", _ropt, f"{_TREE}, {S.geometry()}, {_COMS}, s0 AS (SELECT j.key, POWER(m.mass, 1.0::DOUBLE / 3) AS q, {0.6 ** 2 / 0.4 ** 8!r}::DOUBLE / POWER((SELECT SUM(src) FROM b), 1.0::DOUBLE / 3) AS c, 2.5::DOUBLE AS x FROM j JOIN m ON m.key = j.key), {', '.join(_ST.format(n=i + 1, m=i) for i in range(5))} SELECT key, ROUND(x, 5) + 0.0 AS x FROM s5")

# joins of cells of one level
_L3 = f"WITH {S.keyed('b3')}, c AS (SELECT DISTINCT {S.prefix('key', '3')} AS key FROM k), l AS (SELECT key, {', '.join(f'{S.index("key", i)} AS {a}' for i, a in enumerate(AX))} FROM c)"


def _level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select(K3.prefix(F.col("key"), 3).alias("key")).distinct()


_NEXT = " AND ".join(f"ABS(p.{a} - q.{a}) <= 1" for a in AX)
_UPNEXT = " AND ".join(f"ABS((p.{a} >> 1) - (q.{a} >> 1)) <= 1" for a in AX)
add("join_uniform_p2p", lambda spark, sf_dir: E.neighbours(K3, _level(spark, sf_dir), 3), f"{_L3} SELECT p.key AS i, q.key AS j FROM l p, l q WHERE {_NEXT}")
# what owners of octants get from others at the borders
add("exch_uniform", lambda spark, sf_dir: E.requests(E.neighbours(K3, _level(spark, sf_dir), 3), K3.prefix(F.col("i"), 1), K3.prefix(F.col("j"), 1)), f"{_L3} SELECT DISTINCT {S.prefix('p.key', '1')} AS owner, q.key FROM l p, l q WHERE {_NEXT} AND (p.key >> 59) <> (q.key >> 59)")
add("join_uniform_m2l", lambda spark, sf_dir: E.far_lists(K3, _level(spark, sf_dir), 3), f"{_L3} SELECT p.key AS i, q.key AS j FROM l p, l q WHERE {_UPNEXT} AND NOT ({_NEXT})")
add("join_m2l_parentpairs", lambda spark, sf_dir: (lambda c: c.select(F.col("key").alias("i"), K3.prefix(F.col("key"), 1).alias("g")).join(c.select(F.col("key").alias("j"), K3.prefix(F.col("key"), 1).alias("g")), "g").where(K3.parent(F.col("i")) != K3.parent(F.col("j"))).select("i", "j"))(_level(spark, sf_dir)),
    f"{_L3} SELECT p.key AS i, q.key AS j FROM l p, l q WHERE (p.key >> 59) = (q.key >> 59) AND (p.key >> 56) <> (q.key >> 56)")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves as target groups against cells, by their centres, down to accepted cells or leaves."""
    t = tree_of(spark, sf_dir)
    g = t.with_geometry(t.leaves().where("nb > 0")).select(F.col("key").alias("body_id"), *(F.col(f"c{a}").alias(a) for a in AX))
    p = V.by_bodies(t, 0.4, targets=g)
    return p.far.select("i", "j", F.lit("far").alias("state")).union(p.near.select("i", "j", F.lit("near").alias("state")))


add("join_gpu_m2p", _groups, f"WITH RECURSIVE {S.tree('b3', 16)}, {S.geometry()}, t0 AS (SELECT key AS body_id, cx AS x, cy AS y, cz AS z FROM g WHERE is_leaf AND nb > 0), {S.body_walk(0.4).replace('FROM b t JOIN', 'FROM t0 t JOIN')} SELECT i, j, state FROM acts")

# owners
_SQL16 = f"WITH RECURSIVE {S.tree('b3', 16)}, {S.geometry()}, {_HEADS}"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.heads(_keyed(spark, sf_dir), K3, 8)


def _needed(spark: SparkSession, sf_dir: str) -> tuple[T.Tree, DataFrame, DataFrame]:
    """Pairs of the dual traversal with the owners of target and source."""
    t = tree_of(spark, sf_dir)
    p = V.dual(t, 0.4)
    heads = _heads(spark, sf_dir)
    pairs = p.far.select("i", "j", F.lit("far").alias("state")).union(p.near.select("i", "j", F.lit("near").alias("state")))
    pairs = P.owned(P.owned(pairs, heads, "i").withColumnRenamed("rank", "oi"), heads, "j").withColumnRenamed("rank", "oj")
    return t, heads, pairs


_PAIRS = f"{_SQL16}, {S.dual(0.4)}, oc AS (SELECT c.key, CAST(MAX(rank) AS INTEGER) AS o FROM cells c JOIN h ON h.head <= c.key GROUP BY c.key), op AS (SELECT p.i, p.j, p.state, a.o AS oi, e.o AS oj FROM pairs p JOIN oc a ON a.key = p.i JOIN oc e ON e.key = p.j WHERE p.state <> 'split')"
add("join_let_exact", lambda spark, sf_dir: E.requests(_needed(spark, sf_dir)[2], F.col("oi"), F.col("oj")), f"{_PAIRS} SELECT DISTINCT oi AS owner, j AS key FROM op WHERE oi <> oj")
# far cells are asked for by their attributes, near ones by their bodies
add("exch_let_request", lambda spark, sf_dir: _needed(spark, sf_dir)[2].where("oi <> oj").select(F.col("oi").alias("owner"), F.col("oj").alias("of"), F.col("j").alias("key"), F.when(F.col("state") == "far", "attribute").otherwise("bodies").alias("what")).distinct(),
    f"{_PAIRS} SELECT DISTINCT oi AS owner, oj AS of, j AS key, CASE WHEN state = 'far' THEN 'attribute' ELSE 'bodies' END AS what FROM op WHERE oi <> oj")


def _anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that owners need and don't own."""
    t, heads, pairs = _needed(spark, sf_dir)
    local = P.owned(t.cells.select("key"), heads).select(F.col("rank").alias("owner"), "key")
    return E.missing(pairs.select(F.col("oi").alias("owner"), F.col("j").alias("key")).distinct(), local)


for _n in ("join_let_anti", "set_except"):
    add(_n, _anti, f"{_PAIRS} SELECT oi AS owner, j AS key FROM op EXCEPT SELECT o, key FROM oc")
add("set_uniq", lambda spark, sf_dir: _needed(spark, sf_dir)[2].select("j").distinct(), f"{_PAIRS} SELECT DISTINCT j FROM op")
add("exch_comm_matrix", lambda spark, sf_dir: E.matrix(_needed(spark, sf_dir)[2], "oj", "oi"), f"{_PAIRS} SELECT oj, oi, COUNT(*) AS rows FROM op GROUP BY oj, oi")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a finer tree with the nearest ancestor that the tree has."""
    fine = tree_of(spark, sf_dir, "b3", 4).cells.select("key")
    return E.responses(fine, _cells(spark, sf_dir), K3)


_FINE = f"{_TREE}, fine AS (SELECT 0::BIGINT AS key UNION ALL SELECT ((c.key + 1) | (i << {S.below('(c.key & 31) + 1')})) AS key FROM counts c, (SELECT UNNEST(range(0, 8)) AS i) WHERE c.nb > 4 AND (c.key & 31) < 19)"
_FOUND = f"{_FINE}, r AS (SELECT f.key, c.key AS found, ROW_NUMBER() OVER (PARTITION BY f.key ORDER BY c.depth DESC) AS n FROM fine f JOIN cells c ON c.depth <= (f.key & 31) AND (f.key >> {S.below('c.depth')}) = (c.key >> {S.below('c.depth')}))"
add("join_nearest_ancestor", _answered, f"{_FOUND} SELECT key, found FROM r WHERE n = 1")
add("exch_let_response", lambda spark, sf_dir: _answered(spark, sf_dir).join(_cells(spark, sf_dir).select(F.col("key").alias("found"), "nb"), "found").select("key", "found", "nb"), f"{_FOUND} SELECT r.key, r.found, c.nb FROM r JOIN cells c ON c.key = r.found WHERE n = 1")
add("exch_let_register", lambda spark, sf_dir: _answered(spark, sf_dir).select("found").union(_cells(spark, sf_dir).where("depth < 2").select("key")).distinct().withColumnRenamed("found", "key"), f"{_FOUND} SELECT found AS key FROM r WHERE n = 1 UNION SELECT key FROM cells WHERE depth < 2")
add("join_key_attr", lambda spark, sf_dir: (lambda t: rounded(t.cells.select("key", "nb").join(K.moments(t).select("key", "mass"), "key"), "key", "nb"))(tree_of(spark, sf_dir)), f"{_TREE}, {S.geometry()}, {_COMS} SELECT c.key, c.nb, ROUND(m.mass, 6) + 0.0 AS mass FROM cells c JOIN m ON m.key = c.key")
add("join_key_bodies", lambda spark, sf_dir: tree_of(spark, sf_dir).bodies_in_leaves().select(F.col("leaf").alias("key"), "body_id"), f"{_TREE} SELECT c.key, k.body_id FROM cells c JOIN k ON (k.key >> {S.below('c.depth')}) = (c.key >> {S.below('c.depth')}) WHERE c.is_leaf")


def _sent(spark: SparkSession, sf_dir: str, nearest: bool) -> DataFrame:
    """Cells that each octant of the root's may need."""
    t = tree_of(spark, sf_dir)
    boxes = t.with_geometry(t.cells.where("depth = 1")).select(F.col("key").alias("box"), *(c for i, a in enumerate(AX) for c in ((F.col(f"c{a}") - F.col(f"w{i}") / 2).alias(f"lo{a}"), (F.col(f"c{a}") + F.col(f"w{i}") / 2).alias(f"hi{a}"))))
    return E.conservative(t, boxes, 0.4, nearest)


def _sent_sql(d2: str) -> str:
    return f"""{_TREE}, {S.geometry()}, st AS (SELECT e.key AS box, q.key, NOT ({d2} <= POWER(GREATEST(q.s0, q.s1, q.s2) / 2 * 1.00001::DOUBLE / 0.4::DOUBLE, 2)) OR q.is_leaf AS closed FROM g e, g q WHERE e.depth = 1)
SELECT s.box, s.key FROM st s WHERE NOT EXISTS (SELECT 1 FROM st u WHERE u.box = s.box AND u.closed AND (u.key & 31) < (s.key & 31) AND (s.key >> {S.below('(u.key & 31)')}) = (u.key >> {S.below('(u.key & 31)')}))"""


add("join_let_oneside", lambda spark, sf_dir: _sent(spark, sf_dir, False), _sent_sql("(" + " + ".join(f"POWER(GREATEST(ABS(e.c{a} - q.c{a}) - e.s{i} / 2, 0), 2)" for i, a in enumerate(AX)) + ")"))
add("join_let_upstream", lambda spark, sf_dir: _sent(spark, sf_dir, True), _sent_sql("(" + " + ".join(f"POWER(GREATEST(e.c{a} - e.s{i} / 2 - q.c{a}, q.c{a} - e.c{a} - e.s{i} / 2, 0), 2)" for i, a in enumerate(AX)) + ")"))
_UPSTREAM = _sent_sql("(" + " + ".join(f"POWER(GREATEST(e.c{a} - e.s{i} / 2 - q.c{a}, q.c{a} - e.c{a} - e.s{i} / 2, 0), 2)" for i, a in enumerate(AX)) + ")")


def _sent_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per octant of the root's: the bodies that others send it, those of the leaves among the cells it may need."""
    t = tree_of(spark, sf_dir)
    leaves = _sent(spark, sf_dir, True).join(t.leaves().select("key"), "key").where(K3.prefix(F.col("key"), 1) != F.col("box"))
    return leaves.join(t.bodies_in_leaves().select(F.col("leaf").alias("key"), "body_id"), "key").select("box", "body_id")


add("exch_upstream", _sent_bodies, _UPSTREAM.replace("SELECT s.box, s.key FROM st s WHERE", ", snt AS (SELECT s.box, s.key FROM st s WHERE") + f") SELECT snt.box, k.body_id FROM snt JOIN cells c ON c.key = snt.key JOIN k ON (k.key >> {S.below('c.depth')}) = (c.key >> {S.below('c.depth')}) WHERE c.is_leaf AND (snt.key >> 59) <> (snt.box >> 59)")
add("join_let_graft", lambda spark, sf_dir: E.graft(_level(spark, sf_dir), K3), f"{_L3}, e AS (SELECT DISTINCT {S.prefix('key', 'd')} AS key FROM c, (SELECT UNNEST(range(0, 4)) AS d)) SELECT key, CASE WHEN key = 0 THEN -1 ELSE {S.prefix('key', 'GREATEST((key & 31) - 1, 0)')} END AS parent FROM e")

# messages among four ranks, as rows
def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.b3(spark, sf_dir).select("body_id", F.pmod("body_id", F.lit(4)).cast("int").alias("src_rank"), F.pmod(F.floor(F.col("body_id") / 4), F.lit(4)).cast("int").alias("dst_rank"))


_RANKED = f"WITH {B.SQL['b3']}, r AS (SELECT body_id, CAST(body_id % 4 AS INTEGER) AS src_rank, CAST((body_id // 4) % 4 AS INTEGER) AS dst_rank FROM b)"
add("exch_alltoall", lambda spark, sf_dir: _ranked(spark, sf_dir).groupBy("dst_rank", "src_rank").agg(F.count("*").alias("n"), F.min("body_id").alias("first")), f"{_RANKED} SELECT dst_rank, src_rank, COUNT(*) AS n, MIN(body_id) AS first FROM r GROUP BY 1, 2")
add("exch_alltoallv", lambda spark, sf_dir: _ranked(spark, sf_dir).repartition("dst_rank").sortWithinPartitions("dst_rank", "src_rank", "body_id"), f"{_RANKED} SELECT body_id, src_rank, dst_rank FROM r")
add("exch_allreduce", lambda spark, sf_dir: _ranked(spark, sf_dir).groupBy("src_rank").agg(F.sum("body_id").alias("v")).agg(F.sum("v").alias("total"), F.max("v").alias("most")), f"{_RANKED}, s AS (SELECT src_rank, SUM(body_id) AS v FROM r GROUP BY 1) SELECT CAST(SUM(v) AS BIGINT) AS total, CAST(MAX(v) AS BIGINT) AS most FROM s")
# in the order of their sources, with the place that each gets
add("exch_alltoallv2", lambda spark, sf_dir: E.received(_ranked(spark, sf_dir), "dst_rank", ["src_rank", "body_id"]), f"{_RANKED} SELECT body_id, src_rank, dst_rank, ROW_NUMBER() OVER (PARTITION BY dst_rank ORDER BY src_rank, body_id) - 1 AS place FROM r")


def _four(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.col("id").cast("int").alias("rank"))


def _gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rank's sum at the root, in order of ranks."""
    own = _ranked(spark, sf_dir).groupBy("src_rank").agg(F.sum("body_id").alias("v"))
    return own.agg(F.array_sort(F.collect_list(F.struct("src_rank", "v"))).alias("a")).select(F.lit(0).alias("rank"), F.posexplode("a.v").alias("place", "v"))


add("exch_gather", _gathered, f"{_RANKED}, s AS (SELECT src_rank, SUM(body_id) AS v FROM r GROUP BY 1) SELECT 0 AS rank, CAST(ROW_NUMBER() OVER (ORDER BY src_rank) - 1 AS INTEGER) AS place, CAST(v AS BIGINT) AS v FROM s")
add("exch_bcast", lambda spark, sf_dir: E.to_all(_ranked(spark, sf_dir).where("src_rank = 0").select("body_id"), _four(spark)), f"{_RANKED} SELECT body_id, CAST(q AS INTEGER) AS rank FROM r, (SELECT UNNEST(range(0, 4)) AS q) WHERE src_rank = 0")
add("exch_allgatherv", lambda spark, sf_dir: E.to_all(E.received(_ranked(spark, sf_dir).select("body_id", "src_rank", F.lit(0).alias("all")), "all", ["src_rank", "body_id"]).drop("all"), _four(spark)),
    f"{_RANKED}, p AS (SELECT body_id, src_rank, ROW_NUMBER() OVER (ORDER BY src_rank, body_id) - 1 AS place FROM r) SELECT body_id, src_rank, place, CAST(q AS INTEGER) AS rank FROM p, (SELECT UNNEST(range(0, 4)) AS q)")
add("exch_shift_bodies", lambda spark, sf_dir: _ranked(spark, sf_dir).select("body_id", F.pmod(F.col("src_rank") + 1, F.lit(4)).cast("int").alias("rank")), f"{_RANKED} SELECT body_id, CAST((src_rank + 1) % 4 AS INTEGER) AS rank FROM r")
add("set_concat", lambda spark, sf_dir: (lambda r: r.where("src_rank = 0").unionByName(r.where("src_rank = 1")).select("body_id", "src_rank"))(_ranked(spark, sf_dir)), f"{_RANKED} SELECT body_id, src_rank FROM r WHERE src_rank < 2")
