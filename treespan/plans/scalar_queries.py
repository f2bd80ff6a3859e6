"""Queries of the scalar functions: keys, vectors and geometry, over all bodies of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.functions import geometry as G
from treespan.functions import keys as K
from treespan.functions import vectors as V
from treespan.operators.partition import scan
from treespan.operators.tree import bounding_box, with_keys
from treespan.plans import sql as S
from treespan.plans.registry import add
from treespan.sources import bodies as B

K3 = K.Keys(3)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with the finest key, a cell key `c` of a depth by id, and the next body's as `c2`."""
    b = B.b3(spark, sf_dir)
    out = with_keys(b, bounding_box(b), K3)
    key, i = F.col("key"), F.col("body_id")
    return out.withColumns({"c": K3.prefix(key, F.pmod(i, F.lit(20)).cast("int")), "c2": K3.prefix(key, F.pmod(i * 7, F.lit(20)).cast("int")), "i8": F.pmod(i, F.lit(8)), "d0": F.pmod(i, F.lit(12)).cast("int"), "ci": K3.prefix(key, F.pmod(i, F.lit(12)).cast("int"))})


_SQL = f"""WITH {S.keyed('b3')}, q AS (SELECT body_id, x, y, z, src, lo0, w0, a0, a1, a2, key,
 {S.prefix('key', 'body_id % 20')} AS c, {S.prefix('key', '(body_id * 7) % 20')} AS c2, body_id % 8 AS i8, body_id % 12 AS d0, {S.prefix('key', 'body_id % 12')} AS ci
 FROM k, box)
SELECT body_id, """


def _scalar(name: str, sql: str, cols: Callable[[], tuple[Column, ...]]) -> None:
    """Columns are made when the query runs: making them takes a session."""
    add(name, lambda spark, sf_dir: _keyed(spark, sf_dir).select("body_id", *cols()), _SQL + sql + " FROM q")


def _as(col: Column, name: str = "v", kind: str = "long") -> Column:
    return col.cast(kind).alias(name)




def _c() -> Column:
    return F.col("c")


def _c2() -> Column:
    return F.col("c2")


def _key() -> Column:
    return F.col("key")


def _ci() -> Column:
    return F.col("ci")


_d = S.depth("c")

_scalar("key_get_depth", f"{_d} AS v", lambda: (_as(K3.depth(_c())),))
_scalar("key_next", f"c + (1::BIGINT << {S.below(_d)}) AS v, (ci + 1) + ((body_id % 5) << {S.below(S.depth('ci') + ' + 1')}) AS w", lambda: (_as(K3.next(_c())), _as(K3.next(K3.first_child(_ci()), F.pmod("body_id", F.lit(5))), "w"),))
_scalar("key_append_depth", "(((c >> 5) << 5) | 7) AS v", lambda: (_as(K3.append_depth(K3.remove_depth(_c()), 7)),))
_scalar("key_remove_depth", "(c >> 5) AS v", lambda: (_as(K3.remove_depth(_c())),))
_scalar("key_incr_depth", "c + 1 AS v", lambda: (_as(K3.incr_depth(_c(), 1)),))
_scalar("key_msbits", "(key >> 56) AS v", lambda: (_as(K3.msbits(_key(), 6)),))
_scalar("key_is_descendant", f"((c & 31) < (key & 31) AND {S.prefix('key', 'c & 31')} = c) AS v, ((c & 31) < (c2 & 31) AND (c2 >> {S.below('c & 31')}) = (c >> {S.below('c & 31')})) AS w", lambda: (K3.is_descendant(_c(), _key()).alias("v"), K3.is_descendant(_c(), _c2()).alias("w"),))
_scalar("key_clear_desc", f"{S.prefix('(key & ~31::BIGINT) | d0', 'd0')} AS v", lambda: (_as(K3.clear_descendants(K3.remove_depth(_key()) * 32 + F.col("d0"))),))
_scalar("key_parent", f"CASE WHEN {_d} = 0 THEN 0 ELSE {S.prefix('c', f'GREATEST({_d} - 1, 0)')} END AS v", lambda: (_as(K3.parent(_c())),))
_scalar("key_first_child", "ci + 1 AS v", lambda: (_as(K3.first_child(_ci())),))
_scalar("key_child", f"((ci + 1) | (i8 << {S.below('(ci & 31) + 1')})) AS v", lambda: (_as(K3.child(_ci(), F.col("i8"))),))
_scalar("key_encode", f"((({S.interleave(3)}) << 5) | 19) AS v", lambda: (_as(_key()),))
_scalar("key_quantize", "a0, a1, a2", lambda: (*(_as(K3.index(_key(), i), f"a{i}") for i in range(3)),))
_scalar("key_dir", ", ".join(f"((key >> {S.below('(body_id % 19) + 1')} >> {i}) & 1) AS v{i}" for i in range(3)), lambda: (*(_as(K3.direction(_key(), i, F.pmod("body_id", F.lit(19)).cast("int") + 1), f"v{i}") for i in range(3)),))
_scalar("key_desc_range", f"(c >> 5) AS v, ((c >> 5) + (1::BIGINT << (3 * (19 - {_d})))) AS w", lambda: (_as(K3.remove_depth(_c())), _as(K3.remove_depth(K3.last(_c())) + 1, "w"),))
_scalar("key_overlapped", f"((c >> 5) < ((c2 >> 5) + (1::BIGINT << (3 * (19 - (c2 & 31))))) AND (c2 >> 5) < ((c >> 5) + (1::BIGINT << (3 * (19 - {_d}))))) AS v", lambda: (K3.overlapped(_c(), K3.next(_c()), _c2(), K3.next(_c2())).alias("v"),))
_scalar("key_includes_range", f"((c >> 5) <= (c2 >> 5) AND (c2 >> 5) + (1::BIGINT << (3 * (19 - (c2 & 31)))) <= (c >> 5) + (1::BIGINT << (3 * (19 - {_d})))) AS v", lambda: (K3.includes_range(_c(), K3.next(_c()), _c2()).alias("v"),))
_scalar("key_includes", f"((c & 31) <= (c2 & 31) AND (c2 >> {S.below('c & 31')}) = (c >> {S.below('c & 31')})) AS v", lambda: (K3.includes(_c(), _c2()).alias("v"),))
_scalar("key_decode", "CONCAT('0', " + ", ".join(f"CASE WHEN {_d} >= {l} THEN CONCAT('-', {', '.join(f'CAST((c >> {3 * (19 - l) + 5 + b}) & 1 AS VARCHAR)' for b in (2, 1, 0))}) ELSE '' END" for l in range(1, 20)) + f", '<', CAST({_d} AS VARCHAR), '>') AS v", lambda: (K3.decoded(_c()).alias("v"),))
_scalar("key_simplify", "CONCAT(SUBSTR(LPAD(CAST(c AS VARCHAR), 20, '0'), 1, 4), '..', SUBSTR(LPAD(CAST(c AS VARCHAR), 20, '0'), 17, 4)) AS v", lambda: (K3.simplified(_c()).alias("v"),))
_scalar("key_describe", f"CONCAT(SUBSTR(LPAD(CAST(c AS VARCHAR), 20, '0'), 1, 4), '..', SUBSTR(LPAD(CAST(c AS VARCHAR), 20, '0'), 17, 4), ' ', CAST({_d} AS VARCHAR)) AS v", lambda: (F.concat_ws(" ", K3.simplified(_c()), K3.depth(_c()).cast("string")).alias("v"),))
_legacy_sql = [
    f"{_d} AS depth", f"c + (1::BIGINT << {S.below(_d)}) AS nxt", "(c >> 5) AS bits", "c + 1 AS deeper", "ci + 1 AS first",
    f"((ci + 1) | (i8 << {S.below('(ci & 31) + 1')})) AS child", f"CASE WHEN {_d} = 0 THEN 0 ELSE {S.prefix('c', f'GREATEST({_d} - 1, 0)')} END AS parent",
    f"((c & 31) < (key & 31) AND {S.prefix('key', 'c & 31')} = c) AS under", f"{S.prefix('(key & ~31::BIGINT) | d0', 'd0')} AS cleared",
    *(f"{S.index('c', i)} AS a{i}" for i in range(3)),
]


def _legacy() -> tuple[Column, ...]:
    """All functions on keys as plain numbers, one beside the other."""
    return (
        _as(K3.depth(_c()), "depth"), _as(K3.next(_c()), "nxt"), _as(K3.remove_depth(_c()), "bits"), _as(K3.incr_depth(_c(), 1), "deeper"), _as(K3.first_child(_ci()), "first"),
        _as(K3.child(_ci(), F.col("i8")), "child"), _as(K3.parent(_c()), "parent"), K3.is_descendant(_c(), _key()).alias("under"), _as(K3.clear_descendants(K3.remove_depth(_key()) * 32 + F.col("d0")), "cleared"),
        *(_as(K3.index(_c(), i), f"a{i}") for i in range(3)),
    )


_scalar("key_legacy", ", ".join(_legacy_sql), _legacy)
_scalar("key_min_bitlen", "CASE WHEN a0 = 0 THEN 0 ELSE CAST(FLOOR(LOG2(a0)) AS BIGINT) + 1 END AS v", lambda: (_as(K.min_bit_length(K3.index(_key(), 0))),))
_a5 = lambda: [K.shr(K3.index(_key(), i), 14) for i in range(3)]
_b5 = "(" + " | ".join(f"((((a{i} >> 14) >> {b}) & 1) << {3 * b + i})" for b in range(5) for i in range(3)) + ")"
_scalar("key_levelwise", f"4681 + {_b5} AS v", lambda: (_as(K.levelwise(_a5(), F.lit(5))),))
_scalar("key_uniform_leaf", f"{_b5} AS v", lambda: (_as(K.uniform_leaf(_a5())),))


def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _keyed(spark, sf_dir)
    box = bounding_box(B.b3(spark, sf_dir))
    cols = []
    for i, a in enumerate("xyz"):
        lo, hi = K3.region(_c(), i, F.lit(box.low[i]), F.lit(box.width[i]))
        cols += [(F.round(lo, 6) + 0.0).alias(f"lo{a}"), (F.round(hi, 6) + 0.0).alias(f"hi{a}")]
    return q.select("body_id", *cols)


add("key_region", _region, _SQL + ", ".join(f"ROUND(lo0 + {S.index('c', i)} * (w0 / POWER(2.0::DOUBLE, {_d})), 6) + 0.0 AS lo{a}, ROUND(lo0 + ({S.index('c', i)} + 1) * (w0 / POWER(2.0::DOUBLE, {_d})), 6) + 0.0 AS hi{a}" for i, a in enumerate("xyz")) + " FROM q")
add("key_depth_bits", lambda spark, sf_dir: spark.range(1).select(F.lit(K.DEPTH_BITS).alias("v")), "SELECT 5 AS v")
add("key_max_depth", lambda spark, sf_dir: spark.range(1).select(F.lit(K.MAX_DEPTH[2]).alias("two"), F.lit(K.MAX_DEPTH[3]).alias("three")), "SELECT 29 AS two, 19 AS three")
add("key_children", lambda spark, sf_dir: _keyed(spark, sf_dir).select("body_id", F.posexplode(K3.children(_ci())).alias("i", "v")).withColumn("i", F.col("i").cast("long")),
    f"{_SQL} i, ((ci + 1) | (i << {S.below('(ci & 31) + 1')})) AS v FROM q, (SELECT UNNEST(range(0, 8)) AS i)")
add("key_ancestors", lambda spark, sf_dir: _keyed(spark, sf_dir).select("body_id", F.posexplode(K3.ancestors(_c())).alias("d", "v")).withColumn("d", F.col("d").cast("long")),
    f"{_SQL} d, {S.prefix('c', 'd')} AS v FROM q, (SELECT UNNEST(range(0, 20)) AS d) WHERE d <= {_d}")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _keyed(spark, sf_dir).select("body_id", "key")
    return q.join(q.select((F.col("body_id") - 1).alias("body_id"), F.col("key").alias("other")), "body_id")


add("key_finest_ancestor", lambda spark, sf_dir: _neighbours(spark, sf_dir).select("body_id", K3.finest_ancestor(_key(), F.col("other")).alias("v")),
    f"{_SQL[:-16]}, pr AS (SELECT p.body_id, p.key AS x1, r.key AS x2 FROM q p JOIN q r ON r.body_id = p.body_id + 1) SELECT body_id, MAX({S.prefix('x1', 'd')} + 0) AS v FROM (SELECT body_id, x1, x2, d, MAX(d) OVER (PARTITION BY body_id) AS m FROM pr, (SELECT UNNEST(range(0, 20)) AS d) WHERE {S.prefix('x1', 'd')} = {S.prefix('x2', 'd')}) WHERE d = m GROUP BY body_id")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell of depth 2: how many keys come before it, and how many lie in it."""
    q = _keyed(spark, sf_dir).select("key")
    cells = q.select(K3.prefix(_key(), 2).alias("cell")).distinct()
    counts = q.groupBy(K3.prefix(_key(), 2).alias("at")).agg(F.count("*").alias("n"))
    both = cells.join(counts, F.col("at") <= F.col("cell"))
    return both.groupBy("cell").agg(F.sum(F.when(F.col("at") < F.col("cell"), F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("at") == F.col("cell"), F.col("n")).otherwise(0)).alias("len"))


_RANGES = f"WITH {S.keyed('b3')}, c AS (SELECT DISTINCT {S.prefix('key', '2')} AS cell FROM k) SELECT cell, CAST(COUNT(*) FILTER (WHERE k.key < cell) AS BIGINT) AS pos, CAST(COUNT(*) FILTER (WHERE k.key >= cell AND k.key < cell + (1::BIGINT << 56)) AS BIGINT) AS len FROM c, k GROUP BY cell"
add("key_find_range", _ranges, _RANGES)


def _body_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell of depth 3 under those with bodies: the places of its bodies, (0, 0) where it has none."""
    q = _keyed(spark, sf_dir).select("key")
    counts = q.groupBy(K3.prefix(_key(), 3).alias("cell")).agg(F.count("*").alias("len"))
    every = q.select(K3.prefix(_key(), 2).alias("up")).distinct().select(F.explode(K3.children(F.col("up"))).alias("cell"))
    at = scan(counts, "cell", "len", "pos", inclusive=False)
    return every.join(at, "cell", "left").select("cell", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("len", F.lit(0)).alias("len"))


add("key_body_range", _body_ranges, f"WITH {S.keyed('b3')}, n AS (SELECT {S.prefix('key', '3')} AS cell, COUNT(*) AS len FROM k GROUP BY 1), s AS (SELECT cell, len, CAST(SUM(len) OVER (ORDER BY cell) - len AS BIGINT) AS pos FROM n), u AS (SELECT DISTINCT {S.prefix('key', '2')} AS up FROM k), e AS (SELECT ((up + 1) | (i << {S.below('3')})) AS cell FROM u, (SELECT UNNEST(range(0, 8)) AS i)) SELECT e.cell, COALESCE(s.pos, 0) AS pos, COALESCE(s.len, 0) AS len FROM e LEFT JOIN s ON s.cell = e.cell")


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells between the depth-2 cells of the least and the greatest key."""
    from treespan.operators.tree import complete_region

    lo, hi = _keyed(spark, sf_dir).agg(F.min(K3.prefix(_key(), 2)), F.max(K3.prefix(_key(), 2))).first()
    return spark.createDataFrame([(k, k & 31) for k in complete_region(lo, hi, K3)], "key long, depth long")


# a cell is in the cover if it lies between and its parent doesn't
add("key_complete_region", _completed, f"""WITH {S.keyed('b3')}, e AS (SELECT MIN({S.prefix('key', '2')}) AS lo, MAX({S.prefix('key', '2')}) AS hi FROM k),
c AS (SELECT ((i << {S.below('d')}) | d) AS key, i, d FROM (SELECT UNNEST(range(0, 64)) AS i), (SELECT UNNEST(range(1, 3)) AS d) WHERE i < POWER(8, d)),
f AS (SELECT c.key, d, ((c.key >> 5) << 5) >= ((lo >> 5) << 5) + (1::BIGINT << 56) AND ((c.key >> 5) << 5) + (1::BIGINT << {S.below('d')}) <= ((hi >> 5) << 5) AS inside,
 ((((c.key >> 59) << 59)) >= ((lo >> 5) << 5) + (1::BIGINT << 56) AND (((c.key >> 59) << 59)) + (1::BIGINT << 59) <= ((hi >> 5) << 5)) AS up FROM c, e)
SELECT key, CAST(d AS BIGINT) AS depth FROM f WHERE inside AND (d = 1 OR NOT up)""")  # fmt: skip


# vectors and geometry: v is a body, u the next one, boxes are of half-widths by strength
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.b3(spark, sf_dir)
    u = b.select((F.col("body_id") - 1).alias("body_id"), *(F.col(a).alias(f"u{a}") for a in "xyz"), F.col("src").alias("usrc"))
    return b.join(u, "body_id")


_PAIRS = f"WITH {B.SQL['b3']}, q AS (SELECT p.body_id, p.x, p.y, p.z, p.src, r.x AS ux, r.y AS uy, r.z AS uz, r.src AS usrc FROM b p JOIN b r ON r.body_id = p.body_id + 1) SELECT body_id, "
_v = lambda: [F.col(a) for a in "xyz"]
_u = lambda: [F.col(f"u{a}") for a in "xyz"]


def _pair(name: str, sql: str, cols: Callable[[], tuple[Column, ...]]) -> None:
    add(name, lambda spark, sf_dir: _pairs(spark, sf_dir).select("body_id", *cols()), _PAIRS + sql + " FROM q")


def _r(c: Column, name: str = "v") -> Column:
    return (F.round(c, 6) + 0.0).alias(name)


def _rs(expr: str, name: str = "v") -> str:
    return f"ROUND({expr}, 6) + 0.0 AS {name}"


_floats = lambda v: [c.cast("float") for c in v]
_arith = ", ".join(_rs(e, f"{n}{a}") for a in "xyz" for n, e in (("neg", f"-{a}"), ("add", f"{a} + u{a}"), ("sub", f"{a} - u{a}"), ("mul", f"{a} * u{a}"), ("scale", f"{a} * src"), ("div", f"{a} / src")))
_arith_cols = lambda: [_r(c, f"{n}{a}") for i, a in enumerate("xyz") for n, c in (("neg", V.neg(_v())[i]), ("add", V.add(_v(), _u())[i]), ("sub", V.sub(_v(), _u())[i]), ("mul", V.mul(_v(), _u())[i]), ("scale", V.mul(_v(), F.col("src"))[i]), ("div", V.div(_v(), F.col("src"))[i]))]
_pair("vec_arith", _arith, lambda: (*_arith_cols(),))
# element by element in single precision; and scaling and adding in the plane
_pair("cvec_arith", ", ".join(f"CAST(CAST({a} AS FLOAT) {o} CAST(u{a} AS FLOAT) AS DOUBLE) AS {n}{a}" for a in "xyz" for n, o in (("add", "+"), ("sub", "-"), ("mul", "*"))),
      lambda: (*(c[i].cast("float").cast("double").alias(f"{n}{a}") for i, a in enumerate("xyz") for n, c in (("add", V.add(_floats(_v()), _floats(_u()))), ("sub", V.sub(_floats(_v()), _floats(_u()))), ("mul", V.mul(_floats(_v()), _floats(_u()))))),))
_pair("pyvec_arith", ", ".join(_rs(e, f"{n}{a}") for a in "xy" for n, e in (("mult", f"{a} * src"), ("add", f"{a} * src + u{a}"))), lambda: (*(c for i, a in enumerate("xy") for c in (_r(V.mul(_v(), F.col("src"))[i], f"mult{a}"), _r(V.add(V.mul(_v(), F.col("src")), _u())[i], f"add{a}"))),))
_pair("vec_cmp", "(x > ux AND y > uy AND z > uz) AS gt, (x <= ux AND y <= uy AND z <= uz) AS le", lambda: (V.gt(_v(), _u()).alias("gt"), V.le(_v(), _u()).alias("le"),))
_pair("vec_norm2", _rs("x * x + y * y + z * z"), lambda: (_r(V.norm2(_v())),))
_pair("vec_sum", _rs("x + y + z"), lambda: (_r(V.total(_v())),))
_pair("cvec_reduce", _rs("x + y + z", "s") + ", " + _rs("x * y * z", "p"), lambda: (_r(V.total(_v()), "s"), _r(V.product(_v()), "p"),))
_pair("pyvec_distance_r2", _rs("(x - ux) * (x - ux) + (y - uy) * (y - uy) + (z - uz) * (z - uz)"), lambda: (_r(V.norm2(V.sub(_v(), _u()))),))
_pair("vec_setmax_min", ", ".join(f"GREATEST({a}, u{a}) AS hi{a}, LEAST({a}, u{a}) AS lo{a}" for a in "xyz"), lambda: (*(c.alias(n) for i, a in enumerate("xyz") for n, c in ((f"hi{a}", V.largest(_v(), _u())[i]), (f"lo{a}", V.least(_v(), _u())[i]))),))
_pair("vec_print", "CONCAT('(', " + ", ', ', ".join(f"CAST(CAST(FLOOR({a} * 1000) AS BIGINT) AS VARCHAR)" for a in "xyz") + ", ')') AS v", lambda: (V.printed([F.floor(c * 1000) for c in _v()]).alias("v"),))
_pair("evec_norms", f"{_rs('x * x + y * y + z * z', 'n')}, LEAST(x, y, z) AS lo, GREATEST(x, y, z) AS hi, {_rs('1 / SQRT(x * x + y * y + z * z)', 'rs')}", lambda: (_r(V.norm2(_v()), "n"), F.least(*_v()).alias("lo"), F.greatest(*_v()).alias("hi"), _r(V.rsqrt([V.norm2(_v())])[0], "rs"),))
_wrapped = lambda: V.wrap([c * 2 for c in _v()], F.lit(1.5))
_wsql = lambda a: f"CASE WHEN {a} * 2 < -0.75::DOUBLE THEN {a} * 2 + 1.5::DOUBLE WHEN {a} * 2 > 0.75::DOUBLE THEN {a} * 2 - 1.5::DOUBLE ELSE {a} * 2 END"
_pair("evec_wrap", ", ".join(_rs(_wsql(a), f"w{a}") for a in "xyz") + ", " + " + ".join(f"CASE WHEN {a} * 2 < -0.75::DOUBLE THEN {1 << 2 * i} WHEN {a} * 2 > 0.75::DOUBLE THEN {2 << 2 * i} ELSE 0 END" for i, a in enumerate("xyz")) + " AS mask", lambda: (*(_r(c, f"w{a}") for a, c in zip("xyz", _wrapped()[0])), _as(_wrapped()[1], "mask", "int"),))
_pair("evec_unwrap", ", ".join(_rs(f"{a} * 2", f"w{a}") for a in "xyz"), lambda: (*(_r(c, f"w{a}") for a, c in zip("xyz", V.unwrap(_wrapped()[0], F.lit(1.5), _wrapped()[1]))),))

_box = lambda: G.Box([c - F.col("src") for c in _v()], [c + F.col("src") for c in _v()])
_ubox = lambda: G.Box([c - F.col("usrc") for c in _u()], [c + F.col("usrc") for c in _u()])
_lo, _hi = (lambda a: f"({a} - src)"), (lambda a: f"({a} + src)")
_ul, _uh = (lambda a: f"(u{a} - usrc)"), (lambda a: f"(u{a} + usrc)")
_pair("geo_region_width_center", ", ".join(f"{_rs(f'{_hi(a)} - {_lo(a)}', 'w' + a)}, {_rs(f'({_hi(a)} + {_lo(a)}) / 2', 'c' + a)}" for a in "xyz"), lambda: (*(c for i, a in enumerate("xyz") for c in (_r(_box().width(i), f"w{a}"), _r(_box().centre(i), f"c{a}"))),))
_pair("geo_partition_bsp", ", ".join(_rs(f"CASE WHEN (body_id >> {i}) & 1 = 1 THEN {a} ELSE {a} - src END", f"lo{a}") + ", " + _rs(f"CASE WHEN (body_id >> {i}) & 1 = 1 THEN {a} + src ELSE {a} END", f"hi{a}") for i, a in enumerate("xyz")),
      lambda: (*(c for i, a in enumerate("xyz") for c in (_r(_box().part(F.col("body_id")).low[i], f"lo{a}"), _r(_box().part(F.col("body_id")).high[i], f"hi{a}"))),))
_pair("geo_contains", " AND ".join(f"u{a} >= {_lo(a)} AND u{a} < {_hi(a)}" for a in "xyz") + " AS v", lambda: (_box().contains(_u()).alias("v"),))
_pair("geo_separated", "NOT (" + " AND ".join(f"{_lo(a)} < {_uh(a)} AND {_ul(a)} < {_hi(a)}" for a in "xyz") + ") AS v", lambda: (G.separated(_box(), _ubox()).alias("v"),))
_pair("geo_includes", " AND ".join(f"{_lo(a)} <= {_ul(a)} AND {_uh(a)} <= {_hi(a)}" for a in "xyz") + " AS v", lambda: (G.includes(_box(), _ubox()).alias("v"),))
_pair("geo_dist_center", _rs("(x - ux) * (x - ux) + (y - uy) * (y - uy) + (z - uz) * (z - uz)"), lambda: (_r(G.centre_distance2(_box(), _ubox())),))
# the target's centre slides toward the source's, at most to the face of its box
_slide = lambda a: f"GREATEST(ABS({a} - u{a}) - src, 0)"
_pair("geo_dist_approx", _rs(" + ".join(f"POWER({_slide(a)}, 2)" for a in "xyz")), lambda: (_r(G.slid_distance2(_box(), _ubox())),))
_near = lambda a: f"GREATEST({_lo(a)} - u{a}, u{a} - {_hi(a)}, 0)"
_pair("geo_point_box_dist", _rs(" + ".join(f"POWER({_near(a)}, 2)" for a in "xyz")), lambda: (_r(G.point_distance2(_box(), _u())),))
_pair("geo_bounds2box", ", ".join(_rs(f"(GREATEST({a}, u{a}) + LEAST({a}, u{a})) / 2", f"c{a}") for a in "xyz") + ", " + _rs("GREATEST(" + ", ".join(f"ABS({a} - u{a}) / 2" for a in "xyz") + ") * 1.00001::DOUBLE", "r"),
      lambda: (*(_r(c, f"c{a}") for a, c in zip("xyz", G.Box(V.least(_v(), _u()), V.largest(_v(), _u())).as_cube()[0])), _r(G.Box(V.least(_v(), _u()), V.largest(_v(), _u())).as_cube()[1], "r"),))
_pair("sph_cart2sph", f"{_rs('SQRT(x * x + y * y + z * z)', 'r')}, {_rs('ACOS(z / SQRT(x * x + y * y + z * z))', 'theta')}, {_rs('ATAN2(y, x)', 'phi')}", lambda: (*(_r(c, n) for n, c in zip(("r", "theta", "phi"), G.spherical(_v()))),))
_pair("sph_sph2cart", ", ".join(_rs(a, f"g{a}") for a in "xyz"), lambda: (*(_r(c, f"g{a}") for a, c in zip("xyz", G.cartesian(*G.spherical(_v()), F.lit(1.0), F.lit(0.0), F.lit(0.0), scale=G.spherical(_v())[0]))),))
_pair("math_smax_smin_spow", "GREATEST(x, y, z) AS hi, LEAST(x, y, z) AS lo, " + _rs("POWER(src, 3)", "p"), lambda: (F.greatest(*_v()).alias("hi"), F.least(*_v()).alias("lo"), _r(F.pow(F.col("src"), 3), "p"),))
_pair("math_kahan", _rs("x + y + z + src"), lambda: (_r(V.kahan(F.array(*_v(), F.col("src")))),))
_pair("str_join", "CONCAT_WS(',', CAST(body_id AS VARCHAR), CAST(body_id + 1 AS VARCHAR)) AS v", lambda: (V.joined(",", F.col("body_id"), F.col("body_id") + 1).alias("v"),))
_pair("str_basename", "CONCAT('f', CAST(body_id AS VARCHAR), '.cc') AS v", lambda: (V.basename(F.concat(F.lit("/a/b/f"), F.col("body_id").cast("string"), F.lit(".cc"))).alias("v"),))
