"""Pieces of SQL for the registered queries' oracles, written apart from the column expressions they check."""

from __future__ import annotations

from math import factorial, pi

from treespan.sources.bodies import SQL as BODIES

MAX = {2: 29, 3: 19}
AXES = ("x", "y", "z")


def below(d: str, dim: int = 3) -> str:
    return f"({dim} * ({MAX[dim]} - ({d})) + 5)"


def prefix(k: str, d: str, dim: int = 3) -> str:
    s = below(d, dim)
    return f"(((({k}) >> {s}) << {s}) | ({d}))"


def depth(k: str) -> str:
    return f"(({k}) & 31)"


def interleave(dim: int) -> str:
    """Of anchor columns a0, a1(, a2)."""
    return " | ".join(f"(((a{i} >> {b}) & 1) << {dim * b + i})" for b in range(MAX[dim]) for i in range(dim))


def index(k: str, i: int, dim: int = 3) -> str:
    """A cell's integer coordinate: a bit of each level down to its own, from the finest up."""
    bits = " + ".join(f"(((({k}) >> {dim * b + i + 5}) & 1) << {b})" for b in range(MAX[dim]))
    return f"(({bits}) >> CAST({MAX[dim]} - {depth(k)} AS BIGINT))"


def keyed(view: str, dim: int = 3, box: str = "cube") -> str:
    """CTEs b (bodies), box and k (bodies with key)."""
    ax = AXES[:dim]
    if box == "cube":
        lo, hi = "LEAST(" + ", ".join(f"MIN({a})" for a in ax) + ")", "GREATEST(" + ", ".join(f"MAX({a})" for a in ax) + ")"
        bounds = ", ".join(f"{lo} AS lo{i}, {hi} - {lo} AS w{i}" for i in range(dim))
    else:
        bounds = ", ".join(f"MIN({a}) AS lo{i}, MAX({a}) - MIN({a}) AS w{i}" for i, a in enumerate(ax))
    n = 1 << MAX[dim]
    anchors = ", ".join(f"LEAST(CAST(FLOOR(({a} - lo{i}) / (w{i} / {n}.0::DOUBLE)) AS BIGINT), {n - 1}) AS a{i}" for i, a in enumerate(ax))
    return f"""{BODIES[view]}, box AS (SELECT {bounds} FROM b),
anchored AS (SELECT b.*, {anchors} FROM b, box),
k AS (SELECT anchored.*, ((({interleave(dim)}) << 5) | {MAX[dim]}) AS key FROM anchored)"""


def tree(view: str, ncrit: int, dim: int = 3, box: str = "cube", empty: bool = True, deepest: int | None = None) -> str:
    """CTEs up to cells (key, parent, depth, is_leaf, nb)."""
    deepest = MAX[dim] if deepest is None else deepest
    child = f"((c.key + 1) | (i << {below('(c.key & 31) + 1', dim)}))"
    return f"""{keyed(view, dim, box)},
finest AS MATERIALIZED (SELECT key, COUNT(*) AS nb FROM k GROUP BY key),
counts AS MATERIALIZED (SELECT {prefix('key', 'd', dim)} AS key, CAST(SUM(nb) AS BIGINT) AS nb FROM finest, (SELECT UNNEST(range(0, {deepest + 1})) AS d) GROUP BY 1),
below AS (SELECT c.key AS parent, {child} AS key FROM counts c, (SELECT UNNEST(range(0, {1 << dim})) AS i) WHERE c.nb > {ncrit} AND (c.key & 31) < {deepest}),
grown AS (SELECT 0::BIGINT AS key, -1::BIGINT AS parent, (SELECT SUM(nb) FROM finest) AS nb
 UNION ALL SELECT below.key, below.parent, COALESCE(counts.nb, 0) AS nb FROM below {'LEFT' if empty else 'INNER'} JOIN counts ON counts.key = below.key),
cells AS (SELECT key, parent, CAST(key & 31 AS INTEGER) AS depth, (nb <= {ncrit} OR (key & 31) >= {deepest}) AS is_leaf, CAST(nb AS BIGINT) AS nb FROM grown)"""


def geometry(dim: int = 3) -> str:
    """CTE g: cells with centres and widths."""
    cols = ", ".join(f"lo{i} + ({index('key', i, dim)} + 0.5::DOUBLE) * (w{i} / POWER(2.0::DOUBLE, depth)) AS c{a}, w{i} / POWER(2.0::DOUBLE, depth) AS s{i}" for i, a in enumerate(AXES[:dim]))
    return f"g AS (SELECT cells.*, {cols} FROM cells, box)"


def dual(theta: float, dim: int = 3) -> str:
    """Recursive CTE walk (i, j, state) after geometry; state is far, near or split."""
    d2 = " + ".join(f"(a.c{x} - b.c{x}) * (a.c{x} - b.c{x})" for x in AXES[:dim])
    w = lambda t: "GREATEST(" + ", ".join(f"{t}.s{i}" for i in range(dim)) + ") / 2 * 1.00001::DOUBLE"
    return f"""n AS (SELECT key, is_leaf, {', '.join('c' + x for x in AXES[:dim])}, {w('g')} AS r, parent FROM g),
walk AS (
 SELECT 0::BIGINT AS i, 0::BIGINT AS j
 UNION ALL
 SELECT CASE WHEN p.si THEN ch.key ELSE p.i END, CASE WHEN p.si THEN p.j ELSE ch.key END
 FROM (SELECT walk.i, walk.j, CASE WHEN b.is_leaf THEN TRUE WHEN a.is_leaf THEN FALSE ELSE a.r >= b.r END AS si
  FROM walk JOIN n a ON a.key = walk.i JOIN n b ON b.key = walk.j
  WHERE NOT ({d2} > (a.r / {theta}::DOUBLE + b.r / {theta}::DOUBLE) * (a.r / {theta}::DOUBLE + b.r / {theta}::DOUBLE)) AND NOT (a.is_leaf AND b.is_leaf)) p
 JOIN n ch ON ch.parent = CASE WHEN p.si THEN p.i ELSE p.j END),
pairs AS (SELECT walk.i, walk.j, CASE WHEN {d2} > (a.r / {theta}::DOUBLE + b.r / {theta}::DOUBLE) * (a.r / {theta}::DOUBLE + b.r / {theta}::DOUBLE) THEN 'far' WHEN a.is_leaf AND b.is_leaf THEN 'near' ELSE 'split' END AS state
 FROM walk JOIN n a ON a.key = walk.i JOIN n b ON b.key = walk.j)"""


def dual_mutual(theta: float, dim: int = 3) -> str:
    """As dual, each unordered pair looked at once: a pair of a cell with itself is split on both sides."""
    d2 = " + ".join(f"(a.c{x} - b.c{x}) * (a.c{x} - b.c{x})" for x in AXES[:dim])
    far = f"{d2} > POWER((a.r + b.r) / {theta}::DOUBLE, 2)"
    return f"""n AS (SELECT key, parent, is_leaf, {', '.join('c' + x for x in AXES[:dim])}, GREATEST({', '.join(f's{i}' for i in range(dim))}) / 2 * 1.00001::DOUBLE AS r FROM g),
opened AS (SELECT parent AS key, key AS at, TRUE AS split FROM n UNION ALL SELECT key, key AS at, FALSE AS split FROM n),
walk AS (
 SELECT 0::BIGINT AS i, 0::BIGINT AS j
 UNION ALL
 SELECT ca.at, cb.at
 FROM (SELECT walk.i, walk.j, CASE WHEN b.is_leaf THEN TRUE WHEN a.is_leaf THEN FALSE ELSE a.r >= b.r END AS si
  FROM walk JOIN n a ON a.key = walk.i JOIN n b ON b.key = walk.j WHERE NOT ({far}) AND NOT (a.is_leaf AND b.is_leaf)) p
 JOIN opened ca ON ca.key = p.i AND ca.split = (p.i = p.j OR p.si)
 JOIN opened cb ON cb.key = p.j AND cb.split = (p.i = p.j OR NOT p.si)
 WHERE p.i <> p.j OR ca.at <= cb.at),
met AS (SELECT walk.i, walk.j, CASE WHEN {far} THEN 'far' ELSE 'near' END AS state FROM walk JOIN n a ON a.key = walk.i JOIN n b ON b.key = walk.j WHERE {far} OR (a.is_leaf AND b.is_leaf)),
pairs AS (SELECT i, j, state FROM met UNION ALL SELECT j, i, state FROM met WHERE i <> j)"""


def body_walk(theta: float, dim: int = 3) -> str:
    """Recursive CTE of (body, cell) pairs after geometry: acts (i, j, state), far or near."""
    d2 = " + ".join(f"(n.c{x} - t.{x}) * (n.c{x} - t.{x})" for x in AXES[:dim])
    state = f"CASE WHEN n.is_leaf THEN 'near' WHEN n.s0 < {theta}::DOUBLE * SQRT({d2}) THEN 'far' ELSE 'split' END"
    ax = ", ".join(f"t.{x}" for x in AXES[:dim])
    return f"""n AS (SELECT * FROM g WHERE nb > 0),
walk AS (
 SELECT t.body_id AS i, 0::BIGINT AS j, {state} AS state, {ax} FROM b t JOIN n ON n.key = 0
 UNION ALL
 SELECT t.i, n.key, {state}, {ax} FROM walk t JOIN n ON n.parent = t.j WHERE t.state = 'split'),
acts AS (SELECT i, j, state FROM walk WHERE state <> 'split')"""


def rounded(expr: str, digits: int = 6) -> str:
    return f"ROUND({expr}, {digits}) + 0.0"


def erfc(x: str, terms: int = 70) -> str:
    """One less the error function, by its series of positive terms alone; for a column between 0 and 4."""
    said = "1.0::DOUBLE"
    for n in range(terms, 0, -1):
        said = f"(1.0::DOUBLE + {x} * {x} * {2 / (2 * n + 1)!r}::DOUBLE * {said})"
    return f"(1.0::DOUBLE - {2 / pi**0.5!r}::DOUBLE * {x} * EXP(-{x} * {x}) * {said})"


# expansions, from their definitions: polynomials over powers of r, made by differentiating, not by recurrences in r
def multi(order: int) -> list[tuple[int, int, int]]:
    """Multi-indices of degree below an order, by degree."""
    return [(i, j, n - i - j) for n in range(order) for i in range(n, -1, -1) for j in range(n - i, -1, -1)]


def _plus(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(x + y for x, y in zip(a, b))


def _power(names: tuple[str, ...], a: tuple[int, ...]) -> str:
    """The product of names to powers."""
    return " * ".join(n for n, p in zip(names, a) for _ in range(p)) or "1.0::DOUBLE"


def monomial(names: tuple[str, ...], a: tuple[int, ...]) -> str:
    """d^a / a!."""
    return f"({_power(names, a)}) / {factorial(a[0]) * factorial(a[1]) * factorial(a[2])}"


def inverse_r(a: tuple[int, ...], names: tuple[str, ...] = ("rx", "ry", "rz"), r2: str = "r2") -> str:
    """The derivative of 1 / r by a multi-index: a polynomial over r^(2 n + 1)."""
    poly, n = {(0, 0, 0): 1}, 0
    for axis in (k for k in range(3) for _ in range(a[k])):
        unit = [tuple(int(i == k) for i in range(3)) for k in range(3)]
        out: dict[tuple[int, ...], int] = {}
        for e, c in poly.items():
            if e[axis]:
                lower = tuple(p - (i == axis) for i, p in enumerate(e))
                for u in unit:
                    t = _plus(_plus(lower, u), u)
                    out[t] = out.get(t, 0) + c * e[axis]
            t = _plus(e, unit[axis])
            out[t] = out.get(t, 0) - (2 * n + 1) * c
        poly, n = {e: c for e, c in out.items() if c}, n + 1
    said = " + ".join(f"{c} * {_power(names, e)}" for e, c in poly.items()) or "0"
    return f"({said}) / (SQRT({r2}) * POWER({r2}, {n}))"


def expansions(order: int) -> str:
    """CTEs after pairs (of dual): mm (key, centre, m0..), lo (key, l0..) of targets, lv (key, centre, l0..) of leaves."""
    terms = multi(order)
    at = {a: i for i, a in enumerate(terms)}
    d = ("(g.cx - k.x)", "(g.cy - k.y)", "(g.cz - k.z)")
    m = ", ".join(f"SUM(k.src * {monomial(d, a)}) AS m{i}" for a, i in at.items())
    local = ", ".join("SUM(" + " + ".join(f"m{j} * d{at[_plus(a, b)]}" for b, j in at.items() if _plus(a, b) in at) + f") AS l{i}" for a, i in at.items())
    down = ("(f.cx - g.cx)", "(f.cy - g.cy)", "(f.cz - g.cz)")
    shift = ", ".join("SUM(" + " + ".join(f"l{at[_plus(a, b)]} * {monomial(down, b)}" for b in at if _plus(a, b) in at) + f") AS l{i}" for a, i in at.items())
    return f"""ex AS (SELECT k.*, {prefix('key', 'd')} AS cell FROM k, (SELECT UNNEST(range(0, 20)) AS d)),
mm AS MATERIALIZED (SELECT g.key, g.cx, g.cy, g.cz, {m} FROM ex k JOIN g ON g.key = k.cell GROUP BY g.key, g.cx, g.cy, g.cz),
fv AS (SELECT p.i, mm.*, g.cx - mm.cx AS rx, g.cy - mm.cy AS ry, g.cz - mm.cz AS rz FROM pairs p JOIN g ON g.key = p.i JOIN mm ON mm.key = p.j WHERE p.state = 'far'),
fr AS (SELECT fv.*, rx * rx + ry * ry + rz * rz AS r2 FROM fv),
fd AS MATERIALIZED (SELECT fr.*, {', '.join(f'{inverse_r(a)} AS d{i}' for a, i in at.items())} FROM fr),
lo AS MATERIALIZED (SELECT i AS key, {local} FROM fd GROUP BY i),
lv AS MATERIALIZED (SELECT f.key, f.cx, f.cy, f.cz, {shift}
 FROM g f JOIN g ON g.depth <= f.depth AND (f.key >> {below('g.depth')}) = (g.key >> {below('g.depth')}) JOIN lo ON lo.key = g.key WHERE f.is_leaf AND f.nb > 0 GROUP BY f.key, f.cx, f.cy, f.cz)"""


def at_bodies(order: int) -> str:
    """CTE fb (body_id, pot, acc_x, acc_y, acc_z) after expansions: the leaves' local expansions at their bodies."""
    terms = multi(order)
    at = {a: i for i, a in enumerate(terms)}
    d = ("(k.x - lv.cx)", "(k.y - lv.cy)", "(k.z - lv.cz)")
    pot = " + ".join(f"l{i} * {monomial(d, a)}" for a, i in at.items())
    unit = [tuple(int(i == k) for i in range(3)) for k in range(3)]
    acc = ", ".join(" + ".join(f"l{at[_plus(a, unit[k])]} * {monomial(d, a)}" for a in terms if _plus(a, unit[k]) in at) + f" AS acc_{x}" for k, x in enumerate(AXES))
    return f"fb AS (SELECT k.body_id, {pot} AS pot, {acc} FROM lv JOIN k ON (k.key >> {below('(lv.key & 31)')}) = (lv.key >> {below('(lv.key & 31)')}))"


def near_bodies() -> str:
    """CTE nbod (body_id, pot, acc_x..) after pairs: sums over the bodies of near leaves."""
    return f"""lb AS (SELECT k.body_id, k.x, k.y, k.z, k.src, c.key AS leaf FROM k, cells c WHERE c.is_leaf AND c.nb > 0 AND (k.key >> {below('c.depth')}) = (c.key >> {below('c.depth')})),
nq AS (SELECT t.body_id, s.src, s.x - t.x AS x, s.y - t.y AS y, s.z - t.z AS z, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) AS r2 FROM pairs p JOIN lb t ON t.leaf = p.i JOIN lb s ON s.leaf = p.j WHERE p.state = 'near'),
nbod AS (SELECT body_id, SUM(CASE WHEN r2 <> 0 THEN src / SQRT(r2) ELSE 0 END) AS pot, {', '.join(f'SUM(CASE WHEN r2 <> 0 THEN {a} * src / (SQRT(r2) * r2) ELSE 0 END) AS acc_{a}' for a in AXES)} FROM nq GROUP BY body_id)"""
