"""Functions of one's own over trees, against plain Python over the same bodies."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treespan.operators import mapping as M
from treespan.operators import traverse as V
from treespan.operators import tree as T
from treespan.sources import generate as G


@pytest.fixture(scope="module")
def tree(spark):
    return T.build_tree(G.random_masses(spark, 300, 7), 8)


@pytest.fixture(scope="module")
def cells(tree):
    return {r.key: r for r in tree.with_geometry().collect()}


@pytest.fixture(scope="module")
def bodies(tree):
    return {r.body_id: r for r in tree.bodies_in_leaves().collect()}


def above(cells, key):
    while key >= 0:
        yield key
        key = cells[key].parent


def test_bodies_see_their_leaf(tree, cells, bodies):
    got = {r.body_id: r for r in M.map_bodies(tree, lambda body, cell: {"dx": body("x") - cell("cx"), "nb": cell("nb")}).collect()}
    assert len(got) == 300
    for i, b in bodies.items():
        c = cells[b.leaf]
        assert got[i].nb == c.nb and abs(got[i].dx) <= c.w0 / 2 * (1 + 1e-9) and got[i].dx == b.x - c.cx


def test_counts_go_up(tree, cells, bodies):
    """Bodies at the leaves, sums of children above: the count of each cell."""
    leaf = lambda body: {"n": F.count(body("body_id")), "least": F.min(body("src"))}
    got = {r.key: r for r in M.upward(tree, leaf, lambda parent, child: {"n": F.sum(child("n")), "least": F.min(child("least"))}).collect()}
    assert {k: r.n for k, r in got.items()} == {k: c.nb for k, c in cells.items()}
    least = {}
    for b in bodies.values():
        for k in above(cells, b.leaf):
            least[k] = min(least.get(k, 1.0), b.src)
    assert all(r.least == least.get(k) for k, r in got.items())


def test_parents_are_seen_on_the_way_up(tree, cells):
    """A merge that depends on grouping: widths of the parents along the deepest way."""
    got = {r.key: r.way for r in M.upward(tree, lambda body: {"way": F.max(F.lit(0.0))}, lambda parent, child: {"way": F.max(child("way")) + parent("w0")}).collect()}

    def way(k):
        below = [c for c in cells.values() if c.parent == k]
        return max(way(c.key) for c in below) + cells[k].w0 if below else 0.0

    assert all(abs(v - way(k)) < 1e-12 for k, v in got.items())


def test_sums_go_down(tree, cells):
    got = {r.key: r.above for r in M.downward(tree, lambda cell: {"above": cell("nb")}, lambda parent, child: {"above": parent("above") + child("nb")}).collect()}
    assert got == {k: sum(cells[a].nb for a in above(cells, k)) for k in cells}
    with pytest.raises(ValueError):
        M.downward(tree, lambda cell: {"nb": cell("nb")}, lambda parent, child: {"nb": child("nb")})


def test_reduce_is_upward_of_what_can_be_merged(tree):
    up = M.upward(tree, lambda body: {"m": F.max(body("x"))}, lambda parent, child: {"m": F.max(child("m"))}).where("m is not null")
    assert dict(map(tuple, up.collect())) == dict(map(tuple, M.reduce(tree, lambda body: {"m": body("x")}, F.max).collect()))


def test_pairs_of_bodies(tree, bodies):
    p = V.dual(tree, 0.8)
    got = {r.body_id: r.n for r in M.map_pairs(tree, p.near, lambda a, b: {"n": F.count("*")}).collect()}
    by_leaf = {}
    for b in bodies.values():
        by_leaf.setdefault(b.leaf, []).append(b)
    want = {}
    for r in p.near.collect():
        for b in by_leaf.get(r.i, []):
            want[b.body_id] = want.get(b.body_id, 0) + len(by_leaf.get(r.j, []))
    assert got == {k: v for k, v in want.items() if v}


def test_products(spark, monkeypatch):
    a = spark.range(6).withColumn("g", F.col("id") % 2)
    rows = M.product(a, a, lambda x, y: {"i": x("id"), "j": y("id")}, ["g"], "id").collect()
    assert sorted(map(tuple, rows)) == [(i, j) for i in range(6) for j in range(i, 6) if (i - j) % 2 == 0]
    assert M.product(a, a, lambda x, y: {"i": x("id")}).count() == 36
    monkeypatch.setattr(M, "MOST_ROWS", 5)
    with pytest.raises(ValueError):
        M.product(a, a, lambda x, y: {"i": x("id")})


def test_own_rule_of_acceptance(tree, cells):
    """Whatever the rule, each ordered pair of bodies lies under one pair of cells."""
    p = V.dual(tree, accept=lambda d2, a, b: d2 > F.lit(6.0) * (a * a + b * b))
    assert sum(cells[r.i].nb * cells[r.j].nb for r in p.far.union(p.near).collect()) == 300 * 300
    for r in p.far.collect():
        a, b = cells[r.i], cells[r.j]
        d2 = sum((getattr(a, c) - getattr(b, c)) ** 2 for c in ("cx", "cy", "cz"))
        assert d2 > 6.0 * ((a.w0 / 2 * V.LEEWAY) ** 2 + (b.w0 / 2 * V.LEEWAY) ** 2)


def test_batches_and_leaves(tree, bodies):
    double = lambda b: pa.RecordBatch.from_arrays([b.column("body_id"), pa.compute.multiply(b.column("x"), 2.0)], names=["body_id", "v"])
    assert {r.body_id: r.v for r in M.map_batches(tree.bodies.select("body_id", "x"), double, "body_id long, v double").collect()} == {i: b.x * 2 for i, b in bodies.items()}
    size = lambda t: pa.table({"leaf": t.column("leaf").slice(0, 1), "n": pa.array([t.num_rows])})
    got = {r.leaf: r.n for r in M.map_leaves(tree, size, "leaf long, n long").collect()}
    assert got == {k: sum(b.leaf == k for b in bodies.values()) for k in got} and sum(got.values()) == 300
