"""Trees and traversals: invariants, known counts and accuracy."""

import pytest
from pyspark.sql import functions as F

from treespan import api
from treespan.operators import expansions as X
from treespan.operators import kernels as K
from treespan.operators import partition as P
from treespan.operators import periodic
from treespan.operators import traverse as V
from treespan.operators import tree as T
from treespan.sources import bodies as B
from treespan.operators.harmonic import SPHERICAL
from treespan.sources import generate as G

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def b3(spark):
    return B.b3(spark, DATA)


@pytest.fixture(scope="module")
def tree16(b3):
    return T.build_tree(b3, 16)


@pytest.mark.parametrize("ncrit, cells, leaves, depth", [(1, 2049, 1793, 7), (16, 137, 120, 3), (64, 41, 36, 2)])
def test_known_trees(b3, ncrit, cells, leaves, depth):
    t = T.build_tree(b3, ncrit)
    assert (t.n_cells, t.leaves().count(), t.cells.agg(F.max("depth")).first()[0]) == (cells, leaves, depth)
    assert t.leaves().agg(F.sum("nb")).first()[0] == 500
    assert t.bodies_in_leaves().count() == 500


@pytest.mark.parametrize("theta, far, near", [(0.4, 7056, 5776), (0.8, 2272, 816)])
def test_known_pairs(tree16, theta, far, near):
    p = V.dual(tree16, theta)
    assert (p.far.count(), p.near.count()) == (far, near)


def test_coincident_bodies_stop_at_the_greatest_depth(spark):
    b = spark.createDataFrame([(i, 0.5, 0.5, 0.5, 1.0) for i in range(40)] + [(40, 0.0, 1.0, 0.0, 1.0)], "body_id long, x double, y double, z double, src double")
    t = T.build_tree(b, 4)
    assert t.cells.agg(F.max("depth")).first()[0] == 19
    assert t.leaves().agg(F.sum("nb"), F.max("nb")).first() == (41, 40)


def test_no_bodies(spark):
    none = spark.createDataFrame([(1, None, 0.0, 0.0, 1.0), (2, float("nan"), 0.0, 0.0, 1.0)], "body_id long, x double, y double, z double, src double")
    t = T.build_tree(none)
    assert [tuple(r) for r in t.cells.collect()] == [(0, -1, 0, True, 0)]
    assert t.bodies_in_leaves().count() == 0


def _error(got, want):
    d = got.join(want.select("body_id", F.col("pot").alias("w")), "body_id")
    n, e = d.agg(F.count("*"), F.sqrt(F.sum((F.col("pot") - F.col("w")) ** 2) / F.sum(F.col("w") ** 2))).first()
    return n, e


def test_fast_multipole_is_accurate(spark):
    b = G.generate(spark, 600, "p", 1).select("body_id", "x", "y", "z", "src")
    t = T.build_tree(b, 16)
    n, e = _error(X.fast_multipole(t, V.dual(t, 0.4)), K.direct(b, b))
    assert n == 600 and e < 5e-3


def test_barnes_hut_is_accurate(spark):
    b = G.random_masses(spark, 300)
    t = T.build_tree(b, 1)
    n, e = _error(K.barnes_hut(t, V.by_bodies(t, 0.5)), K.direct(b, b, eps2=K.EPS2))
    assert n == 300 and e < 1e-2


def test_shifts_agree_with_direct_expansions():
    import numpy as np

    rng = np.random.default_rng(3)
    s, q, order = rng.random((20, 3)), rng.random(20), 5
    about = lambda c: (q[:, None] * X.powers(c - s, order)).sum(axis=0)[None]
    a, b = np.array([0.5, 0.5, 0.5]), np.array([0.1, 0.9, 0.4])
    assert np.allclose(X.m2m(about(a), (b - a)[None], order), about(b))
    r, d = np.array([[5.0, 4.0, 3.0]]), np.array([[0.1, -0.2, 0.3]])
    loc = X.m2l(about(a), r, order)
    assert np.allclose(X.l2p(X.l2l(loc, d, order), d, order)[0], X.l2p(loc, 2 * d, order)[0])
    pot, grad = X.m2p(about(a), r, order)
    x = a + r[0]
    assert abs(pot[0] - (q / np.linalg.norm(x - s, axis=1)).sum()) < 1e-4 * pot[0]
    assert np.allclose(grad[0], (q[:, None] * (s - x) / np.linalg.norm(x - s, axis=1)[:, None] ** 3).sum(axis=0), rtol=1e-3)


def test_scans(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 4, 5])], "i long, v long")
    assert [r.s for r in P.scan(df, "i", "v", "s").orderBy("i").collect()] == [1, 3, 6, 10, 15]
    assert [r.s for r in P.scan(df, "i", "v", "s", inclusive=False).orderBy("i").collect()] == [0, 1, 3, 6, 10]


def test_generator():
    assert G.uniform(0, 0, 2).round(8).tolist() == [0.17082804, 0.74990198]
    assert (G.uniform(7, 1000, 50) == G.uniform(7, 0, 1050)[1000:]).all()


def test_near_sums_of_many_bodies_at_one_place(spark):
    """Leaves of the greatest depth are taken in blocks, and sources at one place as one."""
    rows = [(i, 0.5, 0.5, 0.5, 1.0 + i % 3) for i in range(3 * K.BLOCK)] + [(10_000 + i, 0.1 * i, 0.2, 0.3, 0.5) for i in range(9)]
    b = spark.createDataFrame(rows, "body_id long, x double, y double, z double, src double")
    t = T.build_tree(b, 4)
    leaves = t.leaves().where("nb > 0").select("key")
    every = leaves.select(F.col("key").alias("i")).crossJoin(leaves.select(F.col("key").alias("j")))
    for eps2 in (0.0, 1e-4):
        n, e = _error(K.near_field(t, every, eps2=eps2), K.direct(b, b, eps2=eps2))
        assert n == len(rows) and e < 1e-12


@pytest.mark.parametrize("ncrit", [1, 8])
def test_walks_are_the_joins_of_pairs(spark, monkeypatch, ncrit):
    b = G.random_masses(spark, 400, 3).union(spark.createDataFrame([(1000 + i, 0.5, 0.5, 0.5, 0.01) for i in range(5)], "body_id long, x double, y double, z double, src double"))
    t = T.build_tree(b, ncrit)
    monkeypatch.setattr(K, "WALKED", 64)
    walked = K.barnes_hut_sums(t)
    joined = K.barnes_hut(t, V.by_bodies(t, 0.5))
    n, e = _error(walked, joined)
    assert n == 405 and e < 1e-12
    some = b.where("body_id % 7 = 0").select("body_id", "x", "y", "z")
    n, e = _error(K.barnes_hut_sums(t, targets=some), joined.join(some.select("body_id"), "body_id"))
    assert n == some.count() and e < 1e-12
    monkeypatch.setattr(K, "BROADCAST_ROWS", 1)
    assert _error(K.barnes_hut_sums(t), joined)[1] < 1e-12


@pytest.mark.parametrize("kind", ["l", "c", "s", "p"])
def test_gate_of_harmonics(spark, kind):
    """Fast multipole sums in solid harmonics of order 10 are within the gate for every distribution."""
    b = G.generate(spark, 1000, kind, mass=True).select("body_id", "x", "y", "z", "src")
    t = T.build_tree(b, 64)
    n, e = _error(X.fast_multipole(t, V.dual(t, 0.4), 10, rules=SPHERICAL), K.direct(b, b))
    assert n == b.count() and e < 5e-3


def test_both_kinds_of_expansion_agree(spark):
    b = G.random_masses(spark, 300, 5)
    t = T.build_tree(b, 8)
    p = V.dual(t, 0.6)
    assert _error(X.far_field(t, p.far, 5, rules=SPHERICAL), X.far_field(t, p.far, 5))[1] < 1e-10


def test_images_in_levels(spark):
    """Two and three levels of images against all of them as bodies."""
    b = G.neutral(G.random_masses(spark, 40, 9)).select("body_id", "x", "y", "z", "src")
    for levels, order in ((1, 6), (2, 6), (2, 8)):
        got = api.laplace(b, ncrit=8, order=order, cycle=1.0, images=levels)
        want = K.direct(b, periodic.with_images(b, levels, 1.0))
        n, e = _error(got, want)
        assert n == 40 and e < 2e-2
    t = T.build_tree(b, 8)
    own = lambda levels: X.periodic_local(t, 1.0, levels, 4).first().l
    assert own(1) == [0.0] * 20 and own(3) != own(2) != own(1)
    assert X.periodic_local(T.build_tree(b.limit(0)), 1.0, 2, 3).first().l == [0.0] * 10


@pytest.mark.parametrize("op, want", [("sum", [1, 3, 6, 10, 15]), ("minus", [1, -1, -4, -8, -13]), ("min", [1] * 5), ("max", [1, 2, 3, 4, 5]), ("product", [1, 2, 6, 24, 120])])
def test_scans_by_operator(spark, op, want):
    df = spark.createDataFrame([(i, i + 1) for i in range(5)], "at long, v long").repartition(3)
    assert [int(r.s) for r in P.scan(df, "at", "v", "s", op=op).orderBy("at").collect()] == want
    with pytest.raises(ValueError):
        P.scan(df, "at", "v", "s", inclusive=False, op="max")


def test_exclusive_sums(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(5)], "at long, v long").repartition(3)
    assert [r.s for r in P.scan(df, "at", "v", "s", inclusive=False).orderBy("at").collect()] == [0, 1, 3, 6, 10]
