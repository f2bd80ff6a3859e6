"""Pairs of bodies block by block, against all pairs in plain numpy, and queries by many small blocks against their SQL."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from treespan import api
from treespan.operators import kernels as K
from treespan.operators import pairs
from treespan.operators import periodic as E

DATA = "/root/testdata/sf0.001"
N = 150


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of 16 bodies, so that few bodies are many blocks."""
    monkeypatch.setattr(pairs, "LEAST", 16)
    monkeypatch.setattr(pairs, "MOST", 16)


@pytest.fixture(scope="module")
def bodies():
    """Nearly all in one small spot, some of them at one place, and a few far away on both sides of the border."""
    rng = np.random.default_rng(5)
    x = rng.normal(0.5, 0.05, (N, 3))
    x[:20] = rng.random((20, 3))
    x[20:30] = x[30]
    return x, rng.normal(0, 1, N), rng.integers(0, 3, N)


def frame(spark, bodies):
    x, q, kind = bodies
    return spark.createDataFrame([(i, *map(float, x[i]), float(q[i]), int(kind[i])) for i in range(N)], "body_id long, x double, y double, z double, src double, atype int")


def vectors(x, cycle=None):
    """From target to source."""
    d = x[None] - x[:, None]
    if cycle:
        d = np.where(d < -cycle / 2, d + cycle, np.where(d > cycle / 2, d - cycle, d))
    return d, (d * d).sum(axis=2)


def same(df, want, names=("pot", "acc_x", "acc_y", "acc_z")):
    got = {r.body_id: [r[n] for n in names] for r in df.collect()}
    assert set(got) == set(want)
    for i, row in want.items():
        assert np.allclose(got[i], row, rtol=1e-10, atol=1e-9), (i, got[i], row)


def weighted(x, q, pot, force, inside, cycle=None, only=None):
    d, _ = vectors(x, cycle)
    pot, force = np.where(inside, pot, 0) * q, np.where(inside, force, 0) * q
    return {i: [pot[i].sum(), *(force[i, :, None] * d[i]).sum(axis=0)] for i in range(len(x)) if inside[i].any() and (only is None or only[i])}


def test_direct(spark, bodies, small_blocks):
    x, q, _ = bodies
    b = frame(spark, bodies)
    _, r2 = vectors(x)
    with np.errstate(divide="ignore"):
        want = weighted(x, q, r2**-0.5, r2**-1.5, r2 > 0)
    same(K.direct(b, b), want)
    odd = np.arange(N) % 2 == 1
    same(K.direct(b.where("body_id % 2 = 1"), b), {i: v for i, v in want.items() if odd[i]})
    soft = r2 + 1e-6
    same(K.direct(b, b, eps2=1e-6), weighted(x, q, soft**-0.5, soft**-1.5, soft > 0))


def test_direct_without_place(spark, small_blocks):
    """Bodies without a coordinate act on nothing, and nothing acts on them."""
    b = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 2.0), (2, None, 0.0, 0.0, 4.0), (3, 0.0, 0.0, 0.0, None)], "body_id long, x double, y double, z double, src double")
    same(K.direct(b, b), {0: [2, 2, 0, 0], 1: [1, -1, 0, 0], 2: [0, 0, 0, 0], 3: [2, 2, 0, 0]})
    assert K.direct(b.limit(0), b.limit(0)).count() == 0


def test_coulomb(spark, bodies, small_blocks):
    x, q, _ = bodies
    b = frame(spark, bodies)
    _, r2 = vectors(x, 1.0)
    with np.errstate(divide="ignore"):
        same(E.coulomb(b, b, 10.0, 1.0), weighted(x, q, r2**-0.5, r2**-1.5, r2 > 0, 1.0))


@pytest.mark.parametrize("cutoff", [0.1, 0.3, 0.45])
def test_ewald_real(spark, bodies, small_blocks, cutoff):
    x, q, _ = bodies
    b = frame(spark, bodies)
    a = 10.0
    _, r2 = vectors(x, 1.0)
    r = np.sqrt(r2)
    tail = np.vectorize(math.erfc)(a * r)
    with np.errstate(divide="ignore", invalid="ignore"):
        pot = tail / r
        force = (2 / math.sqrt(math.pi) * np.exp(-((a * r) ** 2)) / (a * r) ** 2 + tail / (a * r) ** 3) * a**3
    same(E.ewald_real(b, b, a, cutoff, 1.0), weighted(x, q, pot, force, (r2 > 0) & (r2 < cutoff * cutoff), 1.0))


def test_erfc_table():
    table = pairs.erfc_table(5.0)
    for v in np.linspace(0, 5, 997):
        k = round(v * pairs.POINTS)
        got = sum(c * (v - k / pairs.POINTS) ** n for n, c in enumerate(table[:, k]))
        assert abs(got - math.erfc(v)) < 1e-15


@pytest.mark.parametrize("cycle", [None, 1.0])
def test_counted(spark, bodies, small_blocks, cycle):
    x = bodies[0]
    _, r2 = vectors(x, cycle)
    inside = (r2 > 0) & (r2 < 0.01)
    same(E.counted(frame(spark, bodies), 0.1, cycle), {i: [inside[i].sum(), r2[i][inside[i]].max()] for i in range(N) if inside[i].any()}, ("n", "furthest"))


@pytest.mark.parametrize("cycle", [None, 1.0])
def test_pairs_within(spark, bodies, small_blocks, cycle):
    x, q, kind = bodies
    b = frame(spark, bodies)
    d, r2 = vectors(x, cycle)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((r2 > 0) & (r2 < 0.15 * 0.15)))}
    got = E.pairs_within(b, b, 0.15, cycle).collect()
    assert len(got) == len(want) and {(r.body_id, r.other) for r in got} == want
    for r in got:
        assert np.allclose([r.dx, r.dy, r.dz, r.r2], [*-d[r.body_id, r.other], r2[r.body_id, r.other]]) and (r.atype_t, r.atype_s, r.src_s) == (kind[r.body_id], kind[r.other], q[r.other])


def test_hot_place_is_dealt_out(spark, bodies, small_blocks):
    """Nearly all pairs are within one cell of the cutoff's size: no task has more than a few pairs of blocks."""
    b = E._blocks(frame(spark, bodies), "src")
    assert b.count == 10
    tasks = pairs._meeting(b, None, 0.3, 1.0).groupBy(F.spark_partition_id()).agg(F.countDistinct("p").alias("n")).collect()
    assert sum(r.n for r in tasks) == 55 and max(r.n for r in tasks) <= 5


@pytest.mark.parametrize("cutoff", [0.3, 0.5])
def test_vanderwaals(spark, bodies, small_blocks, cutoff):
    """By arrays of types, symmetric or not, as by a row for each pair; and as all pairs one by one."""
    b = frame(spark, bodies)
    for scale in (0.1, 0.7):
        types = spark.createDataFrame([(i, j, 40.0 + i + j, 0.1 + scale * (i > j), 0.2) for i in range(3) for j in range(3)], "ti int, tj int, rscale double, gscale double, fgscale double")
        rows = E._typed(E.pairs_within(b, b, cutoff, 1.0), types, 0.2, cutoff)
        want = {r.body_id: [r.pot, r.acc_x, r.acc_y, r.acc_z] for r in rows.collect()}
        same(api.vanderwaals(b, types, 0.2, cutoff, 1.0), want)
        same(api.direct_vanderwaals(b, b, types, 0.2, cutoff, 1.0), want)
        # a pair of types without parameters has no row
        fewer = types.where("ti < tj")
        rows = E._typed(E.pairs_within(b, b, cutoff, 1.0), fewer, 0.2, cutoff)
        same(api.vanderwaals(b, fewer, 0.2, cutoff, 1.0), {r.body_id: [r.pot, r.acc_x, r.acc_y, r.acc_z] for r in rows.collect()})


@pytest.mark.parametrize(
    "name",
    ["agg_ewald_real", "flt_cutoff", "agg_vdw", "join_neighbor_range", "flt_mac_proto", "join_type_params", "agg_direct_vdw", "agg_direct_coulomb", "join_direct", "agg_normalize", "join_direct_tree", "sink_copyback"],
)
def test_query_by_many_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(pairs, "LEAST", 64)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    tidy = lambda rows, names: sorted(tuple(-1.0 if r[names.index(c)] is None else round(float(r[names.index(c)]), 4) for c in columns) for r in rows)
    df = entry.queries()[name](spark, DATA)
    got, want = tidy(df.collect(), df.columns), tidy(want.fetchall(), want.columns)
    assert len(got) == len(want)
    assert all(np.allclose(g, w, rtol=1e-9, atol=2e-4) for g, w in zip(got, want))


def test_dump_reads_back(spark, tmp_path):
    """Numbers near the middle of two rounded ones come back as they were."""
    from treespan.sources import files as W

    b = spark.createDataFrame([(0.12344999999, -0.000249999999, 1.23455), (1e-300, 123456.78904999999, 0.1)], "x double, y double, z double")
    W.dump_xyz(b, str(tmp_path / "xyz"))
    got = spark.read.text(str(tmp_path / "xyz")).select(F.split("value", " ").alias("v"))
    assert {tuple(float(v) for v in r.v) for r in got.collect()} == {tuple(r) for r in b.collect()}
