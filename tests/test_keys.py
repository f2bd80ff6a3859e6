"""Keys against known values."""

import pytest
from pyspark.sql import functions as F

from treespan.functions.keys import Keys, levelwise
from treespan.operators.tree import complete_region


def path_key(digits, dim=3):
    k, top = 0, {2: 29, 3: 19}[dim]
    for i, d in enumerate(digits, 1):
        k |= d << (dim * (top - i) + 5)
    return k | len(digits)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit(k):
    return F.lit(k).cast("long")


GOLDEN = {(): (0, 1 << 62), (7,): (4035225266123964417, 4611686018427387905), (0, 1): (72057594037927938, 144115188075855874), (0, 1, 1): (81064793292668931, 90071992547409923), (7, 3, 2): (4269412446747230211, 4278419646001971203)}


def test_golden(spark):
    k = Keys(3)
    for digits, (key, nxt) in GOLDEN.items():
        assert path_key(digits) == key
        got = one(spark, k.next(lit(key)).alias("n"), k.depth(lit(key)).alias("d"), k.last(lit(key)).alias("l"))
        assert (got.n, got.d) == (nxt, len(digits))
        assert got.l < nxt


def test_encode(spark):
    k = Keys(3)
    for anchor, key in (((0, 0, 0), 19), ((1, 0, 0), 51), ((0, 1, 0), 83), ((0, 0, 1), 147), ((262144, 0, 0), 576460752303423507), ((524287,) * 3, 4611686018427387891)):
        assert one(spark, k.encode([lit(a) for a in anchor]).alias("k")).k == key
        assert tuple(one(spark, *(k.index_fast(lit(key), i) for i in range(3)))) == anchor
        assert tuple(one(spark, *(k.index(lit(key), i) for i in range(3)))) == anchor
    assert path_key((3, 3), 2) == 8646911284551352322


@pytest.mark.parametrize("dim", [2, 3])
def test_algebra(spark, dim):
    k = Keys(dim)
    p = lambda *d: lit(path_key(d, dim))
    top = k.fan - 1
    got = one(
        spark, k.parent(p(0, 1, 2)) == p(0, 1), k.parent(p()) == p(), k.next(p(0, 1, 1)) == p(0, 1, 2), k.next(p(0, 1, top)) == p(0, 2, 0), k.is_descendant(p(0, 1), p(0, 1, 3)), k.is_descendant(p(0, 1), p(0, 1, 2, 3, 0, 1)),
        ~k.is_descendant(p(0, 1, 3), p(0, 1)), ~k.is_descendant(p(0, 2), p(0, 1, 3)), k.child(p(0, 1), F.lit(3)) == p(0, 1, 3), k.finest_ancestor(p(0, 1, 2), p(0, 1, 3, 3)) == p(0, 1), k.overlapped(p(0), k.next(p(0)), p(0, 3), k.next(p(0, 3))),
        ~k.overlapped(p(0), k.next(p(0)), p(1), k.next(p(1))), k.includes(p(0, 1), p(0, 1)), k.clear_descendants(p(2, 3)) == p(2, 3),
    )
    assert all(got)


def test_directions(spark):
    k = Keys(3)
    got = one(spark, *(k.direction(lit(path_key((7, 3, 2))), i, d) for i in range(3) for d in (1, 2, 3)))
    assert tuple(got) == (1, 1, 0, 1, 1, 1, 1, 0, 0)


def test_regions_in_the_plane(spark):
    k = Keys(2)
    for digits, want in (((), (-1, 1, -1, 1)), ((3,), (0, 1, 0, 1)), ((0,), (-1, 0, -1, 0)), ((3, 3), (0.5, 1, 0.5, 1)), ((0, 2), (-1, -0.5, -0.5, 0))):
        key = lit(path_key(digits, 2))
        cols = [c for i in range(2) for c in k.region(key, i, F.lit(-1.0), F.lit(2.0))]
        assert tuple(one(spark, *(c.alias(f"c{i}") for i, c in enumerate(cols)))) == want


def test_levelwise(spark):
    assert one(spark, levelwise([lit(1), lit(1), lit(1)], F.lit(1)).alias("v")).v == 8


def test_complete_region():
    k = Keys(3)
    cells = complete_region(path_key((0, 6)), path_key((2, 1)), k)
    assert cells == [path_key((0, 7)), path_key((1,)), path_key((2, 0))]
