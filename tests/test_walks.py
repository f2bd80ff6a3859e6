"""Bodies that walk down a tree in groups, each with the cells that it may see."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treespan.operators import kernels as K
from treespan.operators import traverse as V
from treespan.operators import tree as T

N = 200


def some(spark):
    """Half of them in a small spot, a tenth at one place."""
    rng = np.random.default_rng(3)
    x = np.where(np.arange(N)[:, None] % 2 == 0, rng.normal(0.3, 0.01, (N, 3)), rng.random((N, 3)))
    x[:20] = x[0]
    return spark.createDataFrame([(i, *map(float, x[i]), 1.0 + i % 3) for i in range(N)], "body_id long, x double, y double, z double, src double")


def by_hand(tree, bodies, theta, centres=None):
    cells = {r.key: r for r in tree.with_geometry().where("nb > 0").collect()}
    at = {k: (r.cx, r.cy, r.cz) for k, r in cells.items()} | ({r.key: (r.x, r.y, r.z) for r in centres.collect()} if centres else {})
    children = {}
    for r in cells.values():
        children.setdefault(r.parent, []).append(r.key)
    out = set()
    for b in bodies.collect():
        todo = [0]
        while todo:
            k = todo.pop()
            if cells[k].is_leaf:
                out.add((b.body_id, k, "near"))
            elif cells[k].w0 < theta * np.sqrt(sum((c - v) ** 2 for c, v in zip(at[k], (b.x, b.y, b.z)))):
                out.add((b.body_id, k, "far"))
            else:
                todo += children[k]
    return out


@pytest.mark.parametrize("few", [0, V.FEW])
def test_groups_see_what_bodies_see(spark, monkeypatch, few):
    monkeypatch.setattr(V, "FEW", few)
    monkeypatch.setattr(V, "LEAST_GROUP", 16)
    b = some(spark)
    t = T.build_tree(b, 1)
    for centres in (None,) if few else (K.moments(t).select("key", "x", "y", "z"),):
        p = V.by_bodies(t, 0.6, centres=centres)
        got = p.far.select("i", "j", F.lit("far")).union(p.near.select("i", "j", F.lit("near"))).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_hand(t, b, 0.6, centres)
    want = {r.body_id: r for r in K.barnes_hut(t, V.by_bodies(t, 0.6)).collect()}
    for r in K.barnes_hut_sums(t, 0.6).collect():
        assert np.allclose(r, want.pop(r.body_id), rtol=1e-9, atol=1e-6)
    assert not want


def test_a_group_does_not_see_all(spark, monkeypatch):
    """What a group gets is less than the tree, and groups at one crowded place go in parts."""
    monkeypatch.setattr(V, "FEW", 0)
    monkeypatch.setattr(V, "LEAST_GROUP", 10)
    t = T.build_tree(some(spark), 1)
    cells = t.with_geometry().where("nb > 0").withColumnRenamed("w0", "w")
    rows = V.in_sight(t, 0.8, t.bodies, cells).select(F.size("ids").alias("n"), F.size("cell_key").alias("seen")).collect()
    assert sum(r.n for r in rows) == N and max(r.n for r in rows) < 20
    assert min(r.seen for r in rows) < cells.count() / 2
