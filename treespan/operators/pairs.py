"""All pairs of bodies, or those within a cutoff, block by block.

Bodies go in blocks of even size, however they lie: numbers in an order of place are cut into runs. A task gets two
blocks and works through tiles of them that a core's cache holds; blocks and tiles that the cutoff rules out by their
boxes are left out. Of one table's bodies both orders of a pair are summed at once. So a task's memory is that of two
blocks, work is dealt out evenly, and no row is made for a pair unless pairs are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, erfc, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespan.functions.keys import Keys
from treespan.operators.partition import numbered
from treespan.operators.tree import AXES, bounding_box, with_keys
from treespan.plans.lineage import materialize, small

#: Bodies of a block, at least and at most; between, a table is so many blocks.
LEAST, MOST, BLOCKS = 512, 16384, 24
#: Bodies of a tile on either side.
ROWS, COLS = 32, 512
#: Pairs of a batch of rows, about.
BATCH = 1 << 17
#: Boxes rule a pair of tiles out, or in, only beyond what rounding may do.
SLACK = 1e-12


@dataclass
class Blocks:
    """A written table (block, ids, lo_x.., hi_x.., and an array of each column), its blocks numbered from 0."""

    rows: DataFrame
    count: int
    columns: tuple[str, ...]


def finite(bodies: DataFrame, dim: int = 3) -> DataFrame:
    """Bodies that have a place."""
    good = F.lit(True)
    for a in AXES[:dim]:
        good = good & F.col(a).isNotNull() & (F.abs(a) < float("inf"))
    return bodies.where(good)


def by_place(bodies: DataFrame, dim: int = 3) -> DataFrame:
    """Bodies with the key of their finest cell; all must have a place."""
    return with_keys(bodies, bounding_box(bodies, dim), Keys(dim))


def blocks(bodies: DataFrame, columns: tuple[str, ...], order: tuple[str, ...]) -> Blocks:
    """Blocks of bodies in an order; `columns` go with their ids."""
    n = bodies.count()
    size = min(MOST, max(LEAST, ceil(n / BLOCKS)))
    kept = bodies.select("body_id", *columns, *(c for c in order if c not in ("body_id", *columns)))
    rows = numbered(kept, list(order), "__n") if n > size else kept.withColumn("__n", F.lit(0).cast("long"))
    axes = [c for c in columns if c in AXES]
    boxed = [f(a).alias(f"{name}_{a}") for a in axes for name, f in (("lo", F.min), ("hi", F.max))]
    held = F.array_sort(F.collect_list(F.struct("__n", F.col("body_id").alias("ids"), *columns)))
    grouped = rows.groupBy(F.floor(F.col("__n") / size).cast("long").alias("block")).agg(held.alias("__rows"), *boxed)
    written = materialize(grouped.select("block", *(F.col("__rows")[c].alias(c) for c in ("ids", *columns)), *(f"{name}_{a}" for a in axes for name in ("lo", "hi"))))
    return Blocks(written, ceil(n / size), columns)


def _apart(a: str, cycle: float | None) -> Column:
    """The least distance of two boxes along an axis, of nearest images if periodic."""
    gap = lambda by: F.greatest(F.col(f"lo_{a}") + by - F.col(f"other_hi_{a}"), F.col(f"other_lo_{a}") - F.col(f"hi_{a}") - by, F.lit(0.0))
    return gap(F.lit(0.0)) if cycle is None else F.least(*(gap(F.lit(by)) for by in (-cycle, 0.0, cycle)))


def _meeting(t: Blocks, s: Blocks | None, cutoff: float | None, cycle: float | None) -> DataFrame:
    """Two rows for each pair of blocks that may have pairs of bodies, next to each other in one partition.

    Columns p (the pair's number), side, block, alone (a block with itself: one row) and the block's arrays. Without
    `s` each unordered pair of blocks meets once.
    """

    def asked(x: Blocks, y: Blocks) -> DataFrame:
        boxes = [c for c in y.rows.columns if c.startswith(("lo_", "hi_"))]
        both = x.rows.crossJoin(small(y.rows.select(F.col("block").alias("other"), *(F.col(c).alias(f"other_{c}") for c in boxes)), y.count))
        if cutoff is not None:
            both = both.where(sum((_apart(a, cycle) * _apart(a, cycle) for a in AXES if f"lo_{a}" in boxes), F.lit(0.0)) * (1 - SLACK) < cutoff * cutoff)
        return both

    mine, other = F.col("block"), F.col("other")
    arrays = ["ids", *t.columns]
    if s is None:
        a, b = F.least(mine, other), F.greatest(mine, other)
        number = (b * (b + 1) / 2).cast("long") + a
        rows = asked(t, t).select(number.alias("p"), (mine > other).cast("int").alias("side"), "block", (mine == other).alias("alone"), *arrays)
        total = t.count * (t.count + 1) // 2
    else:
        left = asked(t, s).select((mine * s.count + other).alias("p"), F.lit(0).alias("side"), "block", F.lit(False).alias("alone"), *arrays)
        right = asked(s, t).select((other * s.count + mine).alias("p"), F.lit(1).alias("side"), "block", F.lit(False).alias("alone"), *arrays)
        rows, total = left.union(right), t.count * s.count
    tasks = max(1, min(total, max(3 * t.rows.sparkSession.sparkContext.defaultParallelism, total // 4)))
    return rows.repartitionById(tasks, F.pmod("p", F.lit(tasks)).cast("int")).sortWithinPartitions("p", "side")


class Side:
    """A block in a task: places as an array of axes, and boxes of its tiles."""

    def __init__(self, batch: pa.RecordBatch, i: int, axes: tuple[str, ...]):
        self.batch, self.i = batch, i
        self.block = batch.column("block")[i].as_py()
        self.ids = batch.column("ids")[i].values
        self.x = np.stack([self.get(a) for a in axes])
        self.n = self.x.shape[1]

    def get(self, name: str) -> np.ndarray:
        return self.batch.column(name)[self.i].values.to_numpy(zero_copy_only=False)

    def boxes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, self.n, size)
        return np.minimum.reduceat(self.x, at, axis=1), np.maximum.reduceat(self.x, at, axis=1)


def _met(parts: Iterator[pa.RecordBatch], axes: tuple[str, ...]) -> Iterator[tuple[Side, Side]]:
    held = None
    for batch in parts:
        side, alone = batch.column("side").to_pylist(), batch.column("alone").to_pylist()
        for i in range(batch.num_rows):
            this = Side(batch, i, axes)
            if alone[i]:
                yield this, this
            elif side[i] == 0:
                held = this
            else:
                yield held, this


@dataclass
class Tile:
    """Bodies i of targets and j of sources: d from target to source by axis, r2, and whether all are within the cutoff.

    `d` and `r2` may be overwritten; `spare` are two arrays of their shape.
    """

    i: slice
    j: slice
    d: list[np.ndarray]
    r2: np.ndarray
    spare: list[np.ndarray]
    within: bool


def tiles(t: Side, s: Side, cutoff: float | None = None, cycle: float | None = None) -> Iterator[Tile]:
    """All tiles of two blocks but those beyond the cutoff."""
    dim = len(t.x)
    (t_lo, t_hi), (s_lo, s_hi) = t.boxes(ROWS), s.boxes(COLS)
    room = [np.empty(ROWS * COLS) for _ in range(dim + 3)]
    flag = np.empty(ROWS * COLS, bool)
    half = None if cycle is None else cycle / 2
    every = np.arange(s_lo.shape[1])
    for k in range(t_lo.shape[1]):
        i = slice(k * ROWS, min(t.n, (k + 1) * ROWS))
        m = i.stop - i.start
        # the least and the greatest of source less target along each axis
        low, high = s_lo - t_hi[:, k, None], s_hi - t_lo[:, k, None]
        far = np.maximum(-low, high)
        visit = every
        if cutoff is not None:
            shifts = (0.0,) if cycle is None else (-cycle, 0.0, cycle)
            gap = np.min([np.maximum(np.maximum(low + by, -high - by), 0) for by in shifts], axis=0)
            visit = every[(gap * gap).sum(axis=0) * (1 - SLACK) < cutoff * cutoff]
        reach = (far * far).sum(axis=0) * (1 + SLACK)
        for c in visit:
            j = slice(c * COLS, min(s.n, (c + 1) * COLS))
            shape, size = (m, j.stop - j.start), m * (j.stop - j.start)
            *d, r2, spare, more = (b[:size].reshape(shape) for b in room)
            f = flag[:size].reshape(shape)
            wrapped = False
            for a in range(dim):
                np.subtract(s.x[a, None, j], t.x[a, i, None], out=d[a])
                if half is not None and not far[a, c] <= half:
                    wrapped = True
                    np.less(d[a], -half, out=f)
                    np.multiply(f, cycle, out=spare)
                    np.greater(d[a], half, out=f)
                    np.multiply(f, cycle, out=more)
                    d[a] += spare
                    d[a] -= more
            np.multiply(d[0], d[0], out=r2)
            for x in d[1:]:
                np.multiply(x, x, out=spare)
                r2 += spare
            yield Tile(i, j, d, r2, [spare, more], cutoff is not None and not wrapped and bool(reach[c] < cutoff * cutoff))


#: What a kernel makes of two blocks: (targets, sources, both) to an array of results by target, and of results by
#: source if `both` orders of the pairs are asked for.
Kernel = Callable[[Side, Side, bool], tuple[np.ndarray, np.ndarray | None]]


def sums(t: Blocks, s: Blocks | None, kernel: Kernel, names: tuple[str, ...], cutoff: float | None = None, cycle: float | None = None, most: tuple[str, ...] = (), only: str | None = None) -> DataFrame:
    """A written table of each target's results by `names`, of both orders of pairs where there is no `s`.

    Blocks' results are added up; of those in `most` the greatest counts. With `only`, targets of which that result is 0
    are left out.
    """
    axes = tuple(c for c in t.columns if c in AXES)
    kind = t.rows.schema["ids"].dataType.elementType.simpleString()
    both, width = s is None, len(names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _met(parts, axes):
            with np.errstate(all="ignore"):
                of_a, of_b = kernel(a, b, both and a is not b)
            got = [(a, of_a)] + ([(b, of_b)] if of_b is not None else [])
            yield pa.RecordBatch.from_arrays([pa.array([x.block for x, _ in got], pa.int64()), pa.array([v.ravel() for _, v in got], pa.list_(pa.float64()))], names=["block", "v"])

    parts = _meeting(t, s, cutoff, cycle).mapInArrow(run, "block long, v array<double>")
    no_ids, no_v = F.lit(None).cast(f"array<{kind}>"), F.lit(None).cast("array<double>")
    every = t.rows.select("block", F.lit(0).alias("side"), "ids", no_v.alias("v")).union(parts.select("block", F.lit(1), no_ids, "v"))
    dealt = every.repartitionById(max(t.count, 1), F.col("block").cast("int")).sortWithinPartitions("block", "side")
    greatest = np.array([n in most for n in names])

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = out = None

        def done() -> pa.RecordBatch:
            take = np.arange(len(ids)) if only is None else np.flatnonzero(out[names.index(only)])
            return pa.RecordBatch.from_arrays([ids.take(pa.array(take)), *(pa.array(v[take]) for v in out)], names=["body_id", *names])

        for batch in parts:
            for i, side in enumerate(batch.column("side").to_pylist()):
                if side == 0:
                    if ids is not None:
                        yield done()
                    ids = batch.column("ids")[i].values
                    out = np.zeros((width, len(ids)))
                else:
                    v = batch.column("v")[i].values.to_numpy().reshape(width, -1)
                    out[~greatest] += v[~greatest]
                    out[greatest] = np.maximum(out[greatest], v[greatest])
        if ids is not None:
            yield done()

    every = dealt.mapInArrow(total, f"body_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return materialize(every.groupBy("body_id").agg(*((F.max if n in most else F.sum)(n).alias(n) for n in names)))


def _gathered(t: Side, s: Side, both: bool, weight: str | None, factors: Callable, cutoff: float | None, cycle: float | None, every: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of a potential and of a force times the vector to the source, weighted by sources; the last row is 1 where
    there was a pair within the cutoff. `factors` makes both of a tile, in its spare arrays. With `every`, no tile is left
    out by its box."""
    dim = len(t.x)
    of_t, of_s = np.zeros((dim + 2, t.n)), np.zeros((dim + 2, s.n)) if both else None
    q_t, q_s = (x.get(weight) if weight else np.ones(x.n) for x in (t, s))
    for tile in tiles(t, s, None if every else cutoff, cycle):
        i, j, r2 = tile.i, tile.j, tile.r2
        inside = None
        if cutoff is not None:
            if not r2.min() > 0:
                r2[r2 == 0] = cutoff * cutoff
                tile.within = False
            if not tile.within:
                inside = r2 < cutoff * cutoff
                if not inside.any():
                    continue
        pot, force = factors(t, s, tile)
        if inside is not None:
            pot *= inside
            force *= inside
            of_t[-1, i] = np.maximum(of_t[-1, i], inside.any(axis=1))
            if both:
                of_s[-1, j] = np.maximum(of_s[-1, j], inside.any(axis=0))
        else:
            of_t[-1, i] = 1
            if both:
                of_s[-1, j] = 1
        of_t[0, i] += pot @ q_s[j]
        if both:
            of_s[0, j] += q_t[i] @ pot
        for k, d in enumerate(tile.d):
            d *= force
            of_t[1 + k, i] += d @ q_s[j]
            if both:
                of_s[1 + k, j] -= q_t[i] @ d
    return of_t, of_s


def laplace(eps2: float = 0.0, cutoff: float | None = None, cycle: float | None = None) -> Kernel:
    """1 / r and 1 / r^3, of softened distances if asked; pairs of distance 0 count not, unless softened."""

    def factors(t: Side, s: Side, tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        r2, (pot, force) = tile.r2, tile.spare
        if eps2:
            r2 += eps2
        if not r2.min() > 0:
            r2[r2 == 0] = np.inf
        np.sqrt(r2, out=pot)
        np.divide(1.0, pot, out=pot)
        np.divide(pot, r2, out=force)
        return pot, force

    return lambda t, s, both: _gathered(t, s, both, "src", factors, cutoff, cycle)


#: Points of a table of erfc in a unit, the order of its series, and where erfc is 0.
POINTS, ORDER, END = 256, 6, 28


def erfc_table(end: float) -> np.ndarray:
    """Coefficients of erfc around 0, 1 / POINTS, ..., by order: its derivatives are Hermite polynomials times exp(-x^2)."""
    x = np.arange(ceil(min(end, END) * POINTS) + 2) / POINTS
    gauss = np.array([-2 / sqrt(pi) * exp(-v * v) for v in x])
    out, hermite, factor = [np.array([erfc(v) for v in x])], [np.ones_like(x), 2 * x], 1.0
    for n in range(1, ORDER + 1):
        factor *= n
        out.append((-1) ** (n - 1) * hermite[n - 1] * gauss / factor)
        hermite.append(2 * x * hermite[n] - 2 * n * hermite[n - 1])
    return np.array(out)


def ewald_real(alpha: float, cutoff: float, cycle: float | None) -> Kernel:
    """erfc(a r) / r and the factor of its gradient."""
    table = erfc_table(alpha * cutoff)
    last = table.shape[1] - 1

    def factors(t: Side, s: Side, tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        r2, (pot, force) = tile.r2, tile.spare
        rs = np.sqrt(r2, out=r2)
        rs *= alpha
        np.multiply(rs, POINTS, out=pot)
        np.rint(pot, out=pot)
        np.minimum(pot, last, out=pot)
        at = pot.astype(np.int64)
        pot /= POINTS
        off = np.subtract(rs, pot, out=pot)
        tail = table[ORDER].take(at)
        for n in range(ORDER - 1, -1, -1):
            tail *= off
            tail += table[n].take(at, out=force, mode="clip")
        r2s = rs * rs
        np.negative(r2s, out=force)
        np.exp(force, out=force)
        force *= 2 / sqrt(pi)
        tail /= rs
        force += tail
        force /= r2s
        force *= alpha**3
        np.multiply(tail, alpha, out=pot)
        return pot, force

    return lambda t, s, both: _gathered(t, s, both, "src", factors, cutoff, cycle)


def switched(rscale: np.ndarray, gscale: np.ndarray, fgscale: np.ndarray, cuton: float, cutoff: float, cycle: float | None, every: bool = False) -> Kernel:
    """Lennard-Jones pairs, switched off between cuton and cutoff; parameters by types of target and source."""
    on, off = cuton * cuton, cutoff * cutoff
    kinds = rscale.shape[1]
    flat = [np.ascontiguousarray(p).ravel() for p in (rscale, gscale, fgscale)]

    def factors(t: Side, s: Side, tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        r2, (pot, force) = tile.r2, tile.spare
        at = t.kind[tile.i, None] * kinds + s.kind[None, tile.j]
        inv2 = flat[0].take(at)
        inv2 *= r2
        np.divide(1.0, inv2, out=inv2)
        np.multiply(inv2, inv2, out=pot)
        inv6 = np.multiply(pot, inv2)
        less = inv6 - 1  # of inv6 (inv6 - 1)
        np.multiply(inv6, 2, out=force)
        force -= 1
        force *= inv6
        force *= inv2
        np.multiply(inv6, less, out=pot)
        mid = r2 > on
        if mid.any():
            t1 = np.subtract(off, r2)
            t2 = t1 / (off - on) ** 3
            t1 *= t2
            t1 *= 2 * r2 + (off - 3 * on)
            t1, t2 = t2, t1
            soft = pot * 12
            soft *= np.subtract(on, r2)
            soft *= t1
            less *= t2
            less += inv6
            less *= inv6
            less *= t2
            less *= 6
            less /= r2
            soft -= less
            np.copyto(force, soft, where=mid)
            t2 *= pot
            np.copyto(pot, t2, where=mid)
        pot *= flat[1].take(at)
        force *= flat[2].take(at)
        return pot, force

    def kernel(t: Side, s: Side, both: bool) -> tuple[np.ndarray, np.ndarray | None]:
        for x in (t, s):
            x.kind = x.get("kind").astype(np.int64)
        return _gathered(t, s, both, None, factors, cutoff, cycle, every)

    return kernel


def counted(inner: float, cycle: float | None) -> Kernel:
    """How many pairs are within a distance, and the greatest squared distance among them."""

    def kernel(t: Side, s: Side, both: bool) -> tuple[np.ndarray, np.ndarray | None]:
        of_t, of_s = np.zeros((2, t.n)), np.zeros((2, s.n)) if both else None
        for tile in tiles(t, s, inner, cycle):
            i, j, r2 = tile.i, tile.j, tile.r2
            inside = (r2 < inner * inner) & (r2 > 0)
            if not inside.any():
                continue
            r2 *= inside
            one = inside.astype(np.float64)
            of_t[0, i] += one.sum(axis=1)
            of_t[1, i] = np.maximum(of_t[1, i], r2.max(axis=1))
            if both:
                of_s[0, j] += one.sum(axis=0)
                of_s[1, j] = np.maximum(of_s[1, j], r2.max(axis=0))
        return of_t, of_s

    return kernel


def listed(t: Blocks, s: Blocks, cutoff: float, cycle: float | None, columns: dict[str, str]) -> DataFrame:
    """A row for each pair at a distance above 0 and below the cutoff.

    `columns` has names and types of what is asked for: body_id, other, d and an axis (from source to target), r2, and
    columns of targets and of sources with _t and _s.
    """
    axes = tuple(c for c in t.columns if c in AXES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _met(parts, axes):
            found: list[list[pa.Array]] = []
            held = 0
            for tile in tiles(a, b, cutoff, cycle):
                i, j = np.nonzero((tile.r2 < cutoff * cutoff) & (tile.r2 > 0))
                if not len(i):
                    continue
                of_a, of_b = pa.array(i + tile.i.start), pa.array(j + tile.j.start)
                row = []
                for name in columns:
                    if name in ("body_id", "other"):
                        row.append(a.ids.take(of_a) if name == "body_id" else b.ids.take(of_b))
                    elif name == "r2":
                        row.append(pa.array(tile.r2[i, j]))
                    elif name[0] == "d" and name[1:] in AXES:
                        row.append(pa.array(-tile.d[axes.index(name[1:])][i, j]))
                    else:
                        side, at = (a, of_a) if name.endswith("_t") else (b, of_b)
                        row.append(side.batch.column(name[:-2])[side.i].values.take(at))
                found.append(row)
                held += len(i)
                if held > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], names=list(columns))
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], names=list(columns))

    return _meeting(t, s, cutoff, cycle).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in columns.items()))
