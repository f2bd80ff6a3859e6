"""Axis-aligned boxes, distances and spherical coordinates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from treespan.functions.vectors import norm2, sub, total


@dataclass(frozen=True)
class Box:
    low: Sequence[Column]
    high: Sequence[Column]

    def width(self, i: int) -> Column:
        return self.high[i] - self.low[i]

    def centre(self, i: int) -> Column:
        return (self.low[i] + self.high[i]) / 2

    def part(self, which: Column) -> Box:
        """One of the box's halves in each dimension, the upper one where the dimension's bit is set."""
        up = [F.call_function("shiftright", which.cast("long"), F.lit(i)).bitwiseAND(F.lit(1)) == 1 for i in range(len(self.low))]
        mid = [self.centre(i) for i in range(len(self.low))]
        return Box([F.when(u, m).otherwise(a) for u, m, a in zip(up, mid, self.low)], [F.when(u, b).otherwise(m) for u, m, b in zip(up, mid, self.high)])

    def contains(self, point: Sequence[Column]) -> Column:
        """Half-open: the low faces belong to the box."""
        return _all([(p >= a) & (p < b) for p, a, b in zip(point, self.low, self.high)])

    def as_cube(self) -> tuple[list[Column], Column]:
        """Centre, and the greatest half-width with leeway."""
        n = range(len(self.low))
        return [self.centre(i) for i in n], F.greatest(*(self.width(i) / 2 for i in n)) * 1.00001


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def separated(a: Box, b: Box) -> Column:
    """Whether the boxes share no volume; touching ones don't."""
    return ~_all([(l1 < h2) & (l2 < h1) for l1, h1, l2, h2 in zip(a.low, a.high, b.low, b.high)])


def includes(a: Box, b: Box) -> Column:
    return _all([(l1 <= l2) & (h2 <= h1) for l1, h1, l2, h2 in zip(a.low, a.high, b.low, b.high)])


def centre_distance2(a: Box, b: Box) -> Column:
    n = range(len(a.low))
    return norm2([a.centre(i) - b.centre(i) for i in n])


def slid_distance2(target: Box, source: Box) -> Column:
    """Squared distance of centres after the target's slid toward the source's, to its box's faces at most."""
    zero = F.lit(0.0)
    return norm2([F.greatest(F.abs(target.centre(i) - source.centre(i)) - target.width(i) / 2, zero) for i in range(len(target.low))])


def point_distance2(box: Box, point: Sequence[Column]) -> Column:
    """Squared distance of a point from the nearest point of a box."""
    return norm2([F.greatest(a - p, p - b, F.lit(0.0)) for p, a, b in zip(point, box.low, box.high)])


def spherical(v: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Radius, polar angle (0 at the origin) and azimuth."""
    r = F.sqrt(norm2(v))
    return r, F.when(r == 0, F.lit(0.0)).otherwise(F.acos(F.try_divide(v[2], r))), F.atan2(v[1], v[0])


def cartesian(r: Column, theta: Column, phi: Column, dr: Column, dtheta: Column, dphi: Column, scale: Column | None = None) -> list[Column]:
    """A gradient by r, theta and phi as one by x, y and z; on the axis the parts that would divide by 0 are 0."""
    s, c, cp, sp = F.sin(theta), F.cos(theta), F.cos(phi), F.sin(phi)
    t = F.coalesce(F.try_divide(dtheta, r), F.lit(0.0))
    p = F.coalesce(F.try_divide(dphi, r * s), F.lit(0.0))
    out = [s * cp * dr + c * cp * t - sp * p, s * sp * dr + c * sp * t + cp * p, c * dr - s * t]
    return [scale * o for o in out] if scale is not None else out


def distance2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return norm2(sub(a, b))


__all__ = ["Box", "cartesian", "centre_distance2", "distance2", "includes", "point_distance2", "separated", "slid_distance2", "spherical", "total"]
