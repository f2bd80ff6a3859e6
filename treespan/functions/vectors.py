"""Vectors as lists of columns, and small scalar helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def _each(f: Callable[[Column, Column], Column], a: Vector, b: Vector | Column | float) -> list[Column]:
    other = list(b) if isinstance(b, (list, tuple)) else [b if isinstance(b, Column) else F.lit(b)] * len(a)
    return [f(x, y) for x, y in zip(a, other)]


def neg(a: Vector) -> list[Column]:
    return [-x for x in a]


def add(a: Vector, b) -> list[Column]:
    return _each(lambda x, y: x + y, a, b)


def sub(a: Vector, b) -> list[Column]:
    return _each(lambda x, y: x - y, a, b)


def mul(a: Vector, b) -> list[Column]:
    return _each(lambda x, y: x * y, a, b)


def div(a: Vector, b) -> list[Column]:
    return _each(lambda x, y: x / y, a, b)


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, parts)


def gt(a: Vector, b) -> Column:
    """Every component is greater; so for the other comparisons."""
    return _all(_each(lambda x, y: x > y, a, b))


def ge(a: Vector, b) -> Column:
    return _all(_each(lambda x, y: x >= y, a, b))


def lt(a: Vector, b) -> Column:
    return _all(_each(lambda x, y: x < y, a, b))


def le(a: Vector, b) -> Column:
    return _all(_each(lambda x, y: x <= y, a, b))


def norm2(a: Vector) -> Column:
    """The squared length."""
    return reduce(lambda x, y: x + y, [x * x for x in a])


def total(a: Vector) -> Column:
    return reduce(lambda x, y: x + y, a)


def product(a: Vector) -> Column:
    return reduce(lambda x, y: x * y, a)


def largest(a: Vector, b: Vector) -> list[Column]:
    return _each(F.greatest, a, b)


def least(a: Vector, b: Vector) -> list[Column]:
    return _each(F.least, a, b)


def rsqrt(a: Vector) -> list[Column]:
    return [F.lit(1.0) / F.sqrt(x) for x in a]


def printed(a: Vector) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *(x.cast("string") for x in a)), F.lit(")"))


def wrap(a: Vector, width: Column) -> tuple[list[Column], Column]:
    """Components moved by one width into [-width / 2, width / 2], and two bits for each: 1 moved up, 2 moved down."""
    half = width / 2
    out = [F.when(x < -half, x + width).when(x > half, x - width).otherwise(x) for x in a]
    bits = [F.when(x < -half, F.lit(1 << 2 * i)).when(x > half, F.lit(2 << 2 * i)).otherwise(F.lit(0)) for i, x in enumerate(a)]
    return out, total(bits)


def unwrap(a: Vector, width: Column, mask: Column) -> list[Column]:
    """Undoes wrap()."""
    up = lambda i: mask.bitwiseAND(F.lit(1 << 2 * i)) != 0
    down = lambda i: mask.bitwiseAND(F.lit(2 << 2 * i)) != 0
    return [F.when(up(i), x - width).when(down(i), x + width).otherwise(x) for i, x in enumerate(a)]


def kahan(values: Column) -> Column:
    """The compensated sum of an array of doubles, in its order."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc: Column, v: Column) -> Column:
        y = v - acc["c"]
        t = acc["s"] + y
        return F.struct(t.alias("s"), ((t - acc["s"]) - y).alias("c"))

    return F.aggregate(values, zero, step, lambda acc: acc["s"])


def joined(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *(p.cast("string") for p in parts))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
