"""Space-filling-curve keys as column expressions.

A key is a long: the interleaved bits of an anchor from the top level down, then five bits of depth. Within a level
the first dimension is the lowest bit. The root is 0; bodies carry the greatest depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH_BITS = 5
#: Levels below the root that fit 64 bits, by dimension.
MAX_DEPTH = {2: 29, 3: 19}


def _long(x) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def shl(x: Column, n) -> Column:
    return F.call_function("shiftleft", _long(x), n.cast("int") if isinstance(n, Column) else F.lit(n))


def shr(x: Column, n) -> Column:
    return F.call_function("shiftrightunsigned", _long(x), n.cast("int") if isinstance(n, Column) else F.lit(n))


@dataclass(frozen=True)
class Keys:
    """The key algebra of one dimension, 2 or 3."""

    dim: int = 3

    def __post_init__(self) -> None:
        if self.dim not in MAX_DEPTH:
            raise ValueError("keys have 2 or 3 dimensions")

    @property
    def max_depth(self) -> int:
        return MAX_DEPTH[self.dim]

    @property
    def fan(self) -> int:
        return 1 << self.dim

    def _below(self, depth) -> Column | int:
        """Bits under the digit of a level."""
        return (F.lit(self.max_depth) - depth) * self.dim + DEPTH_BITS if isinstance(depth, Column) else (self.max_depth - depth) * self.dim + DEPTH_BITS

    def depth(self, k: Column) -> Column:
        return k.bitwiseAND(F.lit(31)).cast("int")

    def append_depth(self, bits: Column, depth) -> Column:
        return shl(bits, DEPTH_BITS).bitwiseOR(_long(depth))

    def remove_depth(self, k: Column) -> Column:
        return shr(k, DEPTH_BITS)

    def incr_depth(self, k: Column, by) -> Column:
        return k + _long(by)

    def next(self, k: Column, n=1) -> Column:
        """The n-th key after k at its depth. In two dimensions the root's doesn't fit and must not be asked for."""
        return k + shl(_long(n), self._below(self.depth(k)))

    def last(self, k: Column) -> Column:
        """The greatest key that k's descendants have, next(k) - 1 less its depth; fits for every key."""
        return k.bitwiseOR(shl(F.lit(1), self._below(self.depth(k))) - 1)

    def prefix(self, k: Column, depth) -> Column:
        """k's ancestor at a depth no greater than its own."""
        n = self._below(depth)
        return shl(shr(k, n), n).bitwiseOR(_long(depth))

    def clear_descendants(self, k: Column) -> Column:
        return self.prefix(k, self.depth(k))

    def parent(self, k: Column) -> Column:
        return self.prefix(k, F.greatest(self.depth(k) - 1, F.lit(0)))

    def ancestors(self, k: Column, include_self: bool = True) -> Column:
        """Keys from the root down to k."""
        top = self.depth(k) if include_self else self.depth(k) - 1
        return F.when(top < 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(top, F.lit(0))), lambda d: self.prefix(k, d)))

    def child(self, k: Column, i) -> Column:
        return (k + 1).bitwiseOR(shl(_long(i), self._below(self.depth(k) + 1)))

    def first_child(self, k: Column) -> Column:
        return k + 1

    def children(self, k: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.fan - 1)), lambda i: self.child(k, i))

    def msbits(self, k: Column, bits) -> Column:
        """The highest bits of the interleaved part."""
        return shr(k, self.dim * self.max_depth + DEPTH_BITS - bits)

    def is_descendant(self, up: Column, down: Column) -> Column:
        return (self.depth(up) < self.depth(down)) & (self.prefix(down, self.depth(up)) == up)

    def finest_ancestor(self, x: Column, y: Column) -> Column:
        """The deepest key that both lie under or are."""
        most = F.least(self.depth(x), self.depth(y))
        at = F.array_max(F.filter(F.sequence(F.lit(0), most), lambda d: self.prefix(x, d) == self.prefix(y, d)))
        return self.prefix(x, at)

    def digit(self, k: Column, depth) -> Column:
        return shr(k, self._below(depth)).bitwiseAND(F.lit(self.fan - 1)).cast("int")

    def direction(self, k: Column, dim: int, depth) -> Column:
        """Which half of its parent the ancestor at a depth takes in a dimension."""
        return shr(k, (self._below(depth) + dim)).bitwiseAND(F.lit(1)).cast("int")

    def index(self, k: Column, dim: int) -> Column:
        """The cell's integer coordinate in a dimension, 0 to 2^depth - 1."""
        digits = F.sequence(F.lit(1), F.lit(self.max_depth))
        bits = F.aggregate(digits, F.lit(0).cast("long"), lambda s, d: s * 2 + self.direction(k, dim, d))
        return shr(bits, F.lit(self.max_depth) - self.depth(k))

    def index_fast(self, k: Column, dim: int) -> Column:
        """As index(), by masks that compact every dim-th bit, without a loop."""
        x = shr(k, DEPTH_BITS + dim)
        if self.dim == 3:
            x = x.bitwiseAND(F.lit(0x1249249249249249))
            for n, m in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
                x = x.bitwiseXOR(shr(x, n)).bitwiseAND(F.lit(m))
        else:
            x = x.bitwiseAND(F.lit(0x5555555555555555))
            for n, m in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0xFFFFFFFF)):
                x = x.bitwiseXOR(shr(x, n)).bitwiseAND(F.lit(m))
        return shr(x, F.lit(self.max_depth) - self.depth(k))

    def spread(self, x: Column) -> Column:
        """The bits of an anchor's coordinate, dim places apart: a table look-up for each byte."""
        x = _long(x)
        table = F.array(*(F.lit(sum((b >> n & 1) << (self.dim * n) for n in range(8))).cast("long") for b in range(256)))
        parts = [shl(F.get(table, shr(x, 8 * i).bitwiseAND(F.lit(255)).cast("int")), 8 * self.dim * i) for i in range(-(-self.max_depth // 8))]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return out

    def encode(self, anchor: list[Column]) -> Column:
        """The finest key of an anchor."""
        bits = self.spread(anchor[0])
        for i, a in enumerate(anchor[1:], 1):
            bits = bits.bitwiseOR(shl(self.spread(a), i))
        return self.append_depth(bits, self.max_depth)

    def quantize(self, x: Column, low, width) -> Column:
        """An anchor's coordinate of a position; the upper boundary belongs to the last cell."""
        cell = F.floor((x - low) / (width / float(1 << self.max_depth))).cast("long")
        return F.greatest(F.least(cell, F.lit((1 << self.max_depth) - 1)), F.lit(0))

    def region(self, k: Column, dim: int, low, width) -> tuple[Column, Column]:
        """The cell's bounds in a dimension of a cube that begins at `low`."""
        side = width / F.pow(F.lit(2.0), self.depth(k))
        at = self.index_fast(k, dim)
        return low + at * side, low + (at + 1) * side

    def overlapped(self, x1: Column, x2: Column, y1: Column, y2: Column) -> Column:
        """Whether the half-open ranges [x1, x2) and [y1, y2) meet, depths aside."""
        a, b, c, d = (self.remove_depth(k) for k in (x1, x2, y1, y2))
        return (a < d) & (c < b)

    def includes(self, up: Column, k: Column) -> Column:
        return (up == k) | self.is_descendant(up, k)

    def includes_range(self, begin: Column, end: Column, k: Column) -> Column:
        """Whether all of k's cell lies in [begin, end)."""
        first, last = self.remove_depth(k), self.remove_depth(self.last(k))
        return (self.remove_depth(begin) <= first) & (last < self.remove_depth(end))

    def decoded(self, k: Column) -> Column:
        """Overflow and digits in binary groups from the top, then the depth, like 0-101-011<2>."""
        group = lambda d: F.lpad(F.bin(self.digit(k, d)), self.dim, "0")
        levels = F.when(self.depth(k) > 0, F.transform(F.sequence(F.lit(1), F.greatest(self.depth(k), F.lit(1))), group)).otherwise(F.expr("cast(array() as array<string>)"))
        return F.concat(F.array_join(F.concat(F.array(F.bin(shr(k, self.dim * self.max_depth + DEPTH_BITS))), levels), "-"), F.lit("<"), self.depth(k).cast("string"), F.lit(">"))

    def simplified(self, k: Column) -> Column:
        """The first and the last four of the key's twenty decimal digits."""
        s = F.lpad(k.cast("string"), 20, "0")
        return F.concat(F.substring(s, 1, 4), F.lit(".."), F.substring(s, 17, 4))


def min_bit_length(x: Column) -> Column:
    """Bits that a number not below 0 takes."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(F.lit(0))


def levelwise(anchor: list[Column], level: Column, dim: int = 3) -> Column:
    """Cells numbered level by level: those above, (fan^level - 1) / (fan - 1), and the interleaved anchor."""
    k = Keys(dim)
    fan = 1 << dim
    bits = k.spread(anchor[0])
    for i, a in enumerate(anchor[1:], 1):
        bits = bits.bitwiseOR(shl(k.spread(a), i))
    above = ((F.pow(F.lit(float(fan)), level) - 1) / (fan - 1)).cast("long")
    return above + bits


def uniform_leaf(anchor: list[Column], dim: int = 3) -> Column:
    """The interleaved anchor at a fixed level, without a depth."""
    k = Keys(dim)
    bits = k.spread(anchor[0])
    for i, a in enumerate(anchor[1:], 1):
        bits = bits.bitwiseOR(shl(k.spread(a), i))
    return bits
