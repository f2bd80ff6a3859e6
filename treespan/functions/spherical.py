"""Solid harmonics: regular ones grow with distance, singular ones fall, and their products add up to 1 / distance.

With Legendre's P of degree n and order m (with its factor (-1)^m), at distance r, polar angle a and azimuth b:
regular (-1)^n / (n + m)! r^n P(cos a) e^(i m b), singular (-1)^n (n - m)! r^(-n - 1) P(cos a) e^(i m b). Orders below
0 are conjugates. The place of (n, m) among all of degree below the order is n^2 + n + m.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

AXES = ("x", "y", "z")


def legendre(c: np.ndarray, s: np.ndarray, order: int) -> dict[tuple[int, int], np.ndarray]:
    """P by degree and order, both below `order` and m <= n, at cosines c and sines s."""
    out = {(0, 0): np.ones_like(c)}
    for m in range(order):
        if m:
            out[m, m] = -(2 * m - 1) * s * out[m - 1, m - 1]
        for n in range(m + 1, order):
            out[n, m] = ((2 * n - 1) * c * out[n - 1, m] - (n + m - 1) * out.get((n - 2, m), 0.0)) / (n - m)
    return out


def _polar(d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distance, cosine and sine of the polar angle, and azimuth as a unit complex number; along the axis that is 1."""
    flat = np.hypot(d[:, 0], d[:, 1])
    r = np.hypot(flat, d[:, 2])
    safe = np.where(r > 0, r, 1.0)
    turn = np.where(flat > 0, (d[:, 0] + 1j * d[:, 1]) / np.where(flat > 0, flat, 1.0), 1.0 + 0j)
    return r, np.where(r > 0, d[:, 2] / safe, 1.0), flat / safe, turn


def _filled(rows: int, order: int, term) -> np.ndarray:
    """All harmonics from those of order 0 and above."""
    out = np.zeros((rows, order * order), complex)
    for n in range(order):
        for m in range(n + 1):
            out[:, n * n + n + m] = term(n, m)
            out[:, n * n + n - m] = out[:, n * n + n + m].conj()
    return out


def regular(d: np.ndarray, order: int) -> np.ndarray:
    """Regular harmonics of rows of vectors: (rows, order^2)."""
    r, c, s, turn = _polar(d)
    p = legendre(c, s, order)
    return _filled(len(d), order, lambda n, m: (-1) ** n / factorial(n + m) * r**n * p[n, m] * turn**m)


def regular_by_angle(d: np.ndarray, order: int) -> np.ndarray:
    """Derivatives of the regular harmonics by the polar angle."""
    r, c, s, turn = _polar(d)
    p = legendre(c, s, order + 1)

    def slope(n: int, m: int) -> np.ndarray:
        """By neighbouring orders, so that nothing is divided by the sine; order -1 is -P(n, 1) / (n (n + 1))."""
        up = p[n, m + 1] if m < n else 0.0
        down = p[n, m - 1] * (n + m) * (n - m + 1) if m else -p.get((n, 1), 0.0) if n else 0.0
        return (up - down) / 2

    return _filled(len(d), order, lambda n, m: (-1) ** n / factorial(n + m) * r**n * slope(n, m) * turn**m)


def singular(d: np.ndarray, order: int) -> np.ndarray:
    """Singular harmonics of rows of vectors other than 0: (rows, order^2)."""
    r, c, s, turn = _polar(d)
    p = legendre(c, s, order)
    return _filled(len(d), order, lambda n, m: (-1) ** n * factorial(n - m) * r ** -(n + 1.0) * p[n, m] * turn**m)


KINDS = {"regular": regular, "by_angle": regular_by_angle, "singular": singular}


def with_harmonics(df: DataFrame, order: int, kind: str = "regular", by: str = "body_id") -> DataFrame:
    """(by, re, im): harmonics of each row's vector x, y, z as two arrays of order^2."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            h = KINDS[kind](np.stack([b.column(a).to_numpy() for a in AXES], axis=1), order)
            yield pa.RecordBatch.from_arrays([b.column(by), *(pa.array(list(x)) for x in (h.real, h.imag))], names=[by, "re", "im"])

    return df.select(by, *AXES).mapInArrow(run, f"{by} {df.schema[by].dataType.simpleString()}, re array<double>, im array<double>")
