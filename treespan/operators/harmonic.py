"""Expansions in solid harmonics: a fifth of the Cartesian terms at order 10 for the same result.

Coefficients travel as real parts followed by imaginary parts. A multipole is the sum of strength times the regular
harmonics of the vector from the centre to the source; its potential is the sum of its conjugates times the singular
harmonics. A local expansion's potential is the sum of its coefficients times the conjugate regular harmonics.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from treespan.functions.spherical import regular, singular
from treespan.operators.expansions import Rules


def _at(n: int, m: int) -> int:
    return n * n + n + m


def _packed(c: np.ndarray) -> np.ndarray:
    return np.concatenate([c.real, c.imag], axis=1)


def _unpacked(c: np.ndarray) -> np.ndarray:
    half = c.shape[1] // 2
    return c[:, :half] + 1j * c[:, half:]


def _sign(m: int) -> int:
    """Between harmonics whose negative orders are conjugates and those that obey the sum rules without signs."""
    return -1 if m < 0 and m % 2 else 1


@lru_cache
def _pairs(order: int, kind: str) -> list[tuple[int, int, int, int]]:
    """(to, from, by, sign) of a shift: degrees add up ("m2m"), or go down ("l2l"), or meet in the kernel's ("m2l")."""
    out = []
    for n in range(order):
        for m in range(-n, n + 1):
            for k in range(order - n if kind != "m2m" else n + 1):
                for j in range(-k, k + 1):
                    if kind == "m2m":
                        if abs(m - j) <= n - k:
                            out.append((_at(n, m), _at(n - k, m - j), _at(k, j), _sign(m) * _sign(j) * _sign(m - j)))
                    else:  # n, m is the result; k, j the rest
                        sign = _sign(m) * _sign(j) * _sign(m + j)
                        out.append((_at(n, m), _at(n + k, m + j), _at(k, j), sign) if kind == "l2l" else (_at(n, m), _at(k, j), _at(n + k, m + j), sign * (-1) ** n))
    return out


def p2m(q: np.ndarray, d: np.ndarray, order: int) -> np.ndarray:
    return _packed(q[:, None] * regular(-d, order))


def m2m(m: np.ndarray, d: np.ndarray, order: int) -> np.ndarray:
    old, by = _unpacked(m), regular(-d, order)
    out = np.zeros_like(old)
    for to, of, at, sign in _pairs(order, "m2m"):
        out[:, to] += sign * old[:, of] * by[:, at]
    return _packed(out)


def m2l(m: np.ndarray, r: np.ndarray, order: int) -> np.ndarray:
    old, by = _unpacked(m).conj(), singular(r, order)
    out = np.zeros_like(old)
    for to, of, at, sign in _pairs(order, "m2l"):
        out[:, to] += sign * old[:, of] * by[:, at]
    return _packed(out)


def l2l(c: np.ndarray, d: np.ndarray, order: int) -> np.ndarray:
    old, by = _unpacked(c), regular(d, order).conj()
    out = np.zeros_like(old)
    for to, of, at, sign in _pairs(order, "l2l"):
        out[:, to] += sign * old[:, of] * by[:, at]
    return _packed(out)


def _slopes(value: dict[tuple[int, int], np.ndarray], n: int, m: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives by x, y, z of the harmonic (n, m >= 0) from those of the degree above (step 1) or below (-1)."""
    zero = np.zeros_like(value[0, 0])
    get = lambda k, j: zero if k < 0 or abs(j) > k else value[k, j] if j >= 0 else value[k, -j].conj() * (-1) ** j
    z = get(n + step, m) * step
    up, down = get(n + step, m + 1), get(n + step, m - 1)
    # the derivatives by x + iy and x - iy
    plus, minus = -up, down
    return (plus + minus) / 2, (plus - minus) / 2j, z


def _evaluated(c: np.ndarray, h: np.ndarray, order: int, top: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Potential and gradient of real fields: sums over orders from 0 up, those above 0 twice."""
    value = {(n, m): h[:, _at(n, m)] for n in range(top) for m in range(n + 1)}
    pot, grad = np.zeros(len(c)), np.zeros((len(c), 3))
    for n in range(order):
        for m in range(n + 1):
            k = c[:, _at(n, m)].conj() * (2 if m else 1)
            pot += (k * value[n, m]).real
            for i, s in enumerate(_slopes(value, n, m, step)):
                grad[:, i] += (k * s).real
    return pot, grad


def m2p(m: np.ndarray, r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return _evaluated(_unpacked(m), singular(r, order + 1), order, order + 1, 1)


def l2p(c: np.ndarray, d: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return _evaluated(_unpacked(c), regular(d, order), order, order, -1)


SPHERICAL = Rules(lambda order: 2 * order * order, p2m, m2m, m2l, l2l, l2p, m2p)
