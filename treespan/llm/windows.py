"""Repeated windows of a fixed length in sequences of tokens, found by most-significant-digit passes.

A window of `length` tokens has as its first digit the k-gram of least hash in it (the leftmost of equal ones), its
anchor. Windows of one document that share an anchor at one place follow each other, so one row stands for all of
them: their anchor's hash and, as the next digit, the hash of all they cover, their span. Equal windows have equal
anchors at equal distance. A pass by the anchor drops those that occur once; a pass by the span settles those whose
whole span occurs again; only where spans differ do windows go through the last pass, one by one, by the hashes of
their two halves. What a block of documents settles by itself isn't shuffled: of equal rows one stands for all, so
that a hot passage sends no more than a few rows for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = 0x5851F42D4C957F2D
_PLACE = np.uint64((1 << 22) - 1)
#: Tokens that are looked at together; longer documents are cut into pieces that overlap by a window less one token.
TOGETHER = 1 << 20
#: Windows that are settled together in the last pass.
WINDOWS = 1 << 19
#: Sums of powers modulo 2^64 are hashes of so many tokens at most; of longer runs, each such part has its own.
PART = 256

#: Kinds of rows of the passes by anchor and span. A plain row; a mark that the anchor has many spans; a row of such an
#: anchor, which goes to the last pass; a row that its block has settled.
ROW, MARK, OPEN, DONE = range(4)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        p[1:] = np.uint64(b)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of hashes; no two become equal."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hashes of any run of an array of unsigned 64-bit tokens."""

    def __init__(self, tokens: np.ndarray):
        power, self.inverse = _powers(TOGETHER + (1 << 16))
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * power[: len(tokens)], out=self.sums[1:])

    def _parts(self, start, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        length = np.broadcast_to(length, start.shape)
        out = self._parts(start, np.minimum(length, PART))
        for a in range(PART, int(length.max(initial=0)), PART):
            more = np.flatnonzero(length > a)
            out[more] = mix(out[more] * np.uint64(_BASE) ^ self._parts(start[more] + a, np.minimum(length[more] - a, PART)))
        return out

    def every(self, length: int) -> np.ndarray:
        if length > PART:
            return self.of(np.arange(len(self.sums) - length), length)
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if span < width else keys


def runs(tokens: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of pieces that end at `ends` in `tokens`: anchor hash, span hash, first window and number of windows less one."""
    none = np.zeros(0, np.int64)
    if len(tokens) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none
    hashes = Hashes(tokens)
    keys = hashes.every(gram)
    keys = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    at = (least(keys, length - gram + 1) & _PLACE).astype(np.int64)
    inside = np.ones(len(tokens) + 1, bool)
    for b in range(1, length):
        inside[np.maximum(ends - b, 0)] = False
    begin = np.concatenate([[0], ends[:-1]])
    for b, e in zip(begin[ends - begin < length].tolist(), ends[ends - begin < length].tolist()):
        inside[b:e] = False
    p = np.flatnonzero(inside[: len(at)])
    if not len(p):
        return none.view(np.uint64), none.view(np.uint64), none, none
    q = at[p]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    low, more, place = p[first], p[last] - p[first], q[first]
    anchor = hashes.of(place, gram)
    span = mix(hashes.of(low, more + length) ^ mix(((place - low) << 20 | more).astype(np.uint64)))
    return anchor, span, low, more


def pieces(docs: Iterator[np.ndarray], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Batches of documents' pieces: which document each is of, where it starts there, all tokens, and the pieces' ends."""
    which, start, held, size = [], [], [], 0
    for i, doc in enumerate(docs):
        for a in range(0, max(1, len(doc) - length + 1), TOGETHER // 2):
            part = doc[a : a + TOGETHER // 2 + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > TOGETHER:
                yield which, start, np.concatenate(held), np.cumsum([len(h) for h in held])
                which, start, held, size = [], [], [], 0
            which.append(i)
            start.append(a)
            held.append(part)
            size += len(part)
    if held:
        yield which, start, np.concatenate(held), np.cumsum([len(h) for h in held])


def spans(docs: Iterator[np.ndarray], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of (document's index, anchor, span, first window, windows less one)."""
    for which, start, tokens, ends in pieces(docs, length):
        anchor, span, low, more = runs(tokens, ends, length, gram)
        piece = np.searchsorted(ends, low, "right")
        begin = np.concatenate([[0], ends[:-1]])
        yield np.array(which)[piece], anchor, span, low - begin[piece] + np.array(start)[piece], more


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals within n tokens as starts and ends of its maximal runs."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    on = np.concatenate([[0], (np.cumsum(change[:n]) > 0).astype(np.int8), [0]])
    step = np.diff(on)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each of some sorted rows is the first of its keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _apart(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Anchors of their own for rows that no longer meet others."""
    return mix(key.view(np.uint64) * np.uint64(_BASE) ^ mix(place.view(np.uint64)))


def settled(anchor: np.ndarray, span: np.ndarray, rank: np.ndarray | None, key: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """What of a block's rows is to be shuffled: anchor, span, rank, key, place, weight and kind of each.

    Of rows of equal anchor and span, one (with ranks: all of the least) stands for the others, which are DONE; its
    weight is their number. Anchors of over `most` spans get one MARK, and their rows are OPEN.
    """
    order = np.lexsort((place, key, span, anchor) if rank is None else (place, key, rank, span, anchor))
    anchor, span, key, place = anchor[order], span[order], key[order], place[order]
    ranked = rank is not None
    rank = rank[order] if ranked else np.zeros(len(key), np.int64)
    new_anchor = _groups(anchor)
    new = new_anchor | _groups(span)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    of = np.cumsum(new_anchor) - 1
    weight = np.where(new, np.diff(np.append(first, len(key)))[group] if len(key) else 0, 1)
    many = (np.bincount(of[first], minlength=1) > most)[of] if len(key) else np.zeros(0, bool)
    stands = rank == rank[first][group] if ranked else new
    kind = np.where(stands, np.where(many, OPEN, ROW), DONE)
    marks = np.flatnonzero(new_anchor & many)
    dealt = np.where(kind == ROW, anchor, _apart(key, place))
    cols = (dealt.view(np.int64), span.view(np.int64), rank, key, place, weight, kind)
    ends = (anchor[marks].view(np.int64), span[marks].view(np.int64), rank[marks], key[marks], place[marks], np.zeros(len(marks), np.int64), np.full(len(marks), MARK))
    return tuple(np.concatenate(c) for c in zip(cols, ends))


def halves(hashes: Hashes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of windows that start at `at`: hashes of their first half and of the rest."""
    half = length // 2
    return hashes.of(at, half), hashes.of(at + half, length - half)


def ordered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings windows of equal digits together, and whether each is then the first of its group."""
    order = np.argsort(high ^ mix(low))
    return order, _groups(high[order], low[order])


def stretches(key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as maximal runs of successive starts: key, first token and end of each."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = _groups(key)
    new[1:] |= start[1:] > start[:-1] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key))[: len(first)] - 1
    return key[first], start[first], start[last] + length
