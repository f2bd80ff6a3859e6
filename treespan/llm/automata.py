"""Substring dedup by words: suffix automata of reference shards, over which documents' matching statistics run.

A shard holds what one anchor (see windows.py) brings together: the stretches of words around it that differ, in
order of their documents. Its automaton takes in what earlier documents have; the next document's stretch is read
over it, and wherever the longest match reaches the threshold, that window starts in an earlier document. Where all
stretches together are few words, one automaton of them, which knows the least document of each run, is broadcast, and
the stretches stream over it. Beyond, automata go to the tasks that hold the stretches, not to all, as together they
grow with the corpus. Stretches that are equal as a whole need none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treespan.llm.common import batches_of, discard, materialize, with_row_key
from treespan.llm.suffix_dedup import runs_of, without
from treespan.llm.windows import DONE, MARK, OPEN, WINDOWS, Hashes, halves, mix, ordered, settled, spans, stretches

LENGTH = 13
#: Words of an anchor at that length.
GRAM = 5
#: Rows of an anchor beyond which its windows are counted one by one instead: that can be dealt to many tasks.
SHARD = 4096
#: Words of all stretches up to which one automaton of them is broadcast.
TOLD_WORDS = 1 << 16
#: Stretches of an anchor in a block of documents beyond which it counts as such an anchor at once.
MOST_SPANS = 64
#: Texts that a Python worker gets at once.
TEXTS = 2000
_ROWS = "anchor long, span long, rank long, key long, place long, kind int"


class Automaton:
    """Suffix automaton of several sequences of hashable tokens."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [0]

    def _state(self, length: int, next_: dict, link: int, least: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.link) - 1

    def _split(self, p: int, q: int, token) -> int:
        """A copy of q for the shorter suffixes that lead there by `token` from p and its links."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.least[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, tokens: Sequence, rank: int = 0) -> None:
        """Takes in a sequence. Where ranks never fall from one to the next, a state has the least of its runs."""
        last = 0
        for t in tokens:
            q = self.next[last].get(t)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, t)
                continue
            new = self._state(self.length[last] + 1, {}, 0, rank)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, t)
            last = new

    def matches(self, tokens: Sequence) -> list[int]:
        """For each token the length of the longest run ending there that a sequence taken in has."""
        return [n for n, _ in self.walk(tokens)]

    def windows(self, tokens: Sequence, length: int) -> Iterator[tuple[int, int]]:
        """Where runs of `length` tokens begin that a sequence taken in has, and the least rank of those that have it."""
        for i, (n, state) in enumerate(self.walk(tokens)):
            if n >= length:
                while self.length[self.link[state]] >= length:
                    state = self.link[state]
                yield i - length + 1, self.least[state]

    def walk(self, tokens: Sequence) -> Iterator[tuple[int, int]]:
        """For each token the length of the longest run ending there that a sequence taken in has, and its state."""
        state = n = 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (to := self.next[state].get(t)) is not None:
                state, n = to, n + 1
            else:
                n = 0
            yield n, state


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # of bytes: at white space from 9 to 13 and 32 only


def tokens(said: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, said), np.uint64, len(said)) | np.uint64(1)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _first_digits(length: int, gram: int) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            key, rank = b.column("key").to_numpy(), b.column("rank").to_numpy()
            for doc, anchor, span, low, more in spans((tokens(words(t)) for t in _texts(b)), length, gram):
                anchor, span, ranks, keys, place, _, kind = settled(anchor, span, rank[doc], key[doc], low << 20 | more, MOST_SPANS)
                cols = [pa.array(c) for c in (anchor, span, ranks, keys, place, kind.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "span", "rank", "key", "place", "kind"])

    return run


def _stretches(length: int) -> Callable:
    """The words' hashes under the windows asked for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for rank, key, text, asked in zip(b.column("rank").to_pylist(), b.column("key").to_pylist(), _texts(b), b.column("asked").to_pylist()):
                hashes = tokens(words(text))
                rows = [(a["anchor"], a["large"], a["place"] >> 20, hashes[a["place"] >> 20 : (a["place"] >> 20) + (a["place"] & 0xFFFFF) + length].tobytes()) for a in asked]
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([cols[0], cols[1], pa.array([rank] * len(rows), pa.int64()), pa.array([key] * len(rows), pa.int64()), *cols[2:]], names=["anchor", "large", "rank", "key", "low", "words"])

    return run


def _by_automata(length: int) -> Callable:
    """Over rows (anchor, rank, key, low, words) in order of anchor and rank: the windows that earlier ranks have."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of, rank, mine = Automaton(), None, None, []
        for b in parts:
            key, start = [], []
            for anchor, r, k, low, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "rank", "key", "low", "words"))):
                if anchor != of:
                    shard, of, rank, mine = Automaton(), anchor, r, []
                elif r != rank:
                    for said in mine:
                        shard.add(said)
                    rank, mine = r, []
                said = np.frombuffer(raw, np.int64).tolist()
                for i, n in enumerate(shard.matches(said)):
                    if n >= length:
                        key.append(k)
                        start.append(low + i - length + 1)
                mine.append(said)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int64())], names=["key", "start"])

    return run


def _told(read: DataFrame, length: int) -> DataFrame:
    """(key, start): windows that earlier ranks have, by one automaton of all stretches: at most TOLD_WORDS words."""
    shard = Automaton()
    for r in sorted(read.select("rank", "words").collect()):
        shard.add(np.frombuffer(r.words, np.int64).tolist(), r.rank)
    held = read.sparkSession.sparkContext.broadcast(shard)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            key, start = [], []
            for rank, k, low, raw in zip(*(b.column(c).to_pylist() for c in ("rank", "key", "low", "words"))):
                for at, least in held.value.windows(np.frombuffer(raw, np.int64).tolist(), length):
                    if least < rank:
                        key.append(k)
                        start.append(low + at)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int64())], names=["key", "start"])

    return read.mapInArrow(run, "key long, start long")


def _block(high: np.ndarray, low: np.ndarray, rank: np.ndarray, key: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """A block's windows of the least rank that they have here; and cuts (of null rank, their end as `low`) of the others."""
    order, new = ordered(high, low)
    high, low, rank, key, start = (x[order] for x in (high, low, rank, key, start))
    first = np.flatnonzero(new)
    least = rank == np.minimum.reduceat(rank, first)[np.cumsum(new) - 1] if len(first) else np.zeros(0, bool)
    k, s, e = stretches(key[~least], start[~least], length)
    alone = mix(k.view(np.uint64) ^ mix(s.view(np.uint64)))
    cols = zip((high[least].view(np.int64), low[least].view(np.int64), key[least], start[least]), (alone.view(np.int64), e, k, s))
    ranks = pa.concat_arrays([pa.array(rank[least], pa.int64()), pa.nulls(len(k), pa.int64())])
    return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c), pa.int64()) for c in cols), ranks], names=["high", "low", "key", "start", "rank"])


def _windows(length: int) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in parts:
            for rank, key, low, raw in zip(*(b.column(c).to_pylist() for c in ("rank", "key", "low", "words"))):
                said = np.frombuffer(raw, np.uint64)
                at = np.arange(len(said) - length + 1)
                held.append((*halves(Hashes(said), at, length), np.full(len(at), rank), np.full(len(at), key), at + low))
                size += len(at)
                if size >= WINDOWS:
                    yield _block(*map(np.concatenate, zip(*held)), length)
                    held, size = [], 0
        if held:
            yield _block(*map(np.concatenate, zip(*held)), length)

    return run


def with_cuts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (key, doc_id, text, cuts): cuts are the intervals of words under windows that start in a smaller id's text.

    They may overlap; cuts are null where there are none. Ids are integers; a null id is larger than any other, and
    rows of equal id don't cut each other. Null, empty and short texts have no windows.
    """
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    docs = with_row_key(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "key").withColumn("rank", rank)
    with batches_of(df.sparkSession, TEXTS):
        digits = docs.select("key", "rank", "text").mapInArrow(_first_digits(length, gram), _ROWS)
        group, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "span")
        marked = F.max("kind").over(group) == MARK
        passed = digits.withColumns({
            "first": F.min("rank").over(same),
            "large": (F.col("kind") == OPEN) | marked | (F.count("*").over(group) > SHARD),
            "apart": (F.min("span").over(group) != F.max("span").over(group)) | marked,
        })
        cut = (F.col("kind") == DONE) | ((F.col("kind") < MARK) & (F.col("rank") > F.col("first")))
        ask = (F.col("kind") == OPEN) | ((F.col("kind") < MARK) & F.col("apart") & (F.col("rank") == F.col("first")))
        known = materialize(passed.select("key", "place", "large", "anchor", cut.alias("cut"), ask.alias("ask")).where("cut or ask"), few_files=True)
        asked = known.where("ask").groupBy("key").agg(F.collect_list(F.struct("anchor", "large", "place")).alias("asked"))
        held = docs.join(asked, "key").select("key", "text", "rank", "asked")
        read = materialize(held.mapInArrow(_stretches(length), "anchor long, large boolean, rank long, key long, low long, words binary"), few_files=True)
        start = F.shiftright("place", 20)
        cuts = known.where("cut").select("key", start.alias("start"), (start + F.col("place").bitwiseAND(F.lit(0xFFFFF)) + length).alias("end"))
        if (read.agg(F.sum(F.length("words"))).first()[0] or 0) <= 8 * TOLD_WORDS:
            cuts = cuts.union(_told(read, length).select("key", "start", (F.col("start") + length).alias("end")))
        else:
            small = read.where("not large").drop("large").repartition("anchor").sortWithinPartitions("anchor", "rank").mapInArrow(_by_automata(length), "key long, start long")
            large = read.where("large").select("rank", "key", "low", "words").mapInArrow(_windows(length), "high long, low long, key long, start long, rank long")
            large = large.withColumn("first", F.min("rank").over(Window.partitionBy("high", "low"))).where("rank is null or rank > first")
            cuts = cuts.union(small.select("key", "start", (F.col("start") + length).alias("end")))
            cuts = cuts.union(large.select("key", "start", F.when(F.col("rank").isNull(), F.col("low")).otherwise(F.col("start") + length).alias("end")))
        cuts = materialize(cuts)
        discard(known, read)
    return docs.join(cuts.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("cuts")), "key", "left").select("key", "doc_id", "text", "cuts")


def _cut(df: DataFrame, out: str, kinds: Sequence[pa.DataType], made: Callable[[list[bytes], list[bytes], int], tuple]) -> DataFrame:
    names = ["doc_id", *(c.split()[0] for c in out.split(", "))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for text, cuts in zip(_texts(b), b.column("cuts").to_pylist()):
                said = words(text)
                starts, ends = runs_of(len(said), cuts)
                kept = [w for part in without(said, starts, ends) for w in part]
                rows.append(made(said, kept, len(starts)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {out}")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each row its id, the words kept joined by spaces, how many words went, and in how many runs."""
    cut = with_cuts(df, id_col, text_col, length, gram)
    return _cut(cut, "text string, n_removed long, n_spans long", (pa.string(), pa.int64(), pa.int64()), lambda said, kept, n: (b" ".join(kept).decode(), len(said) - len(kept), n))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    cut = with_cuts(df, id_col, text_col, length, gram)
    return _cut(cut, "n_words long, n_removed long, kept_sha256 string", (pa.int64(), pa.int64(), pa.string()), lambda said, kept, n: (len(said), len(said) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
