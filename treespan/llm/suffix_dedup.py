"""Repeated passages: suffixes ordered only through the threshold, by most-significant-digit passes.

Suffixes that are equal through `length` bytes are a group of the last pass, and those groups are all that is asked
for, so a pass deals suffixes out by the next digit and drops those alone in theirs; no order beyond it is made.
Digits are of varying length (see windows.py): the anchor, the span, and, for the few suffixes still undecided, the
window's two halves. Texts are moved by their row's key only, never by their digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treespan.llm.common import batches_of, discard, materialize, with_row_key
from treespan.llm.windows import DONE, MARK, OPEN, WINDOWS, Hashes, cover, halves, ordered, settled, spans, stretches
from treespan.llm.windows import mix as mixed

LENGTH = 200
#: Spans of an anchor in a block of documents beyond which their suffixes go to the last pass at once.
MOST_SPANS = 8
#: Texts that a Python worker gets at once.
TEXTS = 2000
_ROWS = "anchor long, span long, key long, place long, weight long, kind int"
_SUFFIXES = "high long, low long, key long, start long, weight long"
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _tokens(raw: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(raw, np.uint8)]


def _raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _first_digits(length: int) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            key = b.column("key").to_numpy()
            for doc, anchor, span, low, more in spans(map(_tokens, _raw(b, "text")), length, length // 2):
                anchor, span, _, keys, place, weight, kind = settled(anchor, span, None, key[doc], low << 20 | more, MOST_SPANS)
                cols = [pa.array(c) for c in (anchor, span, keys, place, weight, kind.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "span", "key", "place", "weight", "kind"])

    return run


def _block(high: np.ndarray, low: np.ndarray, key: np.ndarray, start: np.ndarray, weight: np.ndarray, length: int) -> pa.RecordBatch:
    """One row for each of a block's suffixes, of a weight of at most 2; and cuts (weight 0, their end as `low`) of those that occur again here."""
    order, new = ordered(high, low)
    high, low, key, start, weight = (x[order] for x in (high, low, key, start, weight))
    first = np.flatnonzero(new)
    again = np.add.reduceat(weight, first) > 1 if len(first) else np.zeros(0, bool)
    cut = again[np.cumsum(new) - 1] & (weight == 1) if len(first) else np.zeros(0, bool)
    k, s, e = stretches(key[cut], start[cut], length)
    alone = mixed(k.view(np.uint64) ^ mixed(s.view(np.uint64)))
    cols = zip((high[first].view(np.int64), low[first].view(np.int64), key[first], start[first], np.where(again, 2, 1)), (alone.view(np.int64), e, k, s, np.zeros(len(k), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=["high", "low", "key", "start", "weight"])


def _stretches(length: int) -> Callable:
    """The bytes under the suffixes asked for; where their span occurs again they are cut already and weigh 2."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for key, raw, asked in zip(b.column("key").to_pylist(), _raw(b, "text"), b.column("asked").to_pylist()):
                places = np.array([(a["place"] >> 20, (a["place"] & 0xFFFFF) + length, min(a["same"], 2)) for a in asked], np.int64)
                said = [raw[low : low + n] for low, n, _ in places.tolist()]
                cols = [pa.array(np.full(len(said), key)), pa.array(places[:, 0]), pa.array(places[:, 2]), pa.array(said, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "low", "weight", "bytes"])

    return run


def _last_digits(length: int) -> Callable:
    """The two digits of each suffix of stretches (key, low, weight, bytes), settled block by block."""

    def made(held: list[tuple]) -> pa.RecordBatch:
        key, low, weight, said = zip(*held)
        n = np.array([len(x) for x in said]) - length + 1
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        each = lambda x: np.repeat(np.array(x, np.int64), n)
        return _block(*halves(Hashes(_tokens(b"".join(said))), np.repeat(begin, n) + step, length), each(key), each(low) + step, each(weight), length)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in parts:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "low", "weight", "bytes"))):
                held.append(row)
                size += len(row[3])
                if size >= WINDOWS:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return run


def with_cuts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (key, doc_id, text, cuts): cuts are the intervals of bytes under windows that start elsewhere, too.

    They may overlap; cuts are null where there are none. Null and empty texts and those shorter than `length` have
    none. Repeated rows are documents of their own, so each of them is covered wholly. The input is written once with
    a key for each row, so its plan may be any.
    """
    if not 2 <= length < 1 << 14:
        raise ValueError("length must be from 2 to 16383 bytes")
    docs = with_row_key(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "key")
    with batches_of(df.sparkSession, TEXTS):
        digits = docs.select("key", "text").mapInArrow(_first_digits(length), _ROWS)
        group, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "span")
        passed = digits.withColumns({
            "same": F.sum("weight").over(same),
            "nth": F.row_number().over(same.orderBy("kind", "key", "place")),
            "apart": (F.min("span").over(group) != F.max("span").over(group)) | (F.max("kind").over(group) == MARK),
        })
        cut = (F.col("kind") == DONE) | ((F.col("kind") != MARK) & (F.col("same") > 1))
        ask = (F.col("kind") == OPEN) | ((F.col("kind") < MARK) & F.col("apart") & (F.col("nth") == 1))
        known = materialize(passed.select("key", "place", "same", cut.alias("cut"), ask.alias("ask")).where("cut or ask"), few_files=True)
        asked = known.where("ask").groupBy("key").agg(F.collect_list(F.struct("place", "same")).alias("asked"))
        # written, so that the texts' shuffle is gone before the suffixes' begins
        held = materialize(docs.join(asked, "key").select("key", "text", "asked").mapInArrow(_stretches(length), "key long, low long, weight long, bytes binary"), few_files=True)
        again = held.mapInArrow(_last_digits(length), _SUFFIXES)
        again = again.withColumn("all", F.sum("weight").over(Window.partitionBy("high", "low"))).where("weight = 0 or weight = 1 and all > 1")
        start = F.shiftright("place", 20)
        cuts = (
            known.where("cut").select("key", start.alias("start"), (start + F.col("place").bitwiseAND(F.lit(0xFFFFF)) + length).alias("end"))
            .union(again.select("key", "start", F.when(F.col("weight") == 0, F.col("low")).otherwise(F.col("start") + length).alias("end")))
        )
        cuts = materialize(cuts, few_files=True)
        discard(known, held)
    return docs.join(cuts.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("cuts")), "key", "left").select("key", "doc_id", "text", "cuts")


def runs_of(n: int, cuts: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of n tokens under cuts."""
    if not cuts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return cover(n, np.array([c["start"] for c in cuts]), np.array([c["end"] for c in cuts]))


def without(raw, starts: np.ndarray, ends: np.ndarray):
    """What of a sequence lies outside the runs, as a list of its parts."""
    return [raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)])]


def dedup(df: DataFrame, text_col: str = "text", removed_col: str = "removed_bytes", length: int = LENGTH) -> DataFrame:
    """The rows with each text less its repeated bytes, and how many those were.

    Halves of characters that a cut leaves at its edges go, too. A null text stays null. Other columns stay; one
    called as the new one is replaced.
    """
    kept = [c for c in df.columns if c not in (text_col, removed_col)]
    inner = with_cuts(df.select(F.struct(*kept).alias("__rest") if kept else F.lit(0).alias("__rest"), text_col), "__rest", text_col, length)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts, removed = [], []
            for old, raw, cuts in zip(b.column("text").to_pylist(), _raw(b, "text"), b.column("cuts").to_pylist()):
                starts, ends = runs_of(len(raw), cuts)
                removed.append(int((ends - starts).sum()))
                texts.append(b"".join(without(raw, starts, ends)).decode("utf-8", "ignore") if removed[-1] else old)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["rest", "text", "removed"])

    made = inner.mapInArrow(run, inner.select(F.col("doc_id").alias("rest"), "text", F.lit(0).cast("long").alias("removed")).schema)
    columns = {c: F.col("rest")[c] for c in kept} | {text_col: F.col("text"), removed_col: F.col("removed")}
    return made.select(*(columns[c].alias(c) for c in [*df.drop(removed_col).columns, removed_col]))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: bytes, bytes and maximal runs removed, and the digest of what is left."""
    cut = with_cuts(df, id_col, text_col, length)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for raw, cuts in zip(_raw(b, "text"), b.column("cuts").to_pylist()):
                starts, ends = runs_of(len(raw), cuts)
                rows.append((len(raw), int((ends - starts).sum()), len(starts), hashlib.sha256(b"".join(without(raw, starts, ends))).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut.mapInArrow(run, f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
