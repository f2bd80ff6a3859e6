"""Packing by best-fit decreasing: a segment tree over remaining capacities finds the tightest open window."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespan.llm.bpe import Pieces, as_bytes, byte_table
from treespan.llm.common import materialize

WINDOW = 4096
END = 2
#: Pieces shorter than a window that are packed together; the number of such shards follows the number of pieces. Each
#: leaves about one window half empty, beside what no piece fits.
SHARD = 4096
#: Words, and parts of them, that a worker remembers: fewer than where nothing else runs beside it, as stages follow this.
REMEMBERED = 300_000

_UNSURE = re.compile("[\x1c-\x1f]")
#: Letters that have one form in lower case and are their own normal form, then ASCII signs other than the apostrophe.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
_WHITE = re.compile(r"[ \t\n\r\v\f]+")


class Tokens:
    """Ids of a tokenizers vocabulary whose matches never cross white space: words are encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model, self.byte = self.library.model, byte_table()
        self.parts = Pieces(self._part, REMEMBERED)
        self.words = Pieces(self._word, REMEMBERED)

    def _part(self, part: str) -> bytes:
        """One match of the vocabulary's pattern, given in lower case."""
        shown = part if part.isascii() else "".join(map(self.byte.__getitem__, part.encode()))
        return as_bytes([t.id for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        """Letters and what follows them are two matches; the library itself cuts up all other words."""
        if m := _PLAIN.fullmatch(word):
            letters, rest = m.groups()
            ids = self.parts[letters.lower()]
            return ids + self.parts[rest] if rest else ids
        return as_bytes(self.library.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids. What only str.split() takes for white space isn't cut at."""
        if not text:
            return b""
        words = _WHITE.split(text) if _UNSURE.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(2)
def loaded(path: str) -> Tokens:
    return Tokens(path)


class Capacities:
    """Windows by remaining capacity: leaf c of a segment tree tells whether a window with c tokens left is open."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, left: int, window: int) -> None:
        self.windows[left].append(window)
        i = left + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least `need` that a window has."""
        i = need + self.leaves
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, left: int) -> int:
        window = self.windows[left].pop()
        i = left + self.leaves
        if not self.windows[left]:
            self.any[i] = 0
            i >>= 1
            while i:
                self.any[i] = self.any[2 * i] | self.any[2 * i + 1]
                i >>= 1
        return window


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece, longest first; of equally long pieces the first given goes first."""
    at, offset = [0] * len(lengths), [0] * len(lengths)
    open_, n = Capacities(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        left = open_.tightest(need)
        if left is None:
            left, at[i], n = window, n, n + 1
        else:
            at[i] = open_.take(left)
        offset[i] = window - left
        if left > need:
            open_.add(left - need, at[i])
    return at, offset


def cut(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Each document's pieces: full windows from its start on, then what is left. Every id lies in exactly one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = loaded(path), np.array([END], "<u4").tobytes()
        for b in parts:
            doc, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = tokens.encode(text) + end
                n = len(ids) // 4
                for a in range(0, n, window):
                    doc.append(i)
                    start.append(a)
                    length.append(min(window, n - a))
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + window)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Where each piece of each document lies: sequence_id and offset there, gapless from 0.

    A document is its ids and an end id, so null and empty texts are one token. Full windows are sequences of their
    own. Shorter pieces are dealt to shards by their place in the table that holds them, not by a key: repeated ids
    and rows spread as any others, and an empty table has no sequences.
    """
    pieces = materialize(cut(df, path, id_col, text_col, window))
    full = pieces.where(F.col("length") == window).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < window)
    shards = max(1, -(-rest.count() // SHARD))
    dealt = rest.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at, offset = best_fit(rows["length"].tolist(), window)
        return rows.assign(sequence_id=rows["shard"].astype(np.int64) * (1 << 32) + np.array(at, np.int64), offset=np.array(offset, np.int64)).drop(columns="shard")

    # pandas has no nullable long by default: ids that may be null travel as text
    kind = pieces.schema["doc_id"].dataType.simpleString()
    told = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = told.groupBy("shard").applyInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).union(full)
