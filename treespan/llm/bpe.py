"""Byte-level BPE by the tokenizers library over Arrow batches, with the byte table and its reverse."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 800_000


def byte_table() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def token_bytes(token: str, back: dict[str, int]) -> bytes:
    return bytes(back[ch] for ch in token)


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """Ids of pieces of text as bytes of little-endian unsigned 32-bit numbers, computed when first asked for."""

    def __init__(self, encode, most: int = REMEMBERED):
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


#: A space before what is no white space always begins a match of the pattern, so texts can be cut there.
_CUT = re.compile(r" (?=\S)")


class ByteBPE:
    """Encodes and decodes with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        back = {ch: b for b, ch in enumerate(byte_table())}
        known = {t.content for t in self.library.get_added_tokens_decoder().values()}
        size = self.library.get_vocab_size()
        self.bytes = [token_bytes(t, back) if (t := self.library.id_to_token(i)) not in known else t.encode() for i in range(size)]
        self.decimal = [b"%d" % i for i in range(size)]
        self.first = Pieces(lambda p: as_bytes(self.library.encode(p, add_special_tokens=False).ids))
        self.later = Pieces(lambda p: as_bytes(self.library.encode(" " + p, add_special_tokens=False).ids))

    def encode(self, text: str | None) -> np.ndarray:
        head, *tail = _CUT.split(text or "")
        return np.frombuffer(self.first[head] + b"".join(map(self.later.__getitem__, tail)), "<u4")

    def encode_offsets(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and each token's first byte and end in the UTF-8 text; a character split over tokens lies in several."""
        ids = self.encode(text)
        ends = np.cumsum([len(self.bytes[i]) for i in ids.tolist()], dtype=np.int64)
        return ids, np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1) if len(ids) else np.zeros((0, 2), np.int64)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes are joined before they become characters, so characters split over tokens come back whole."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of each text, an array of int; null and empty texts have none. Special tokens' strings are text."""
    return _mapped(df, text_col, ids_col, "array<int>", pa.list_(pa.int32()), lambda texts: [loaded(path).encode(t) for t in texts])


def encode_with_offsets(df: DataFrame, path: str, text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
    """Adds each text's tokens as structs of id, first byte and end byte in its UTF-8 form."""
    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(texts):
        return [[{"id": i, "start": a, "end": b} for i, (a, b) in zip(ids.tolist(), at.tolist())] for ids, at in map(loaded(path).encode_offsets, texts)]

    return _mapped(df, text_col, tokens_col, "array<struct<id:int,start:bigint,end:bigint>>", kind, run)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids; null stays null, an empty array gives an empty text."""
    return _mapped(df, ids_col, text_col, "string", pa.string(), lambda rows: [None if r is None else loaded(path).decode(r) for r in rows])


def _mapped(df: DataFrame, source: str, target: str, sql_type: str, arrow_type: pa.DataType, run) -> DataFrame:
    kept = [c for c in df.columns if c != target or c == source]
    at = kept.index(source)
    out = df.select(kept).withColumn("__new", F.lit(None).cast(sql_type)).schema

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run(b.column(at).to_pylist()), arrow_type)], names=[*kept, "__new"])

    done = df.select(kept).mapInArrow(batches, out)
    return (done.drop(target) if target in kept else done).withColumnRenamed("__new", target)


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in parts:
            counts, ids_sha, bytes_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text).tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(bpe.decimal.__getitem__, ids))).hexdigest())
                bytes_sha.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
