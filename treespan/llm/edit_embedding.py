"""Document fingerprints by randomised edit embedding.

A walk reads a text: at each step it writes the character under it and moves on or stays, as a coin shared by all
texts says for that step and character. Texts of small edit distance give outputs of small Hamming distance, as
walks meet again soon after an edit. A fingerprint has bits of the output at shared random steps: 64 among the
first 64 steps and 64 in each doubling after that, so every part of a text of any length counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Steps after which coins repeat; characters fall into 64 classes, the 65th is what follows a text's end.
PERIOD = 1 << 13
_CLASSES = 64
#: Characters that are walked side by side, and walks below which each goes alone.
TOGETHER = 4_000_000
ALONE = 24


@lru_cache(1)
def _coins() -> tuple[np.ndarray, list[bytes]]:
    coins = np.random.default_rng(20).integers(0, 2, (PERIOD, _CLASSES + 1), np.uint8)
    coins[:, _CLASSES] = 0  # at the end walks stay
    return coins, [row.tobytes() for row in coins]


@lru_cache(64)
def _sample(group: int) -> tuple[list[int], np.ndarray]:
    """The sampled steps of a group, ascending, and for each the bit that stands for each class."""
    rng = np.random.default_rng([21, group])
    low = 0 if group == 0 else BITS << (group - 1)
    steps = low + np.sort(rng.choice(max(low, BITS), BITS, replace=False))
    return steps.tolist(), rng.integers(0, 2, (BITS, _CLASSES + 1), np.uint8)


def steps_of(n: int) -> int:
    """Steps that a text of n characters is walked for: two a character, and room for chance."""
    return 2 * n + 8 * isqrt(n) + 16 if n else 0


def groups_of(steps: int) -> int:
    return 0 if steps == 0 else 1 + max(0, (-(-steps // BITS) - 1).bit_length())


def _classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.empty(len(code) + 1, np.uint8)
    out[:-1] = (code * np.uint32(0x9E3779B1)) >> np.uint32(26)
    out[-1] = _CLASSES
    return out


def embed(texts: Sequence[str]) -> list[np.ndarray]:
    """The groups of fingerprint bits of each text, as unsigned 64-bit numbers."""
    coins, alone = _coins()
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    walks = [_classes(texts[i]) for i in order]
    steps = np.array([steps_of(len(w) - 1) for w in walks], np.int64)
    if not len(steps) or not steps[0]:
        return [np.zeros(0, np.uint64) for _ in texts]
    most = groups_of(int(steps[0]))
    bits = np.zeros((most, len(walks)), np.uint64)
    flat = np.concatenate(walks)
    begin = np.concatenate([[0], np.cumsum([len(w) for w in walks])[:-1]]).astype(np.int64)
    pos = begin.copy()
    ends = -steps  # ascending
    wide = coins.astype(np.int64)
    j = 0
    for g in range(most):
        at, says = _sample(g)
        top = min(BITS << g, int(steps[0]))
        k = 0
        while j < top:
            live = int(np.searchsorted(ends, -j, "left"))  # walks of more than j steps
            if live < ALONE:
                break
            until = min(top, -int(ends[live - 1]))  # the shortest of them ends there
            here = pos[:live]
            while j < until:
                under = flat.take(here)
                if k < BITS and at[k] == j:
                    bits[g, :live] |= says[k].take(under).astype(np.uint64) << np.uint64(k)
                    k += 1
                here += wide[j & (PERIOD - 1)].take(under)
                j += 1
        if j < top:
            break
    for i in range(int(np.searchsorted(ends, -j, "left"))):
        _alone(walks[i].tobytes(), int(pos[i] - begin[i]), j, int(steps[i]), bits[:, i], alone)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for i, k in enumerate(order):
        out[k] = bits[: groups_of(int(steps[i])), i]
    return out


def _alone(text: bytes, pos: int, j: int, steps: int, bits: np.ndarray, coins: list[bytes]) -> None:
    """Goes on with one walk from step j at pos."""
    turn = PERIOD - 1
    for g in range(groups_of(j + 1) - 1, groups_of(steps)):
        at, says = _sample(g)
        found = int(bits[g])
        for k, stop in [*enumerate(at), (None, min(BITS << g, steps))]:
            if stop < j:
                continue
            stop = min(stop, steps)
            while j < stop:
                pos += coins[j & turn][text[pos]]
                j += 1
            if k is None or at[k] >= steps:
                continue
            found |= int(says[k][text[pos]]) << k
        bits[g] = found


def fingerprint(n_chars: int, groups: np.ndarray) -> str:
    """The text's length in hexadecimal, a dot, and 16 hexadecimal digits for each group."""
    return f"{n_chars:x}." + "".join(f"{int(g):016x}" for g in groups)


def fingerprints(texts: Sequence[str]) -> list[str]:
    return [fingerprint(len(t), g) for t, g in zip(texts, embed(texts))]


class Parsed(NamedTuple):
    """What a fingerprint says: the text's characters, the steps it was walked for, and its groups of bits."""

    n_chars: int
    steps: int
    words: list[int]


def parsed(fp: str) -> Parsed:
    n, _, rest = fp.partition(".")
    return Parsed(int(n, 16), steps_of(int(n, 16)), [int(rest[i : i + 16], 16) for i in range(0, len(rest), 16)])


@lru_cache(1 << 12)
def _valid(group: int, steps: int) -> int:
    """The bits of a group whose steps come before so many."""
    return sum(1 << k for k, s in enumerate(_sample(group)[0]) if s < steps)


def likeness(a: str, b: str) -> float:
    """From 0 to 1: how far bits agree beyond chance, each group weighing as many steps as the longer walk has there."""
    return 1.0 if a == b else _alike(parsed(a), parsed(b))


def _alike(a: Parsed, b: Parsed) -> float:
    if a == b:
        return 1.0
    total = same = 0.0
    most = max(a.steps, b.steps)
    both = min(len(a.words), len(b.words))
    for g in range(groups_of(most)):
        low = 0 if g == 0 else BITS << (g - 1)
        end = min(most, BITS << g)
        valid = _valid(g, end)
        total += end - low
        if valid and g < both:
            same += (end - low) * (1 - 2 * ((a.words[g] ^ b.words[g]) & valid).bit_count() / valid.bit_count())
    return min(1.0, max(0.0, same / total)) if total else 1.0


def with_fingerprint(df: DataFrame, text_col: str = "text", fingerprint_col: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text; null counts as empty. A column of that name is replaced."""
    kept = [c for c in df.columns if c != fingerprint_col]
    at = kept.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = [t or "" for t in b.column(at).to_pylist()]
            out: list[str] = []
            for part in _parts(texts):
                out += fingerprints(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*kept, fingerprint_col])

    return df.select(kept).mapInArrow(run, df.select(kept).withColumn(fingerprint_col, F.lit("")).schema)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


#: Bits in a band, bands from each group, and groups of the candidate search; and the edits that `digest` verifies.
BAND_BITS = 16
BANDS = 24
BANDED = 3
MOST_EDITS = 8


@lru_cache(64)
def _bands(group: int) -> tuple[int, ...]:
    """Masks of a group's bands."""
    rng = np.random.default_rng([22, group])
    return tuple(sum(1 << int(k) for k in rng.choice(BITS, BAND_BITS, replace=False)) for _ in range(BANDS))


def _banded(n_chars: int) -> range:
    """The groups that texts of so many characters are banded by: the last ones whose steps end before such texts do."""
    last = max(0, (2 * n_chars // BITS).bit_length() - 1)
    return range(max(0, last - BANDED + 1), last + 1)


def candidates(a: str, b: str) -> bool:
    """Whether two fingerprints share a band."""
    return a == b or _share(parsed(a), parsed(b))


def _share(a: Parsed, b: Parsed) -> bool:
    if a == b:
        return True
    x, y = _banded(a.n_chars), _banded(b.n_chars)
    for g in range(max(x.start, y.start), min(x.stop, y.stop, len(a.words), len(b.words))):
        off = a.words[g] ^ b.words[g]
        # no band of BAND_BITS bits agrees if fewer do
        if off.bit_count() <= BITS - BAND_BITS and any(not off & mask for mask in _bands(g)):
            return True
    return False


def verified(a: str, b: str, fp_a: Parsed | str, fp_b: Parsed | str, most: int = MOST_EDITS) -> int | None:
    """The edit distance of two texts whose fingerprints share a band, if it is at most `most`."""
    of = lambda fp: parsed(fp) if isinstance(fp, str) else fp
    return distance_within(a, b, most) if abs(len(a) - len(b)) <= most and _share(of(fp_a), of(fp_b)) else None


def distance_within(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most `most`, else None; work is in proportion to most x length at worst."""
    if abs(len(a) - len(b)) > most:
        return None
    reach = {0: _slide(a, b, 0, 0)}
    goal = len(b) - len(a)
    if reach.get(goal, -1) >= len(a):
        return 0
    for d in range(1, most + 1):
        new = {}
        for k in range(-d, d + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if i < 0 or i + k < 0:
                continue
            i = min(i, len(a), len(b) - k)
            if i >= 0:
                new[k] = _slide(a, b, i, k)
        reach = new
        if reach.get(goal, -1) >= len(a):
            return d
    return None


def _slide(a: str, b: str, i: int, k: int) -> int:
    """How far equal characters go from a[i], b[i + k]; long runs are compared in growing blocks."""
    step = 16
    while i < len(a) and i + k < len(b):
        if a[i : i + step] == b[i + k : i + k + step] and min(len(a) - i, len(b) - i - k) >= step:
            i += step
            step *= 2
        elif step > 1:
            step = max(1, step // 4)
            if step == 1 and a[i] != b[i + k]:
                return i
        else:
            if a[i] != b[i + k]:
                return i
            i += 1
    return i


def near_pairs(df: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified pairs of texts of edit distance at most `most`: candidates share a band of bits of their last group.

    Equal texts are one class, named by its smallest id; null and empty texts are a class of their own. All classes
    of a band whose lengths differ by at most `most` are compared: bands are split by length, into buckets that each
    class is in two of, so no pair within the distance is parted. The result is (a, b, distance), a < b, and each
    row is verified on the whole texts. Recall follows from BANDS and BAND_BITS and from the share of characters that
    are edited, not from the number of texts: at 1 in 100 about 0.97, at 1 in 20 about 0.8. Null ids name no class of
    several texts before others do; extra columns are left out; an empty table has no pairs.
    """
    classes = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("id").alias("id"), F.first("text").alias("text"))
    marked = with_fingerprint(classes.select("id", "text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, lengths, bands = [], [], []
            for i, fp in enumerate(b.column(1).to_pylist()):
                n, _, words = parsed(fp)
                # texts next to a doubling of length share all of these groups but one
                for g in _banded(n):
                    for k, mask in enumerate(_bands(g)):
                        own = words[g] & mask if g < len(words) else 0
                        for bucket in (n // (most + 1), n // (most + 1) + 1):
                            ids.append(i)
                            lengths.append(n)
                            bands.append(hashlib.md5(f"{g}.{k}.{own}.{bucket}".encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int64()), pa.array(bands, pa.string())], names=["id", "n", "band"])

    kind = marked.schema["id"].dataType.simpleString()
    bands = marked.select("id", "fingerprint").mapInArrow(run, f"id {kind}, n long, band string")
    side = lambda i, n: bands.select("band", F.col("id").alias(i), F.col("n").alias(n))
    pairs = side("a", "m").join(side("b", "n"), "band").where((F.col("a") < F.col("b")) & (F.abs(F.col("m") - F.col("n")) <= most)).select("a", "b").distinct()
    texts = classes.select("id", "text")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            d = [distance_within(x, y, most) for x, y in zip(p.column(2).to_pylist(), p.column(3).to_pylist())]
            keep = pa.array([v is not None for v in d])
            yield pa.RecordBatch.from_arrays([p.column(0).filter(keep), p.column(1).filter(keep), pa.array([v for v in d if v is not None], pa.int64())], names=["a", "b", "distance"])

    return both.select("a", "b", "x", "y").mapInArrow(verify, f"a {kind}, b {kind}, distance long")


#: Rows of a bucket of neighbouring ids, and the most buckets: their first ids are broadcast.
BUCKET_ROWS = 2000
MOST_BUCKETS = 20_000


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into buckets of neighbouring ids, each bucket in order and closed by a copy of the next one's first.

    Columns: bucket, copy (1 for what closes a bucket), doc_id, text. Nulls come first, equal ids by the hash of
    their texts; the last bucket is closed by the first row of all. Ids are integers.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    n = min(MOST_BUCKETS, ids.count() // BUCKET_ROWS)
    bounds = sorted(set(ids.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    dealt = docs.withColumn("bucket", F.lit(0))
    if bounds:
        at = docs.withColumn("__at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))
        cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="__at", outputCol="__bucket")
        dealt = cut.transform(at).select("doc_id", "text", F.col("__bucket").cast("int").alias("bucket"))
    mark = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")
    firsts = sorted((r.bucket, r.first.doc_id) for r in dealt.groupBy("bucket").agg(F.min(mark).alias("first")).collect())
    closes = [(b, firsts[i - 1][0], d) for i, (b, d) in enumerate(firsts)]
    spark = df.sparkSession
    marks = spark.createDataFrame(closes, f"of int, closes int, id {docs.schema['doc_id'].dataType.simpleString()}")
    # one scan makes both: a row that closes a bucket stays in its own, too
    twice = dealt.join(F.broadcast(marks), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left") if closes else None
    if twice is None:
        return dealt.select("bucket", F.lit(0).alias("copy"), "doc_id", "text")
    places = F.when(F.col("closes").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy")), F.struct(F.col("closes").alias("bucket"), F.lit(1).alias("copy")))
    )
    return twice.select(F.explode(places).alias("p"), "doc_id", "text").select("p.bucket", "p.copy", "doc_id", "text")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to the edited text's and the next document's.

    The edited text has the text's last floor(n / 2) characters replaced by as many first ones of the next document.
    Where fingerprints share a band, edits_edited and edits_next are the verified edit distances to both, if at most
    MOST_EDITS; else null. Null texts count as empty; repeated ids are ordered by their texts' hashes; of one row, the
    next document is itself; an empty table has no rows.
    """
    rows = with_next(df, id_col, text_col).repartition("bucket").sortWithinPartitions("bucket", "copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def settle(held: list[tuple]) -> tuple[list, ...]:
        """All but the last of the held rows, for which the last is the next."""
        texts = [r[3] for r in held]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
        fps = fingerprints([*texts, *edited])
        own, other = fps[: len(texts)], fps[len(texts) :]
        said = [parsed(fp) for fp in fps]
        mine, cut = said[: len(texts)], said[len(texts) :]
        keep = [i for i in range(len(held) - 1) if not held[i][1]]
        return (
            [held[i][2] for i in keep], [len(texts[i]) for i in keep], [hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], [own[i] for i in keep], [other[i] for i in keep],
            [_alike(mine[i], cut[i]) for i in keep], [_alike(mine[i], mine[i + 1]) for i in keep],
            [verified(texts[i], edited[i], mine[i], cut[i]) for i in keep], [verified(texts[i], texts[i + 1], mine[i], mine[i + 1]) for i in keep],
        )

    kind = df.select(id_col).schema[0].dataType
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits_edited", "edits_next"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            cols = settle(held)
            kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        id_type = None
        for b in parts:
            id_type = b.schema.field(2).type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                size += len(row[3])
                if size >= TOGETHER and len(held) > 1:
                    yield made()
                    held, size = [row], len(row[3])
        if len(held) > 1:
            yield made()

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits_edited long, edits_next long")
