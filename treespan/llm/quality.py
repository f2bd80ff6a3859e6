"""Quality by compression: dictionaries of good and of bad texts, and a calibrated difference of the two sizes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespan.llm.common import materialize

#: Fitting takes at most so many rows of either label, those of the smallest hash of their id, and of a longer text a
#: stretch of FIT_CHARS characters from a place that its id's hash chooses.
FIT_ROWS = 2000
FIT_CHARS = 10_000
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
#: Texts are compressed in blocks of nearly equal size, at most so many bytes: else a long text becomes its own dictionary.
BLOCK_BYTES = 4096
#: A text is accepted at this score.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """By text: 1, the normalised size difference, and how far the text shrinks by the better dictionary."""
        import zstandard as z

        held = [z.ZstdCompressionDict(d) for d in (self.good, self.bad)]
        for d in held:
            d.precompute_compress(level=LEVEL)
        by = [z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in held]
        rows = np.zeros((len(texts), 4))
        rows[:, 0] = 1
        for i, text in enumerate(texts):
            if text:
                raw = text.encode()
                step = -(-len(raw) // -(-len(raw) // BLOCK_BYTES))
                blocks = [raw[a : a + step] for a in range(0, len(raw), step)]
                good, bad = (sum(len(c.compress(b)) for b in blocks) for c in by)
                rows[i, 1] = (bad - good) / (bad + good)
                rows[i, 2] = min(good, bad) / len(raw)
                rows[i, 3] = abs(bad - good) / len(raw)
        return rows

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -30, 30)))


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained by zstandard; from too few samples for that, the samples themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on a bounded sample: at most FIT_ROWS ids of either label (1 good, 0 bad), FIT_CHARS characters of each.

    Ids are chosen among the labels alone, those of smallest hash; then their texts are fetched in one scan. Every second text
    makes the dictionaries, the others the calibration. Rows with nulls are left out. With rows of one label or
    none, every text has the score of that label's share (1/2 if there are none).
    """
    marked = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    marked = marked.withColumn("h", F.xxhash64(F.col("k").cast("string")))
    # both samples together are at most 2 * FIT_ROWS ids
    chosen = marked.where("y = 1").orderBy("h", "k").limit(FIT_ROWS).union(marked.where("y = 0").orderBy("h", "k").limit(FIT_ROWS))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where(F.length("t") > 0).join(F.broadcast(chosen), "k")
    start = 1 + F.pmod("h", F.greatest(F.length("t") - FIT_CHARS, F.lit(0)) + 1)
    rows = materialize(texts.select("k", "y", "h", F.substring("t", start, F.lit(FIT_CHARS)).alias("t")))
    sample = {y: [r.t for r in rows.where(F.col("y") == y).orderBy("h", "k", "t").limit(FIT_ROWS).collect()] for y in (1, 0)}
    if not (len(sample[1]) > 1 and len(sample[0]) > 1):
        n = len(sample[1]) + len(sample[0])
        share = (len(sample[1]) + 1) / (n + 2)
        return Model(b"good", b"bad", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    good, bad = (_dictionary([t.encode() for t in sample[y][::2]]) for y in (1, 0))
    model = Model(good, bad, ())
    x = np.concatenate([model.features(sample[y][1::2]) for y in (1, 0)])
    y = np.concatenate([np.ones(len(sample[1]) // 2), np.zeros(len(sample[0]) // 2)])
    return Model(good, bad, tuple(calibrate(x, y).tolist()))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score of each whole text, 0 to 1; null and empty texts have the score of a text that shows nothing.

    Rows are independent, so ties, repeated rows and empty tables need no care; a column of that name is replaced.
    """
    kept = [c for c in df.columns if c != score_col]
    at = kept.index(text_col)
    held = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.scores(b.column(at).to_pylist()), pa.float64())], names=[*kept, score_col])

    return df.select(kept).mapInArrow(run, df.select(kept).withColumn(score_col, F.lit(0.0)).schema)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learnt from: those whose id's crc32 isn't a multiple of 5."""
    return labels.where(~held_out(F.col(id_col)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
