"""A corpus from raw documents: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.llm import packing, pii, quality, simhash, suffix_dedup
from treespan.llm.common import discard, materialize, table


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text is now (null for a null text)."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*like.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality classifier rejects go."""
    model = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, score_col="__score").where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of a similarity of 0.8 or more on five-word shingles stays."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: bytes under 200-byte strings that start elsewhere, too, go."""
    return _as_documents(suffix_dedup.dedup(docs, removed_col="__removed"), docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal data is replaced by its kind."""
    found = pii.detect(docs, spans_col="__spans", redacted_col="__redacted")
    return _as_documents(found.withColumn("text", F.col("__redacted")), docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: where each piece of each document lies in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("PII", hide_personal_data),
    ("packing", pack_windows),
]

#: The classifier, the fingerprints and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        discard(*written)  # what the stage has read
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
