"""Corpus pipeline over ``documents``: keep what has a language, delete
repeated passages, keep one document of each near-duplicate group, drop
documents that hold benchmark passages, and encode the rest.

Every stage takes (spark, docs, sf_dir) and works on all that its
predecessor kept; ``run`` writes each result as Parquet below the shared
``spark.checkpoint.dir`` and hands the reread table on.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlex.llm.base import hash_bucket, small_batches, stored, table
from marketlex.llm.queries import LANG_FOLDS, LANG_HELD_OUT, PIECES, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told."""
    from marketlex.llm.string_kernel import drop_undetermined, fit_language_model
    train = docs.where(F.coalesce(hash_bucket(F.col("doc_id"), LANG_FOLDS) != LANG_HELD_OUT, F.lit(True)))
    return drop_undetermined(docs, fit_language_model(train))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs of 50 words or more."""
    from marketlex.llm.line_suffixes import drop_repeated
    return drop_repeated(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of similar documents."""
    from marketlex.llm.bayes_join import one_of_each
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of ``benchmark``."""
    from marketlex.llm.qgram_decontam import drop_contaminated
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, decode it again, and return ids and checks."""
    from marketlex.llm.piece_viterbi import encode_decode
    return encode_decode(docs, tokenizer_path(PIECES), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: Kernel regression, alignment and sub-word coding are beyond SQL; the
#: pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
