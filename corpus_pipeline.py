"""From raw documents to training sequences: five stages, each of which works on all that the one before it kept.

Stages return the columns of documents, but for the last, which returns the pieces of packed sequences. Where a stage
changes a text, n_chars is its new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import near_dup, packing, pii, quality_model, substring_dedup
from paperloom.llm.batches import cut, fold_of
from paperloom.llm.queries import table, vocabulary_path


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; labels of the held-out fold are not learnt from."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dup.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that also start earlier in the corpus go."""
    return _recounted(substring_dedup.cut_repeats(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _recounted(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their tokens."""
    return packing.pack(docs, vocabulary_path(), ids=True)


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The quality classifier, PII classifier and tokens can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
