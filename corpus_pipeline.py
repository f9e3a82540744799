"""A training-data pipeline over documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import bpe, lines, minhash, mixing, quality
from nearfield.storage import materialise

#: Language shares in proportion to this power of their tokens.
MIXING_POWER = 0.7

#: No SQL: a learned classifier, connected groups and a tokenizer.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the graded classifier accepts."""
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier; those of which nothing is left go."""
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.keep_one(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that expected tokens of the languages meet tempered shares; every one comes once at least."""
    names, labelled = mixing.languages_of(docs)
    return mixing.mix(docs, labelled, mixing.tempered(MIXING_POWER), names, least=1.0, ranks=bpe.tokenizer_path())


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes."""
    return bpe.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("mixing", mixing_weights),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
