"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, mixing.

Each stage takes and returns documents (doc_id, text, lang, source, n_chars); the last
returns how often the mix takes each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import decontaminate, language, mixing, secrets, simhash
from panelspark.llm.common import checkpoint

#: Least probability of the predicted language.
SURE = 0.5
#: The stages are learned and random, so SQL cannot give their rows; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those of no language with probability SURE; fill in missing languages."""
    found = language.identify(docs, language.learned_from(docs), docs.columns, ("__lang", "__score"))
    found = found.where((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= SURE))
    return found.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by fingerprints within 3 bits (pigeonring search) or by 5-word shingle similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and words that the mix takes of every document."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs
