"""Training documents in five stages: quality, near-duplicates, decontamination, personal data, packing.

Every stage takes all rows that its predecessor kept and all but the last return the columns of
``documents``. Nulls, repeats and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import decontam, packing, pii, quality, simhash
from lexweave.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject; fitted on the labelled ones of ``docs``."""
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, field)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in five per cent of their words."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.keep_clean(docs, benchmark)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack(packing.cut(docs))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_redaction", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]
#: Fitted weights, fingerprints and token ids have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
