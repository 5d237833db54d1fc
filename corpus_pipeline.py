"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``documents``. ``run`` writes each stage's result as
Parquet into the shared checkpoint folder and hands the reread table on.

    quality rules       documents that a rule rejects go
    near duplicates     one document of each SimHash component stays
    decontamination     documents that hold a benchmark item go
    secret scans        secrets are masked; the documents stay
    packing             documents become pieces of 2048-token sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.llm import decontamination, packing, quality_rules, secret_scans, simhash
from logtide.llm.common import staged, table

#: Fingerprints, masking by model and token ids are beyond SQL; tests hold the
#: stages against plain Python instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scans.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("decontamination", decontaminate),
          ("secret_scans", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
