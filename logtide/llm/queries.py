"""Registered queries of the training-data operators, one per operator, each
with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import (bpe_codec, decontamination, html_extraction, language_id, lm_scoring, merkle_manifest, oracle, packing,
               phrase_mining, quality_rules, secret_scans, sharding, simhash, url_filters)
from .common import ascii_lower, table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]
SHARDS = 8
MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.rule_table(spark, URL_RULES)
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.find_secrets(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document (by the checksum of its id) is held against the
    manifest with its text lower-cased, the others as they are."""
    docs = table(spark, sf_dir, "documents")
    changed = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in MANIFEST]
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle_manifest.leaf_digest(changed))
    return merkle_manifest.prove(docs, MANIFEST, "lang", "doc_id", claimed)


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filters, op2_language_id, op3_html_extraction, op4_secret_scans, op5_simhash_near_dedup,
           op6_decontamination, op7_lm_scoring, op8_quality_rules, op9_sharding, op10_packing, op11_phrase_mining,
           op12_merkle_manifest, op13_bpe_codec)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": oracle.OP1, "op7_lm_scoring": oracle.OP7, "op8_quality_rules": oracle.OP8,
            "op11_phrase_mining": oracle.OP11, "op12_merkle_manifest": oracle.OP12}
