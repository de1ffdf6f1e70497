"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import encoding, licenses, lmscore, ordering, outliers, packing, pivots, ruleclassifier, secrets, simhash
from .common import table


def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), lmscore.good_ids(table(spark, sf_dir, "labels")))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.materialised(spark, table(spark, sf_dir, "documents"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleclassifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


def op6_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.digests(table(spark, sf_dir, "documents"))


def op8_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_cross_entropy, op2_training_order, op3_rule_ensemble, op4_blob_ledger, op5_robust_outliers, op6_simhash_blocks, op7_bpe_transducer, op8_pivot_permutations, op9_license_bands, op10_packing)}

QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = {"op4_blob_ledger": secrets.sql()}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
