"""The registered queries of this subpackage, one per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import embeddings, licenses, linededup, mixing, packing, quality, simhash, toxicity, urlfilter, warczip

QUERIES = {}
ORACLES = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


QUERIES["op3_simhash_covering"] = op3_simhash_covering


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


QUERIES["op8_line_dedup"] = op8_line_dedup
ORACLES["op8_line_dedup"] = linededup.ORACLE


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


QUERIES["op9_mixing"] = op9_mixing
ORACLES["op9_mixing"] = mixing.ORACLE


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op7_quality_rules"] = op7_quality_rules


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.round_trip(_table(spark, sf_dir, "pages"))


QUERIES["op10_warc_zip"] = op10_warc_zip
ORACLES["op10_warc_zip"] = warczip.ORACLE


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


QUERIES["op6_pattern_packing"] = op6_pattern_packing


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES["op1_pivot_permutation"] = op1_pivot_permutation
ORACLES["op1_pivot_permutation"] = embeddings.ORACLE


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op2_toxic_segments"] = op2_toxic_segments


def op4_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


QUERIES["op4_url_language_models"] = op4_url_language_models


def op5_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES["op5_license_classifier"] = op5_license_classifier
