"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, licenses, neighbours, packing, pii, quality, secrets, sharding, simhash, substrings, tokenids, whitening
from corvane.llm.common import documents


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.read_ids(tokenids.write_ids(documents(spark, sf_dir)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(documents(spark, sf_dir)))


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(documents(spark, sf_dir)))


def op5_secrets_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.strip_repeats(documents(spark, sf_dir)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.mark(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = sharding.topology(8)
    return sharding.shard_documents(documents(spark, sf_dir), leaves, sharding.grow(leaves))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(documents(spark, sf_dir))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.cluster(documents(spark, sf_dir)))


def op11_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search_embeddings(spark, sf_dir)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_pii_crf": op4_pii_crf,
    "op5_secrets_cnn": op5_secrets_cnn,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_sharding": op8_sharding,
    "op9_licenses": op9_licenses,
    "op10_simhash_bktree": op10_simhash_bktree,
    "op11_multiprobe": op11_multiprobe,
    "op12_whitening": op12_whitening,
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE,
    "op6_substring_dedup": substrings.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_sharding": sharding.oracle_sql(),
}
