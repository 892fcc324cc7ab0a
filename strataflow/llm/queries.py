"""The registered queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import decontaminate, hamming, line_dedup, packing, quality, secrets, sharding, simhash, substring_dedup, toxicity
from strataflow.llm.common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": lambda spark, d: simhash.op1(documents(spark, d)),
    "op2_quality": lambda spark, d: quality.quality_scores(documents(spark, d), _table(spark, d, "labels")),
    "op3_hamming_top_k": lambda spark, d: hamming.hamming_top_k(_table(spark, d, "embeddings")),
    "op4_packing": lambda spark, d: packing.op4(documents(spark, d)),
    "op5_substring_dedup": lambda spark, d: substring_dedup.op5(documents(spark, d)),
    "op6_sharding": lambda spark, d: sharding.op6(documents(spark, d)),
    "op7_secrets": lambda spark, d: secrets.secrets(documents(spark, d)),
    "op8_line_dedup": lambda spark, d: line_dedup.op8(documents(spark, d)),
    "op9_toxicity": lambda spark, d: toxicity.toxicity(documents(spark, d), _table(spark, d, "labels")),
    "op10_decontamination": lambda spark, d: decontaminate.contaminated(documents(spark, d), _table(spark, d, "benchmark")),
}

ORACLE_SQL: dict[str, str] = {
    "op3_hamming_top_k": hamming.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
}
