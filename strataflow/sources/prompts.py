"""Prompt tables: generated sessions, and conversations read as sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _prompts(rows: DataFrame, session: Column, step: Column, model: Column, prompt: Column, temperature: float = 0.0, max_tokens: int = 128) -> DataFrame:
    return rows.select(session.alias("session_id"), step.cast("long").alias("step"), model.alias("model_id"), F.lit("generate").alias("op_name"), F.lit(temperature).cast("float").alias("temperature"), F.lit(max_tokens).alias("max_tokens"), prompt.alias("prompt"))


def session_prompts(spark: SparkSession, steps: int = 20, prefix: int = 30) -> DataFrame:
    """The session benchmark: a shared prefix and a suffix that tells the step."""
    n = F.col("id")
    text = F.concat(F.repeat(F.lit("P"), prefix), F.lit(" step"), (n + 1).cast("string"), F.lit(": query variant "), n.cast("string"))
    return _prompts(spark.range(steps), F.lit("bench"), n, F.lit("fake/m1"), text)


def restart_prompts(spark: SparkSession, steps: int = 5, session: str = "warm") -> DataFrame:
    text = F.concat(F.repeat(F.lit("P"), 30), F.lit(" step"), (F.col("id") + 1).cast("string"))
    return _prompts(spark.range(steps), F.lit(session), F.col("id"), F.lit("fake/m1"), text)


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as sessions: each turn is a step, the role is the model."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return _prompts(rows, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
