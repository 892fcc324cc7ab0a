"""Reuse policies and the metrics of sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.prefix import sequential_reuse, session_reuse


@dataclass(frozen=True)
class ReusePolicy:
    kind: str = "always"
    min_len: int = 1

    @staticmethod
    def always() -> ReusePolicy:
        return ReusePolicy("always")

    @staticmethod
    def never() -> ReusePolicy:
        return ReusePolicy("never")

    @staticmethod
    def threshold(min_len: int) -> ReusePolicy:
        return ReusePolicy("threshold", min_len)

    def should_attempt(self, hit_len: Column) -> Column:
        if self.kind == "threshold":
            return hit_len >= self.min_len
        return F.lit(self.kind == "always")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is 0 or there is none."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def reuse(prompts: DataFrame, policy: ReusePolicy | None = None, max_entries: int | None = None) -> DataFrame:
    """Steps with hit_len, cache_hit, tokens_saved, tokens_sent: by a window where that is exact, else step by step."""
    policy = policy or ReusePolicy.always()
    if policy.kind == "always" and max_entries is None:
        return session_reuse(prompts)
    out = sequential_reuse(prompts, policy.kind, policy.min_len, max_entries or 8192)
    return out.withColumn("cache_hit", F.col("hit_len") > 0)


def metrics(steps: DataFrame, by: list[str]) -> DataFrame:
    """Totals of steps: lookups, hits, tokens saved and processed, hit_rate, token_reduction."""
    saved, processed = F.sum("tokens_saved"), F.sum(F.col("total_tokens") - F.col("tokens_saved"))
    return steps.groupBy(*by).agg(
        F.count("*").alias("lookups"), F.sum(F.col("cache_hit").cast("long")).alias("hits"), saved.cast("long").alias("tokens_saved"), processed.cast("long").alias("tokens_processed"),
        ratio(F.sum(F.col("cache_hit").cast("long")), F.count("*")).alias("hit_rate"), ratio(saved, saved + processed).alias("token_reduction"),
    )
