"""The reference benchmarks as queries: session reuse, restart from saved metadata, paired calls, simulated latency."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import tensor
from strataflow.functions.generators import run
from strataflow.functions.text import percentile
from strataflow.operators.backends import arrow_tensor
from strataflow.operators.prefix import cache_after, load_metadata, save_metadata, sequential_reuse
from strataflow.operators.session import ReusePolicy, metrics, ratio, reuse
from strataflow.sources.checkpoints import shared_folder
from strataflow.sources.prompts import restart_prompts, session_prompts

# What each step of the simulated agent asks for.
SUFFIXES = [" step1: establish context", " step2: inspect cache state", " step3: plan tool usage", " step4: synthesize answer", " step5: finalize output"]


def deterministic(spark: SparkSession, cost_ms: float = 2.0, prefix: int = 3000, max_tokens: int = 128) -> DataFrame:
    """One row a step: compute steps and simulated latency without and with the first prompt's prefix kept."""
    if cost_ms <= 0:
        raise ValueError("cost_ms must be above 0")
    rows = spark.createDataFrame([(k + 1, s) for k, s in enumerate(SUFFIXES)], "step int, suffix string")
    rows = rows.withColumn("prompt", F.concat(F.repeat(F.lit("P"), prefix), "suffix")).withColumn("kept", F.col("step") > 1)
    whole = run("fake", F.col("prompt"), max_tokens)
    part = run("fake", F.col("prompt"), max_tokens, F.when(F.col("kept"), F.octet_length("suffix")).otherwise(F.octet_length("prompt")), F.col("kept"))
    rows = rows.select("step", whole["compute_steps"].alias("steps_no_cache"), part["compute_steps"].alias("steps_with_cache"), part["tokens_saved"].alias("tokens_saved"), part["used_cached_state"].alias("cache_hit"))
    return rows.withColumn("ms_no_cache", F.col("steps_no_cache") * cost_ms).withColumn("ms_with_cache", F.col("steps_with_cache") * cost_ms)


def deterministic_totals(spark: SparkSession, cost_ms: float = 2.0) -> DataFrame:
    steps = deterministic(spark, cost_ms)
    out = steps.agg(F.sum("ms_no_cache").alias("ms_no_cache"), F.sum("ms_with_cache").alias("ms_with_cache"), ratio(F.sum(F.col("cache_hit").cast("int")), F.count("*")).alias("hit_rate"))
    out = out.withColumn("latency_reduction", ratio(F.col("ms_no_cache") - F.col("ms_with_cache"), F.col("ms_no_cache")))
    return out.withColumn("meets_hit_target", F.col("hit_rate") >= 0.8).withColumn("meets_latency_target", F.col("latency_reduction") >= 0.2)


def session(spark: SparkSession, steps: int = 20, prefix: int = 30, policy: ReusePolicy | None = None) -> DataFrame:
    if steps < 1 or prefix < 0:
        raise ValueError("a session has steps")
    return metrics(reuse(session_prompts(spark, steps, prefix), policy, 8192), ["session_id"])


def cold_start(spark: SparkSession, steps: int = 5) -> DataFrame:
    """(phase, hits, steps, hit_rate, cache_size): a session, and one that begins with the entries it saved."""
    first, path = restart_prompts(spark, steps), f"{shared_folder(spark)}/store-{uuid.uuid4()}"
    save_metadata(cache_after(first), path)
    warm, cold = sequential_reuse(first), sequential_reuse(first, warm=load_metadata(spark, path))
    both = warm.withColumn("phase", F.lit("warm")).union(cold.withColumn("phase", F.lit("cold")))
    hits = F.sum((F.col("predicted_hit_len") > 0).cast("long"))
    return both.groupBy("phase").agg(hits.alias("hits"), F.count("*").alias("steps"), ratio(hits, F.count("*")).alias("hit_rate"), F.max_by("cache_size", "step").alias("cache_size"))


def tensor_parity(spark: SparkSession) -> DataFrame:
    """(op, max_abs_diff) between the two tensor backends, on the published vectors."""
    a, b = tensor.const([1.0, 2.0, -3.0, 0.5]), tensor.const([0.25, -1.0, 4.0, 2.0])
    rows = spark.createDataFrame([("add",), ("relu",), ("softmax",), ("mul",), ("matmul",)], "op string")
    one = lambda op: tensor.max_abs_diff(tensor.apply(op, a, b), arrow_tensor(op, a, b))
    diff = F.lit(None).cast("float")
    for op in ("add", "relu", "softmax", "mul", "matmul"):
        diff = F.when(F.col("op") == op, one(op)).otherwise(diff)
    return rows.select("op", diff.cast("double").alias("max_abs_diff"))


def paired(spark: SparkSession, trials: int = 10, discard_first: bool = True, shared: int = 3000, cost_ms: float = 2.0) -> DataFrame:
    """One row: medians of simulated latency and the token reduction of a call whose prompt is all reusable.

    Latency is compute steps at a cost each, plus one step for the call, as no network is asked.
    """
    if trials < 2:
        raise ValueError("a warm-up can only be discarded from two trials on")
    prompt = F.concat(F.repeat(F.lit("S"), shared), F.lit("\nQuestion: Summarize cache behavior."))
    whole, part = run("vllm", prompt, 128), run("vllm", prompt, 128, F.lit(0), F.lit(True))
    rows = spark.range(trials).where("id > 0" if discard_first else "id >= 0")
    rows = rows.select(((whole["compute_steps"] + 1) * cost_ms).alias("no_cache"), ((part["compute_steps"] + 1) * cost_ms).alias("with_cache"), ratio(part["tokens_saved"], F.greatest(part["tokens_sent"] + part["tokens_saved"], F.lit(1))).alias("saved"))
    out = rows.agg(percentile(F.col("no_cache"), 50).alias("p50_no_cache"), percentile(F.col("with_cache"), 50).alias("p50_with_cache"), percentile(F.col("no_cache"), 95).alias("p95_no_cache"), percentile(F.col("with_cache"), 95).alias("p95_with_cache"), F.avg("saved").alias("token_reduction"))
    return out.withColumn("latency_ratio", ratio(F.col("p50_with_cache"), F.col("p50_no_cache")))
