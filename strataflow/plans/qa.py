"""The question-answering program with its four parameters, and its evaluation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.text import capital_pairs, exact_match
from strataflow.plans.optimize import Optimizer, Param, scores
from strataflow.sources.qa import CAPITALS, batches, qa_rows, split_train_test


def question_country() -> Column:
    """The first listed country that the question names, else the row's own."""
    named = F.filter(F.array(*map(F.lit, CAPITALS)), lambda c: F.contains(F.lower("question"), F.lower(c)))
    return F.coalesce(F.get(named, F.lit(0)), F.col("target_country"))


def answer(values: dict[str, Any]) -> Column:
    """The capital that a row's context gives for the country that the parameters pick.

    The first country of the context, unless the instruction says question-first or the examples say match
    country; the direct style picks the asked country below temperature 0.5 and the last one from there on.
    """
    pairs = capital_pairs(F.col("context"))
    country = F.get(pairs, F.lit(0))["country"]
    if "question-first" in str(values["instruction"]).lower() or "match country" in str(values["fewshot"]):
        country = question_country()
    if str(values["reasoning_style"]).lower() == "direct":
        country = question_country() if float(values["temperature"]) < 0.5 else F.element_at(pairs, -1)["country"]
    fitting = F.get(F.filter(pairs, lambda p: p["country"] == country), F.lit(0))["capital"]
    return F.when(F.size(pairs) == 0, "unknown").otherwise(F.coalesce(fitting, F.get(pairs, F.lit(0))["capital"]))


def metric(predicted: Column) -> Column:
    return exact_match(predicted, F.col("answer"))


def parameters() -> dict[str, Param]:
    return {
        # The parameters of the published benchmark.
        "instruction": Param.text("Use context-first extraction.", tokens=["question-first", "context-first", "extract"], trials=4),
        "fewshot": Param.text("", tokens=["match country", "Q:", "A:"], trials=4),
        "reasoning_style": Param.discrete("chain", choices=["chain", "direct"]),
        "temperature": Param.continuous(0.8, min_value=0.0, max_value=1.0, trials=8),
    }


def evaluate(rows: DataFrame, values: dict[str, Any]) -> float:
    return scores(rows, answer, metric, [values])[0]


def benchmark(spark: SparkSession, seeds: tuple[int, ...] = (11, 17, 23, 31, 47), samples: int = 200, epochs: int = 5) -> dict[str, Any]:
    """Baseline and optimized accuracy on the held-out fifth, over seeds."""
    from statistics import mean, pstdev

    before, after = [], []
    for seed in seeds:
        train, test = split_train_test(qa_rows(spark, samples, seed), 0.8, seed)
        opt = Optimizer(answer, metric, parameters(), seed=seed)
        before.append(evaluate(test, opt.values()))
        held = list(batches(train, 20))
        opt.fit(lambda held=held: held, epochs)
        after.append(evaluate(test, opt.values()))
    return {"baseline_mean": mean(before), "baseline_pstdev": pstdev(before), "optimized_mean": mean(after), "optimized_pstdev": pstdev(after)}
