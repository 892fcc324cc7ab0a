"""Generated question-answering rows, their batches and their split."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.sources.numbering import number_rows

# Countries with their capitals, and the wordings of questions and contexts.
CAPITALS = {
    "France": "Paris", "Japan": "Tokyo", "India": "New Delhi", "Italy": "Rome", "Spain": "Madrid", "Germany": "Berlin",
    "Canada": "Ottawa", "Brazil": "Brasilia", "Australia": "Canberra", "Egypt": "Cairo", "Mexico": "Mexico City", "Argentina": "Buenos Aires",
}
QUESTIONS = [
    "What is the capital of {country}?",
    "Which city is the capital of {country}?",
    "Name the capital city for {country}.",
    "{country} has what capital?",
    "In {country}, what is the national capital?",
]
CONTEXTS = [
    "Guide note: The capital of {d_country} is {d_capital}. Reference note: The capital of {country} is {capital}.",
    "Guide note: The capital of {country} is {capital}. Reference note: The capital of {d_country} is {d_capital}.",
    "{country} overview: It is a country in this benchmark. Fact: The capital of {country} is {capital}. Distractor: The capital of {d_country} is {d_capital}.",
    "Comparison card: The capital of {d_country} is {d_capital}; meanwhile, the capital of {country} is {capital}.",
    "Comparison card: The capital of {country} is {capital}; meanwhile, the capital of {d_country} is {d_capital}.",
    "Trivia text: Some people mention {d_country} and {d_capital}. For the asked nation, the capital of {country} is {capital}.",
    "{country}'s capital is {capital}. Nearby note: The capital of {d_country} is {d_capital}.",
    "People compare {d_country} ({d_capital}) and {country} ({capital}) in geography quizzes.",
]


def _nth(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))


def wordings(samples: int, seed: int) -> list[tuple[int, int, int]]:
    """(id, question, context): which wordings each row has, by one seeded generator."""
    rng = random.Random(seed)
    return [(i, rng.choice(range(len(QUESTIONS))), rng.choice(range(len(CONTEXTS)))) for i in range(samples)]


def qa_rows(spark: SparkSession, samples: int = 200, seed: int = 0) -> DataFrame:
    """(id, question, context, answer, target_country). Wordings are drawn on the driver; rows are made by Spark."""
    rows = spark.createDataFrame(wordings(samples, seed), "id int, q int, c int")
    names, cities = list(CAPITALS), list(CAPITALS.values())
    own, other = F.col("id") % len(names), (F.col("id") + 3) % len(names)
    filled = {"{country}": _nth(names, own), "{capital}": _nth(cities, own), "{d_country}": _nth(names, other), "{d_capital}": _nth(cities, other)}
    question, context = _nth(QUESTIONS, F.col("q")), _nth(CONTEXTS, F.col("c"))
    for mark, value in filled.items():
        question, context = F.replace(question, F.lit(mark), value), F.replace(context, F.lit(mark), value)
    return rows.select("id", question.alias("question"), context.alias("context"), filled["{capital}"].alias("answer"), filled["{country}"].alias("target_country"))


def batched(rows: DataFrame, size: int = 20, order: str = "id") -> DataFrame:
    """rows with batch_id: slices of `size` in the given order, the last may be short."""
    numbered, _ = number_rows(rows, [F.col(order)])
    return numbered.withColumn("batch_id", F.expr(f"row_number div {int(size)}")).drop("row_number")


def batches(rows: DataFrame, size: int = 20, order: str = "id") -> Iterator[DataFrame]:
    """One DataFrame a batch, in order; all read one numbered table."""
    numbered, total = number_rows(rows, [F.col(order)])
    for first in range(0, total, size):
        yield numbered.where((F.col("row_number") >= first) & (F.col("row_number") < first + size)).drop("row_number")


def split_train_test(rows: DataFrame, ratio: float = 0.8, seed: int = 42, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The same share as a shuffle and a cut would give, by the order of a seeded hash of the id."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    numbered, total = number_rows(rows, [drawn, F.col(id_col)])
    cut_at = math.floor(total * ratio)
    return numbered.where(F.col("row_number") < cut_at).drop("row_number"), numbered.where(F.col("row_number") >= cut_at).drop("row_number")
