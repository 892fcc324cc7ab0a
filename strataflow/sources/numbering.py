"""Gapless row numbers without a single task: a range partitioning, and a count for each of its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.sources.checkpoints import cut


def number_rows(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """rows with a gapless long row_number from 0 in the given order, and how many there are.

    Written once in parts of the order; a part's first number is the count of the rows before it, one small row
    a part. Rows that are equal in `order` are spread over parts and get numbers in no set order.
    """
    names = [f"_by_{k}" for k in range(len(order))]
    by = [*[F.col(n).asc_nulls_first() for n in names], F.col("_tie")]
    dealt = rows.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)], F.rand(1).alias("_tie"))
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop(*names, "_tie")
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # one row a part
    first, total = [], 0
    for p in sorted(counts):
        first.append((int(p), total))
        total += counts[p]
    starts = placed.sparkSession.createDataFrame(first, "_p long, _first long")
    numbered = placed.join(F.broadcast(starts), part == F.col("_p"))
    return numbered.withColumn("row_number", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_first"), total
