"""Connected components over an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the smallest node that can be reached.

    Alternates the large-star and small-star steps until the edges are stars, O(log^2 n) rounds. A step takes
    minima, which combine before they are shuffled, and one equi-join, which AQE splits where a node has very
    many neighbours. Each round is written once to the shared checkpoint folder, in place of the one before it;
    the driver sees a count and a checksum. Edges with a null or of a node to itself say nothing; no edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    mark = None
    while True:
        count, total = now.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
        if (count, total) == mark or not count:
            return now.select(F.col("v").alias("node"), F.col("m").alias("root")).union(now.select("m", "m").distinct())
        mark = count, total
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select("m", "v"))
        lowest = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lowest, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        large = cut(large)
        lowest = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(lowest, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        before, now = now, cut(small.union(lowest).distinct())
        discard(before, large)
