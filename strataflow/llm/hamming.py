"""Exact top-k search over binary codes: incremental multi-index hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import cut

BITS = 64


def sign_code(vector: Column) -> Column:
    """A long with bit i set where component i is above zero; for vectors of up to 64 components."""
    bit = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) <= BITS, code).otherwise(F.raise_error(F.lit("a code has 64 bits")).cast("long"))


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments: four bits below log2 of the rows, so a bucket holds some sixteen codes.

    Wider segments have emptier buckets but need larger radii, and probes grow with the binomials of these.
    """
    m = min(16, max(3, round(BITS / max(4.0, math.log2(max(n, 2)) - 4))))
    widths = [BITS // m + (k < BITS % m) for k in range(m)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def hamming_top_k(vectors: DataFrame, k: int = 10, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): for each row whose id is divisible by `every`, its k nearest others.

    Distance is that of the sign codes in bits; equal distances go by id. The search is exact. Codes are cut
    into segments, each with an index of its values. In round r, every segment of a query that is not done is
    probed at all values that differ in exactly r bits. Then every code within m * (r + 1) - 1 bits has been
    met, m being the number of segments; a query is done when its kth verified distance is within that, or
    when the radius has passed the segments' width. A pair is taken up once, by the first of its segments with
    the least difference.

    Rows of equal code count once: the index holds distinct codes, and of each code's rows the k + 1 least ids,
    more of which no answer can have; this limit is applied before rows are shuffled, so a vector in a third
    of all rows is a few rows. A crowded bucket is split by AQE. Null ids, null vectors: neither queries nor
    answers. Null components count as not above zero. Rows of equal id and code are one row. Fewer than k
    others: all of them. An empty table: no rows.
    """
    coded = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    coded = cut(coded.select(F.col(id_col).cast("long").alias("vec_id"), sign_code(F.col(vector_col)).alias("code")))
    near_ids = Window.partitionBy("code").orderBy("vec_id")
    members = cut(coded.distinct().withColumn("nth", F.row_number().over(near_ids)).where(F.col("nth") <= k + 1).drop("nth"))
    codes = cut(coded.select("code").distinct())
    parts = _segments(codes.count())
    masks = [((1 << w) - 1) << s for s, w in parts]
    lit = lambda m: F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long")
    value = lambda c, j: F.shiftrightunsigned(c.bitwiseAND(lit(masks[j])), parts[j][0])
    index = codes.select(F.col("code").alias("near"), F.posexplode(F.array(*[value(F.col("code"), j) for j in range(len(parts))])).alias("part", "value"))
    index = cut(index)
    queries = coded.where(F.col("vec_id") % every == 0).distinct()
    active = cut(queries.select("code").distinct().withColumn("bound", F.lit(BITS)))
    top, done = None, None
    for r in range(max(w for _, w in parts) + 1):
        probes = None
        for w in sorted({w for _, w in parts}):
            flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << w) - 1).cast("long")), lambda x: F.bit_count(x) == r)
            own = [F.struct(F.lit(j).alias("part"), value(F.col("code"), j).alias("value")) for j, (_, width) in enumerate(parts) if width == w]
            some = active.select("code", "bound", F.explode(F.array(*own)).alias("p")).select("code", "bound", "p.*", F.explode(flips).alias("flip"))
            probes = some if probes is None else probes.union(some)
        probes = probes.select("code", "bound", "part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        apart = F.col("code").bitwiseXOR(F.col("near"))
        gaps = [F.bit_count(apart.bitwiseAND(lit(m))) for m in masks]
        first = F.lit(True)
        for j, gap in enumerate(gaps):
            first = first & F.when(F.col("part") > j, gap > r).otherwise(gap >= r)
        met = probes.join(index, ["part", "value"]).where((F.bit_count(apart) <= F.col("bound")) & first).select("code", "near", F.bit_count(apart).alias("distance"))
        found = met.join(members.withColumnRenamed("code", "near"), "near").select("code", "vec_id", "distance")
        found = found if top is None else found.union(top)
        order = Window.partitionBy("code").orderBy("distance", "vec_id")
        top = cut(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth"))
        state = active.select("code").join(top.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("far")), "code", "left")
        full = F.coalesce(F.col("n"), F.lit(0)) >= k + 1
        covered = len(parts) * (r + 1) - 1
        left = cut(state.where(~(full & (F.col("far") <= covered))).select("code", F.when(full, F.col("far")).otherwise(BITS).alias("bound")))
        ended = top.join(left, "code", "left_anti")
        done = ended if done is None else done.union(ended)
        if not left.count():
            break
        top, active = top.join(left.select("code"), "code", "left_semi"), left
    else:
        done = done.union(top)
    mine = queries.select(F.col("vec_id").alias("query_id"), "code").join(done, "code").where("vec_id <> query_id")
    mine = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return mine.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("distance").cast("long").alias("distance"))


ORACLE = """
WITH c AS (SELECT DISTINCT vec_id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, n.vec_id, CAST(bit_count(xor(q.code, n.code)) AS BIGINT) AS distance
  FROM c q JOIN c n ON n.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
