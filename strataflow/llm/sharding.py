"""Sharding: a Feistel permutation of global row numbers deals rows to shards and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.sources.numbering import number_rows

#: Each walk leaves the range with a chance under one half, so more steps than this do not occur (2 ** -120 a row).
WALKS = 120


def feistel(number: Column, n_rows: int, seed: int = 42, rounds: int = 6) -> Column:
    """A permutation of 0 .. n_rows-1, computable for any row alone.

    An unbalanced network (halves that differ by one bit where the bits are odd) permutes the smallest power
    of two that holds n_rows; cycle walking repeats it until the value lies in the range.
    """
    bits = max(2, (max(n_rows, 1) - 1).bit_length())
    low = bits // 2
    high = bits - low

    def once(x: Column) -> Column:
        # Even rounds change the high half by the low one, odd rounds the low half by the high one.
        def turn(v: Column, r: Column) -> Column:
            hi, lo = F.shiftrightunsigned(v, low), v.bitwiseAND(F.lit((1 << low) - 1))
            even = F.shiftleft(hi.bitwiseXOR(F.xxhash64(lo, r, F.lit(seed)).bitwiseAND(F.lit((1 << high) - 1))), low).bitwiseOR(lo)
            odd = F.shiftleft(hi, low).bitwiseOR(lo.bitwiseXOR(F.xxhash64(hi, r, F.lit(seed)).bitwiseAND(F.lit((1 << low) - 1))))
            return F.when(r % 2 == 0, even).otherwise(odd)

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, turn)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(number), lambda v, _: F.when(v < n_rows, v).otherwise(once(v)))
    return F.when(walked < n_rows, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def shard_rows(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, position, shard, slot): a reproducible shuffle into shards.

    Rows are numbered by (doc_id, text checksum, size), the number goes through the Feistel permutation, and
    position p lies in shard p mod n_shards at slot p div n_shards; so shard counts differ by one at most and
    slots have no gap. Who knows a row's number computes its place without the other rows.

    Null texts: size 1 and the checksum of no bytes. Null ids come first. Equal rows get different numbers;
    which of them gets which cannot be told apart. An empty table gives an empty table. Texts of any length do not
    move: each is read once for its size and checksum, and the heaviest source or key is as any other row.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"))
    numbered, total = number_rows(small, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    placed = numbered.withColumn("position", feistel(F.col("row_number"), total, seed))
    return placed.select("doc_id", "size", "text_crc32", "row_number", "position", (F.col("position") % n_shards).cast("int").alias("shard"), F.expr(f"position div {n_shards}").alias("slot"))


def op6(docs: DataFrame) -> DataFrame:
    return shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
