"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import BLANKS, ascii_lower, cut


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep_row: bool = False) -> DataFrame:
    r"""(doc_id, n_lines, n_dropped, kept): the texts without the lines that many documents share.

    A text splits at \n; a line's key is the line without white space at its ends, A-Z in lower case. A key
    of at least `min_chars` code points in at least `min_docs` documents loses its lines in all documents
    but the one of the largest id.

    Null and empty texts: one empty line, kept as an empty text. Null ids: such rows count as no document
    and are never the largest, so they lose shared lines. Equal rows are one document and get equal results;
    so are rows of one id with other texts, of which each holds its lines for that document. A text of any
    length and number of lines takes time in proportion. An empty table gives an empty table.

    Only hashes move: 128 bits a line, its document and position. A line in a third of all documents is
    counted from (hash, document) pairs and pre-aggregated, so no task gathers its documents; the join back
    is a plain equi-join, which AQE splits. Texts move once, in the last join. With keep_row, `row` has
    the other columns of the input as a struct.
    """
    rest = [F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")] if keep_row else []
    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)
    at = at.withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("id_key", F.coalesce("doc_id", F.lit(0)))
    line = F.posexplode(F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), _key(x).alias("key"))), lambda x: F.char_length(x["key"]) >= min_chars))
    found = at.select("doc_id", "id_key", "row_key", line.alias("nth", "line")).select("doc_id", "id_key", "row_key", F.col("line.pos").alias("pos"), F.xxhash64("line.key").alias("h1"), F.xxhash64(F.lit(7), "line.key").alias("h2"))
    found = cut(found)
    shared = (
        found.where("doc_id is not null").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.sum("one").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs).drop("n_docs")
    )
    shared = cut(shared)  # so that the join below has an exchange on both sides, which AQE can split
    dropped = (
        found.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("row_key", "id_key").agg(F.collect_set("pos").alias("gone"))
    )
    lines = F.split("text", "\n", -1)
    row = ["row"] if keep_row else []
    out = at.join(dropped, ["row_key", "id_key"], "left").select("doc_id", lines.alias("lines"), "gone", *row)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))  # by a hash set, so in time linear in the lines
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
        *row,
    )


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with the text that is left, and its number of characters where there is such a column.

    Every row stays, with all its columns. Null texts become empty; what else dedup_lines() says of nulls, long
    texts, equal rows and empty tables holds here.
    """
    out = dedup_lines(docs, id_col, text_col, keep_row=True)
    now = {text_col: F.col("kept"), count_col: F.char_length("kept").cast("long")}
    return out.select(*[now.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
