"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import texts
from strataflow.llm.rolling import Words, chunks

_CHUNK = 8 << 20


class ItemIndex:
    """MinHash sketches of test items, by size, and their exact shingles.

    A text that holds a share of `threshold` of an item's n shingles misses n - ceil(threshold * n) at most, so
    one of any set of one more is in it: the sketch of an item is that many of its shingles. Items are
    partitioned by powers of two of their size; a partition has one sketch length, the one that its largest
    size needs. So no item can be missed, whatever the length of the text. The shingles of a sketch are those in
    the fewest items, and of these the ones of least hash: a shingle that many items share makes candidates
    only of items that have hardly any other.
    """

    def __init__(self, items: list[str], words: int, threshold: float):
        self.words, self.threshold = words, threshold
        self.texts, self.shingles, self.hashes = [], [], []
        parts: dict[int, list[int]] = defaultdict(list)
        for text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]), lower=True)
            n = int(w.counts[0])
            if not n:
                continue
            size = min(words, n)
            at, hashes = w.windows(size)
            exact = {w.bytes_of(int(a), size): h for a, h in zip(at, hashes, strict=True)}
            parts[len(exact).bit_length()].append(len(self.texts))
            self.texts.append(text)
            self.shingles.append(set(exact))
            self.hashes.append(np.unique(hashes))
        every, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.hashes]), return_counts=True)
        found: dict[int, list[int]] = defaultdict(list)
        for exponent, members in parts.items():
            largest = (1 << exponent) - 1
            sketch = largest - math.ceil(threshold * largest - 1e-9) + 1
            for k in members:
                own = self.hashes[k]
                for h in own[np.lexsort((own, held[np.searchsorted(every, own)]))][:sketch].tolist():
                    found[h].append(k)
        self.keys = np.array(sorted(found), np.uint64)
        self.items = [found[h] for h in self.keys.tolist()]
        self.near = np.zeros(1 << 20, bool)  # most shingles of a corpus stop at this filter
        self.near[self.keys >> np.uint64(44)] = True

    def matches(self, w: Words, texts: int) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of all pairs that reach the threshold."""
        if not len(self.keys):
            return
        at, hashes = w.windows(self.words)
        short = np.flatnonzero((w.counts > 0) & (w.counts < self.words))
        if len(short):
            at = np.concatenate([at, w.first[short]])
            hashes = np.concatenate([hashes, *[w.whole(int(t)) for t in short]])
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
        maybe = np.flatnonzero(self.near[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[maybe]
        text_of = np.searchsorted(w.first, at[maybe[hit]], "right") - 1
        bounds = np.searchsorted(at, w.first)
        met: dict[int, set[int]] = defaultdict(set)
        for t, p in set(zip(text_of.tolist(), place[hit].tolist(), strict=True)):
            met[t].update(self.items[p])
        for t in sorted(met):
            own, where = np.unique(hashes[bounds[t] : bounds[t + 1]], return_index=True)
            size = min(self.words, int(w.counts[t]))
            for k in sorted(met[t]):
                wanted, least = self.hashes[k], math.ceil(self.threshold * len(self.shingles[k]) - 1e-9)
                spot = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                same = where[spot[own[spot] == wanted]] + bounds[t]
                if len(same) >= least:
                    shared = len({w.bytes_of(int(i), size) for i in at[same]} & self.shingles[k])
                    if shared >= least:
                        yield t, k, shared


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment): documents that hold a test item.

    Words are runs without ASCII blanks, A-Z in lower case; an item's shingles are its distinct sequences of
    `words` words, or its whole text where that has fewer. A pair is returned if at least `threshold` of the
    item's shingles are among the document's, so also one exactly at it. So an item of fewer than `words` words
    is found only where it is a document's whole text, not inside a longer one. Null, blank and empty texts and
    items match nothing. Null ids: such rows are compared as any other. Equal rows of either table give equal
    result rows, one for each pair. Empty tables: no rows.

    Items of equal text are one in the search; their ids join the result by 128 bits of hash. Different texts
    are taken in blocks of about block_bytes, so what goes to the driver and the executors has a bound (an
    index takes some thirty times its text); each block is one pass over the documents. No document is frequent
    enough to matter. A document goes through in memory that follows its own length.
    """
    out, each = None, texts(docs, id_col, text_col)
    for index in _indexes(items, words, threshold, block_bytes, item_text):
        found = each.mapInArrow(_searcher(index), "doc_id long, n_shared long, n_shingles long, text string")
        found = found.select("doc_id", "n_shared", "n_shingles", *_text_keys(F.col("text")))
        out = found if out is None else out.union(found)
    named = items.select(F.col(item_id).cast("long").alias("item_id"), *_text_keys(F.col(item_text)))
    out = out.join(named, ["h1", "h2"]).select("doc_id", "item_id", "n_shared", "n_shingles")
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, block_bytes: int = 4 << 20, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no test item; one pass for each block of items.

    Rows with null, blank or empty texts stay, and so do all rows where there are no items. What contaminated()
    says of null ids, long texts, equal rows, ties at the threshold and empty tables holds here.
    """
    at = docs.columns.index(text_col)
    for index in _indexes(items, words, threshold, block_bytes, item_text):
        docs = docs.mapInArrow(_filter(index, at), docs.schema)
    return docs


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def _indexes(items: DataFrame, words: int, threshold: float, block_bytes: int, item_text: str) -> Iterator:
    """The different items' index, broadcast, in blocks."""
    chosen = items.select(F.col(item_text).alias("text")).where("text is not null").distinct()
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    for k in range(n_blocks):
        block = chosen.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k).collect()  # block_bytes of text
        yield items.sparkSession.sparkContext.broadcast(ItemIndex(sorted(r[0] for r in block), words, threshold))


def _filter(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            keep, first = np.ones(b.num_rows, bool), 0
            bare = iter([pa.RecordBatch.from_arrays([b.column(at).fill_null("")], ["text"])])
            for rows, data, offsets in chunks(bare, 0, _CHUNK):
                keep[[first + t for t, _, _ in own.matches(Words(data, offsets, lower=True), rows.num_rows)]] = False
                first += rows.num_rows
            yield b.filter(pa.array(keep))

    return run


def _searcher(index):
    names = ["doc_id", "n_shared", "n_shingles", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for rows, data, offsets in chunks(batches, 1, _CHUNK):
            found = list(own.matches(Words(data, offsets, lower=True), rows.num_rows))
            ids = rows.column(0)
            if found:
                cols = [[ids[t].as_py() for t, _, _ in found], [s for _, _, s in found], [len(own.shingles[k]) for _, k, _ in found]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([own.texts[k] for _, k, _ in found], pa.string())], names)

    return run


ORACLE = r"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS shingle FROM w WHERE len(ws) > 0),
n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, n.item_id, count(*) AS n_shared, n.n_shingles, count(*) / n.n_shingles AS containment
FROM s d JOIN s i USING (shingle) JOIN n ON n.item_id = i.id WHERE d.kind = 0 AND i.kind = 1
GROUP BY d.id, n.item_id, n.n_shingles HAVING count(*) >= ceil(0.8 * n.n_shingles - 1e-9)
"""
