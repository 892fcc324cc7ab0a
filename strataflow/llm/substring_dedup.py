"""Substring dedup: fixed-block anchors, probed by every rolling window and extended to exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.rolling import Words, chunks

_CHUNK = 4 << 20
_TEXT, _DOC, _KEY = "text", "doc_id", "row_key"
_SENT = "part long, bucket long, n long, blob binary"
_NAMES = ["part", "bucket", "n", "blob"]
_DIGEST = np.dtype([("high", ">u8"), ("low", ">u8")])


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=_NAMES)


def _edges(values: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending 64-bit values: buckets are ranges of their high 32 bits."""
    bucket = ((values >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))


def _ordered(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """The group's rows in an order that a second look finds again, in slices; equal rows may change places."""
    group = group.sort_by([(_KEY, "ascending"), (_DOC, "ascending")]).combine_chunks()
    return iter(group.to_batches())


def _cuts(group: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    return chunks(_ordered(group), group.column_names.index(_TEXT), _CHUNK)


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).view(bool)


# Anchors --------------------------------------------------------------------------------------------------


def _rolled(group: pa.Table, block: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(words, first word, hash of every rolling window of block words, rows) of each slice of a group."""
    for rows, data, offsets in _cuts(group):
        w = Words(data, offsets)
        yield w, *w.windows(block), rows


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, whether each is there more than once)."""
    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
    return every[first], np.diff(np.append(first, len(every))) > 1


def _anchors(block: int, n_buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Of a group: its distinct rolling hashes, by bucket, with two bits each: is a reference block, is there twice."""

    def run(group: pa.Table) -> pa.Table:
        part, every, refs = group["part"][0].as_py(), [], []
        for w, at, hashes, _ in _rolled(group, block):
            text = np.searchsorted(w.first, at, "right") - 1
            every.append(hashes)
            refs.append(hashes[(at - w.first[text]) % block == 0])
        own, twice = _distinct(every)
        ref = np.zeros(len(own), bool)
        ref[np.searchsorted(own, _distinct(refs)[0])] = True
        low, edge = own.astype(np.uint32), _edges(own, n_buckets).tolist()
        return _table([(part, k, e - s, low[s:e].tobytes() + _packed(ref[s:e]) + _packed(twice[s:e])) for k, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > s])

    return run


def _opened(table: pa.Table, width: int, flags: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(n of each row, all entries' bytes one after another, their flags) of the rows of one bucket."""
    sizes, blobs = table["n"].to_numpy(), [b.as_py() for b in table["blob"]]
    entries = b"".join([b[: width * n] for b, n in zip(blobs, sizes.tolist(), strict=True)])
    bits = [[] for _ in range(flags)]
    for b, n in zip(blobs, sizes.tolist(), strict=True):
        for k in range(flags):
            at = width * n + k * -(-n // 8)
            bits[k].append(_bits(b[at : at + -(-n // 8)], n))
    return sizes, np.frombuffer(entries, np.uint8), [np.concatenate(x) for x in bits]


def _answers(table: pa.Table, sizes: np.ndarray, good: np.ndarray) -> pa.Table:
    """To each row one bit an entry, in its order; nothing to rows without a good one."""
    ends = np.cumsum(sizes)
    rows = []
    for part, bucket, n, end in zip(table["part"].to_pylist(), table["bucket"].to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
        own = good[end - n : end]
        if own.any():
            rows.append((part, bucket, n, _packed(own)))
    return _table(rows)


def _hits(table: pa.Table) -> pa.Table:
    """Of one bucket: which entries have the hash of a reference block that another window has too."""
    sizes, raw, (ref, twice) = _opened(table, 4, 2)
    entries = raw.view(np.uint32)
    order = np.argsort(entries, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], entries[order][1:] != entries[order][:-1]]))
    size = np.diff(np.append(edge, len(order)))
    some = lambda flag: np.logical_or.reduceat(flag[order], edge)
    good = np.empty(len(order), bool)
    good[order] = np.repeat(some(ref) & ((size > 1) | some(twice)), size)
    return _answers(table, sizes, good)


def _told(answers: pa.Table, edge: np.ndarray, n: int) -> np.ndarray:
    """The answers' bits, laid over the values that were sent."""
    good = np.zeros(n, bool)
    for bucket, size, blob in zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["blob"], strict=True):
        if bucket >= 0:
            good[edge[bucket] : edge[bucket] + size] = _bits(blob.as_py(), size)
    return good


# Repeats --------------------------------------------------------------------------------------------------


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any [start, end); ends of the intervals may lie outside."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.clip(starts, 0, n), 1)
    np.add.at(change, np.clip(ends, 0, n), -1)
    return np.cumsum(change[:n]) > 0


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, last) of every run of true positions."""
    change = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.column_stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1]).astype(np.int64)


def _digests(w: Words, at: np.ndarray, size: int) -> np.ndarray:
    """128 bits of XXH3 over the bytes of each window's words, joined by one space."""
    import xxhash

    joined, starts, ends = w.joined()
    digest = xxhash.xxh3_128_digest
    spans = zip(starts[at].tolist(), ends[at + size - 1].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[s:e]) for s, e in spans]), _DIGEST)


def _sorted_digests(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, twice) of the distinct digests, in order."""
    every = np.concatenate([np.zeros(0, _DIGEST), *parts])
    high, low = every["high"].astype(np.uint64), every["low"].astype(np.uint64)
    order = np.argsort(high, kind="stable")
    high, low = high[order], low[order]
    clash = (high[1:] == high[:-1]) & (low[1:] != low[:-1])
    if clash.any():  # half a digest in common is next to impossible, but not wrong
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(high)), bool), (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[first], low[first], np.diff(np.append(first, len(high))) > 1


def _sent(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = np.empty((len(high), 2), "<u8")
    out[:, 0], out[:, 1] = high, low
    return out


def _extended(block: int, size: int, n_buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group and the answers to its hashes: the windows of size words that hold an anchor, by bucket.

    A first row, in a bucket of the group's own, tells the group where they are: runs of word numbers.
    """

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group) or not len(answers):
            return _table([])
        rolled = [(at, hashes) for _, at, hashes, _ in _rolled(group, block)]
        own, _ = _distinct([h for _, h in rolled])
        good = own[_told(answers, _edges(own, n_buckets), len(own))]
        part, runs, digests, before = group["part"][0].as_py(), [], [], 0
        for (at, hashes), (_, data, offsets) in zip(rolled, _cuts(group), strict=True):
            place = np.minimum(np.searchsorted(good, hashes), len(good) - 1)
            anchors = at[good[place] == hashes]
            w = Words(data, offsets, hashed=False)
            if len(anchors):
                near = _covered(len(w.starts), anchors - (size - block), anchors + 1) & w.begins(size)
                runs.append(_runs(near) + before)
                digests.append(_digests(w, np.flatnonzero(near), size))
            before += len(w.starts)
        high, low, twice = _sorted_digests(digests)
        if not len(high):
            return _table([])
        sent, edge = _sent(high, low), _edges(high, n_buckets).tolist()
        rows = [(part, k, e - s, sent[s:e].tobytes() + _packed(twice[s:e])) for k, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > s]
        return _table([(part, -1 - part, 0, np.concatenate(runs).astype("<i8").tobytes()), *rows])

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: which digests are there more than once."""
    if table["bucket"][0].as_py() < 0:
        return table
    sizes, raw, (twice,) = _opened(table, 16, 1)
    pairs = raw.view("<u8").reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    edge = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)]))
    size = np.diff(np.append(edge, len(order)))
    good = np.empty(len(order), bool)
    good[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], edge), size)
    return _answers(table, sizes, good)


_OUT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def _removed(size: int, n_buckets: int, texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group and the answers to its windows: every text without its repeats."""

    def repeated(group: pa.Table, answers: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """(windows near anchors, whether each is a repeat) of each slice."""
        own = [b.as_py() for b, k in zip(answers["blob"], answers["bucket"].to_pylist(), strict=True) if k < 0]
        runs = np.frombuffer(own[0], "<i8").reshape(-1, 2) if own else np.zeros((0, 2), np.int64)
        starts, digests, before = [], [], 0
        for _, data, offsets in _cuts(group):
            w = Words(data, offsets, hashed=False)
            here = runs[(runs[:, 0] >= before) & (runs[:, 0] < before + len(w.starts))] - before
            starts.append(np.flatnonzero(_covered(len(w.starts), here[:, 0], here[:, 1] + 1)))
            digests.append(_digests(w, starts[-1], size))
            before += len(w.starts)
        if not own:
            return [(s, np.zeros(0, bool)) for s in starts]
        high, low, _ = _sorted_digests(digests)
        good = _told(answers, _edges(high, n_buckets), len(high))
        out = []
        for s, d in zip(starts, digests, strict=True):
            a, b = d["high"].astype(np.uint64), d["low"].astype(np.uint64)
            place = np.searchsorted(high, a)
            while len(wrong := np.flatnonzero(low[place] != b)):  # among digests of equal first halves
                place[wrong] += 1
            out.append((s, good[place]))
        return out

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
        counts, removed, kept, digest, ids = [], [], [], [], []
        for (rows, data, offsets), (starts, again) in zip(_cuts(group), repeated(group, answers), strict=True):
            w = Words(data, offsets, hashed=False)
            at = starts[again]
            gone = _covered(len(w.starts), at, at + size)
            joined, begin, end = w.joined()
            lost = np.concatenate([[0], np.cumsum(gone)])
            for first, last in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                n = int(lost[last] - lost[first])
                if not n:
                    text = joined[begin[first] : end[last - 1]] if last > first else b""
                else:
                    text = b" ".join([joined[begin[s + first] : end[e + first]] for s, e in _runs(~gone[first:last]).tolist()])
                counts.append(last - first)
                removed.append(n)
                kept.append(text.decode() if texts else None)
                digest.append(hashlib.sha256(text).hexdigest())
            ids.append(rows.column(rows.schema.names.index(_DOC)))
        return pa.table([pa.chunked_array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35, group_bytes: int = 32 << 20, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): the texts without repeated windows of `size` words.

    Every word is removed that a window of `size` consecutive words covers whose sequence starts at another
    place too, in the same document or in another; all windows are judged on the input.

    Anchors: blocks of size // 2 + 1 words (18 of 35) at multiples of that in each text are the index. A window
    of `size` words holds a whole block wherever it starts, so each occurrence of a repeated window is hit at
    the block of one of them. Every rolling window of a block's length is probed against the index by hash; a
    hit is extended by all windows of `size` words around it. These are compared by 128 bits of XXH3 over their
    bytes, which has nothing to do with the hash of the probes; those that occur again, joined to maximal
    repeats, are removed. False anchors cost time only.

    Texts are dealt once, by a hash of row and input partition, into groups of about group_bytes, or less down to
    1 MB for three a shuffle partition; all three looks at a text read that one exchange. A group sends each hash once, however
    often it holds it, so a passage in a third of all documents is one entry a group; it gets back one bit an
    entry. A probe is 4 bytes and two bits, a window near an anchor 16 bytes and a bit. There are as many
    buckets of hashes as groups; where a group has few hashes for each bucket (beyond some 10 TB) larger groups
    save rows. Nothing is kept outside shuffles, so Spark makes again what a lost executor held.

    Null, empty and blank texts have no words. Null ids stay null. Equal rows are copies of each other, and of
    `size` words or more lose every word; copies from different input partitions go to different groups. A text
    goes through whole, in memory that follows its own length. An empty table gives an empty table.
    """
    block, spark = size // 2 + 1, docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(raw)).alias("n")).first()["n"] or 0
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-total // group_bytes), min(3 * deals, total >> 20))  # a group sends a row to each bucket
    each = docs.select(F.col(id_col).cast("long").alias(_DOC), raw.alias(_TEXT)).withColumn(_KEY, F.xxhash64(_DOC, _TEXT))
    each = each.withColumn("part", F.pmod(F.xxhash64(_KEY, F.spark_partition_id()), F.lit(n)))
    groups = each.groupBy("part")
    asked = groups.applyInArrow(_anchors(block, n), _SENT)
    anchors = asked.groupBy("bucket").applyInArrow(_hits, _SENT)
    around = groups.cogroup(anchors.groupBy("part")).applyInArrow(_extended(block, size, n), _SENT)
    repeats = around.groupBy("bucket").applyInArrow(_repeats, _SENT)
    return groups.cogroup(repeats.groupBy("part")).applyInArrow(_removed(size, n, keep_text), _OUT)


def op5(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs, keep_text=False).drop("kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k, len(ws) AS n FROM d),
s AS (SELECT d.r, u.k, md5(array_to_string(d.ws[u.k:u.k + 34], ' ')) AS h FROM d, unnest(range(1, len(d.ws) - 33)) AS u(k)),
g AS (SELECT r, k FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
c AS (SELECT w.r, w.k, w.word, coalesce(max(g.k) OVER (PARTITION BY w.r ORDER BY w.k ROWS UNBOUNDED PRECEDING) > w.k - 35, false) AS gone
  FROM w LEFT JOIN g ON g.r = w.r AND g.k = w.k)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, sum(CAST(gone AS BIGINT)) AS n, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r) x ON x.r = d.r
"""
