"""SimHash near-dedup: fingerprints, an index of byte positions, count filtering, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import cut, texts
from strataflow.llm.graph import components

BYTES = 8
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text over word shingles, repeats included; 0 without any word."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six blanks
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(b" ".join(found), 42)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):  # a long text in blocks of bounded size
        here = zip(starts[at : min(at + _BLOCK, n)].tolist(), ends[at + words - 1 : min(at + _BLOCK, n) + words - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], 42) for s, e in here], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp, text_key) of every row, as longs; text_key is a hash of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["doc_id", "fp", "text_key"])

    keyed = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, fp long, text_key long")


def _joined(fps: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of near pairs of members (smaller place first) those that connect what was not connected before."""
    root, left, right = np.arange(len(fps)), [], []
    parts = len(fps)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for i, j in pairs:
        new = np.flatnonzero(root[i] != root[j])
        for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
            u, v = find(x), find(y)
            if u != v:
                root[max(u, v)] = min(u, v)
                left.append(x)
                right.append(y)
                parts -= 1
        if parts == 1:
            break
        if len(new):
            while (root[root] != root).any():
                root = root[root]
    return fps[np.array(left, np.int64)], fps[np.array(right, np.int64)]


def _tallied(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """The count filter: whether a pair shares at least `least` of its bytes in place."""
    apart = np.ascontiguousarray(np.atleast_1d(a ^ b))
    return (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= least


def _near(a: np.ndarray, b: np.ndarray, max_bits: int, least: int) -> np.ndarray:
    """Pairs that reach the guaranteed minimum of shared bytes and are then verified by their bits."""
    kept = _tallied(a, b, least)
    kept[kept] = np.bitwise_count((a ^ b)[kept]) <= max_bits
    return kept


def _neighbours(fps: np.ndarray, max_bits: int, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near pairs of a list whose members differ in the bytes `free` only, by a table of these bytes' values.

    Each member looks up what differs from it in one bit, in two, in as many as are near: time is the list's
    length times a number that max_bits sets (2 324 at 3 bits), for however crowded a list.
    """
    short = np.zeros(len(fps), np.int64)
    for k, p in enumerate(free):
        short |= ((fps >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << (8 * k)
    table = np.full(1 << (8 * len(free)), -1, np.int32)
    table[short] = np.arange(len(fps), dtype=np.int32)
    for bits in range(1, max_bits + 1):
        for flip in combinations(range(8 * len(free)), bits):
            other = table[short ^ sum(1 << f for f in flip)]
            at = np.flatnonzero(other > np.arange(len(fps)))
            if len(at):
                yield at, other[at].astype(np.int64)


def _links(fps: np.ndarray, offsets: np.ndarray, max_bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each list, the fingerprints that differ in at most max_bits bits."""
    left, right = [], []
    sizes = np.diff(offsets)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    few = np.flatnonzero(sizes[bucket] <= 8)
    for d in range(1, 8):  # small lists all at once, neighbours at distance d
        i, j = few[: len(few) - d], few[d:]
        same = bucket[i] == bucket[j]
        i, j = i[same], j[same]
        if not len(i):
            break
        ok = _near(fps[i], fps[j], max_bits, least)
        left.append(fps[i[ok]])
        right.append(fps[j[ok]])

    def pairs(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(len(own) - 1):
            j = np.flatnonzero(_near(own[i + 1 :], own[i], max_bits, least)) + i + 1
            yield np.full(len(j), i), j

    for k in np.flatnonzero(sizes > 8):
        own = fps[offsets[k] : offsets[k + 1]]
        a, b = _joined(own, pairs(own))
        left.append(a)
        right.append(b)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def list_positions(least: int) -> list[tuple[int, ...]]:
    """Sets of least - 1 byte positions such that any `least` positions contain one: the index's lists.

    Chosen greedily. At 3 bits, where a pair shares 5 bytes, they are 14 sets of 4, a Steiner system: each set
    of 5 contains exactly one of them.
    """
    open_sets = set(combinations(range(BYTES), least))
    able = list(combinations(range(BYTES), least - 1))
    chosen = []
    while open_sets:
        best = max(able, key=lambda c: sum(set(c) <= set(o) for o in open_sets))
        chosen.append(best)
        open_sets = {o for o in open_sets if not set(best) <= set(o)}
    return chosen


def _listed(max_bits: int, sets: list[tuple[int, ...]], longer: list[tuple[int, ...]] | None, most: int):
    """Reads lists (which, shared, fp) in order; gives links, and of lists over `most` members their parts.

    A part is a list with one more byte position in common, one of `longer`; without these a list of any length
    is searched by _neighbours(). Not more than `most` members are held where lists have parts.
    """
    least = BYTES - max_bits
    names = ["a", "b", "which", "shared"]

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *none], names)

    def parts(which: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for p in set(range(BYTES)) - set(sets[which]):
            longer_set = tuple(sorted((*sets[which], p)))
            shared = (fps & np.uint64(_mask(longer_set))).view(np.int64)
            to = np.full(len(fps), longer.index(longer_set), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(to), pa.array(shared)], names)

    def whole(which: np.ndarray, fps: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        big = np.diff(edges) > most
        for k in np.flatnonzero(big).tolist():
            own, at = fps[edges[k] : edges[k + 1]], int(which[edges[k]])
            if longer is not None:
                yield from parts(at, own)
            else:
                yield linked(*_joined(own, _neighbours(own, max_bits, sorted(set(range(BYTES)) - set(sets[at])))))
        stay = np.repeat(~big, np.diff(edges))
        a, b = _links(fps[stay], np.concatenate([[0], np.cumsum(np.diff(edges)[~big])]), max_bits, least)
        if len(a):
            yield linked(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, shared, fps = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        over = None  # the list whose first members went to its parts already
        for b in batches:
            which = np.concatenate([which, b.column(0).to_numpy()])
            shared = np.concatenate([shared, b.column(1).to_numpy()])
            fps = np.concatenate([fps, b.column(2).to_numpy().view(np.uint64)])
            edges = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (shared[1:] != shared[:-1])]))
            if over == (which[0], shared[0]):
                end = edges[1] if len(edges) > 1 else len(fps)
                yield from parts(int(which[0]), fps[:end])
                which, shared, fps, edges = which[end:], shared[end:], fps[end:], edges[1:] - end
                if not len(fps):
                    continue
            over, last = None, edges[-1]
            if len(edges) > 1:
                yield from whole(which[:last], fps[:last], edges)
            which, shared, fps = which[last:], shared[last:], fps[last:]
            if longer is not None and len(fps) > most:
                over = which[0], shared[0]
                yield from parts(int(which[0]), fps)
                which, shared, fps = which[:0], shared[:0], fps[:0]
        if len(fps):
            yield from whole(which, fps, np.array([0, len(fps)]))

    return run


def link(fps: DataFrame, max_bits: int = 3, most: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within max_bits (0 to 3) differing bits.

    Such a pair shares at least 8 - max_bits of its eight bytes in place: 5 at 3 bits. The index has posting
    lists by the values of one byte position fewer, for so few choices of positions (14 of 4) that each pair
    which shares enough is in one list at least. The shared bytes of every pair met in a list are tallied over
    all positions, pairs under the guaranteed minimum are dropped, the others are verified by their bits. (Lists
    by a single byte, 256 values a position, would each hold a share of all fingerprints at any size.)

    Lists hold distinct fingerprints, in order, and are read as a stream. One of more than `most` members is dealt
    out again by each further byte; such a part differs in max_bits bytes only, has 2 ** (8 * max_bits) members at
    most, and is searched by a table in time linear in its length. A list gives fewer links than members,
    so a group of near copies never becomes all its pairs.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits goes from 0 to 3")
    sets = list_positions(BYTES - max_bits)
    longer = list(combinations(range(BYTES), BYTES - max_bits))
    signed = [m - (1 << 64) if m >> 63 else m for m in map(_mask, sets)]
    lists = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed]))
    # A fingerprint becomes several rows, so they are dealt out before, in as many parts as a shuffle has.
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    ordered = lambda rows: rows.repartition("which", "shared").sortWithinPartitions("which", "shared", "fp").select("which", "shared", "fp")
    schema = "a long, b long, which int, shared long"
    met = cut(ordered(dealt.select("fp", lists.alias("which", "shared"))).mapInArrow(_listed(max_bits, sets, longer, most), schema))
    links, parts = met.where("which is null").select("a", "b"), met.where("which is not null")
    if parts.isEmpty():
        return links
    again = ordered(parts.select("which", "shared", F.col("a").alias("fp"))).mapInArrow(_listed(max_bits, longer, None, most), schema)
    return links.union(again.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, text_key, root, component_id): the near-duplicate component of every row.

    component_id is the smallest doc_id of the component, root the smallest fingerprint.

    Null, empty and blank texts have fingerprint zero and so are near duplicates of each other. Null ids: the
    row keeps its place and counts for links, but no component takes its name from it. Equal rows are in one
    component. An empty table gives an empty table. A text of any length is taken in blocks.

    Copies meet first: a fingerprint's documents are aggregated before anything is linked, so a third of all
    rows being copies is one row in the index. The labels come back by an equi-join on the fingerprint, which
    AQE splits for a frequent one.
    """
    each = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(link(distinct, max_bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(lowest, "root").select("fp", "root", "component_id")
    return each.join(labels, "fp").select("doc_id", "fp", "text_key", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row of the smallest id stays.

    Where ids are equal, one of the least text hash stays; null ids count as larger than all others. Equal
    rows leave one.
    """
    labels = near_duplicates(docs, id_col, text_col, words, max_bits)
    stays = labels.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("s"))
    stays = stays.select(F.coalesce("s.doc_id", F.lit(0)).alias("_id"), F.col("s.doc_id").isNull().alias("_none"), F.col("s.text_key").alias("_key"))
    own = F.col(id_col).cast("long")
    keyed = docs.select(F.coalesce(own, F.lit(0)).alias("_id"), own.isNull().alias("_none"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return keyed.join(stays, ["_id", "_none", "_key"], "left_semi").dropDuplicates(["_id", "_none", "_key"]).select("_row.*")


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
