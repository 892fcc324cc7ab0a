"""Longest-prefix lookup and session reuse over prompts, as windows; the exact sequential cache as a grouped map.

A prompt table has session_id, step, model_id, op_name, temperature, max_tokens, prompt. Tokens are the bytes of
the canonical prompt, so prefixes of tokens are prefixes of bytes and are compared as binaries.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.functions.text import canonicalize, common_prefix, temp_milli
from strataflow.sources.checkpoints import cut

KEY = ["model_id", "op_name", "max_tokens", "temp_milli"]


def keyed(prompts: DataFrame) -> DataFrame:
    """prompts with tokens (binary), total_tokens and temp_milli."""
    tokens = F.encode(F.coalesce(canonicalize(F.col("prompt")), F.lit("")), "UTF-8")
    return prompts.withColumn("tokens", tokens).withColumn("total_tokens", F.length("tokens")).withColumn("temp_milli", temp_milli(F.col("temperature")))


def longest_prefix(store: DataFrame, queries: DataFrame, key: list[str] | None = None, query_id: str = "query_id") -> DataFrame:
    """(query_id, hit_len, handle): the longest common prefix of each query with any stored prefix of its key.

    store: key columns, prefix (binary), handle. queries: key columns, query_id, tokens (binary). Among sorted
    byte strings a query shares most with its neighbours, so one sort finds the store rows before and after it;
    no pair is formed. hit_len 0: handle null.

    The sort is a range partitioning over key and bytes, so one model's prompts, or one prompt in very many
    copies, spread over tasks. What stands before the first and after the last row of a part comes from a small
    table with a row for each part and key. Key columns are not null.
    """
    key = key or KEY
    one = lambda df, value, held: df.select(*key, F.col(value).alias("_bytes"), *held)
    stored = one(store, "prefix", [F.lit(None).cast("long").alias(query_id), F.struct(F.col("prefix").alias("p"), "handle").alias("_held")])
    asked = one(queries, "tokens", [F.col(query_id).cast("long").alias(query_id), F.lit(None).cast(stored.schema["_held"].dataType).alias("_held")])
    return _nearest(stored.unionByName(asked), key, query_id)


def longest_prefix_of_others(rows: DataFrame, key: list[str] | None = None, query_id: str = "query_id") -> DataFrame:
    """(query_id, hit_len, handle): the longest common prefix of each row with any other row of its key.

    rows: key columns, query_id, tokens (binary). Every row is stored and asked, but never finds itself; equal
    tokens in another row are found whole. handle is the other row's query_id. Sorted as in longest_prefix.
    """
    key = key or KEY
    held = F.struct(F.col("tokens").alias("p"), F.col(query_id).cast("long").alias("handle"))
    return _nearest(rows.select(*key, F.col("tokens").alias("_bytes"), F.col(query_id).cast("long").alias(query_id), held.alias("_held")), key, query_id)


def _nearest(both: DataFrame, key: list[str], query_id: str) -> DataFrame:
    """The better of the stored rows (_held) next before and next after each asked row (query_id), itself left out."""
    both = both.withColumn("_tie", F.rand(7))
    placed = both.repartitionByRange(*key, "_bytes", "_tie").withColumn("_part", F.spark_partition_id())
    placed = cut(placed)  # parts have to be the same in both uses
    is_held = F.col("_held").isNotNull()
    edge = lambda pick: pick(F.when(is_held, F.col("_held")), F.when(is_held, F.struct("_bytes", "_tie")))
    parts = placed.groupBy("_part", *key).agg(edge(F.min_by).alias("_low"), edge(F.max_by).alias("_high"))
    along = Window.partitionBy(*key).orderBy("_part")
    parts = parts.select(
        "_part", *key,
        F.last("_high", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_low", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    order = Window.partitionBy("_part", *key).orderBy("_bytes", "_tie")
    before = F.last("_held", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("_part", *key).orderBy(F.desc("_bytes"), F.desc("_tie"))  # a frame to the end is read anew for each row
    after = F.last("_held", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    near = placed.withColumn("_before", before).withColumn("_after", after).where(F.col(query_id).isNotNull())
    near = near.join(parts, ["_part", *key]).withColumn("_before", F.coalesce("_before", "_earlier")).withColumn("_after", F.coalesce("_after", "_later"))
    lcp = lambda c: F.coalesce(common_prefix(F.col("_bytes"), F.col(c)["p"]), F.lit(0))
    near = near.withColumn("_lb", lcp("_before")).withColumn("_la", lcp("_after"))
    best = F.when(F.col("_la") > F.col("_lb"), F.col("_after.handle")).otherwise(F.col("_before.handle"))
    length = F.greatest("_lb", "_la")
    return near.select(query_id, length.alias("hit_len"), F.when(length > 0, best).alias("handle"))


def session_reuse(prompts: DataFrame) -> DataFrame:
    """prompts with hit_len, cache_hit, tokens_saved and tokens_sent under the policy that always reuses.

    The store of a session then only ever holds the first prompt of each key and first byte, so a step's reuse
    is its common prefix with that one: a window, without a cache.
    """
    rows = keyed(prompts).withColumn("_first", F.substring("tokens", 1, 1))
    order = Window.partitionBy("session_id", *KEY, "_first").orderBy("step")
    leader = F.first("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    is_first = F.row_number().over(order) == 1
    hit = F.when(is_first, 0).otherwise(common_prefix(F.col("tokens"), leader))
    rows = rows.withColumn("hit_len", hit)
    return rows.withColumn("cache_hit", F.col("hit_len") > 0).withColumn("tokens_saved", F.col("hit_len")).withColumn("tokens_sent", F.col("total_tokens") - F.col("hit_len")).drop("_first")


class PrefixCache:
    """Every prefix of every inserted prompt, with a handle and the time of its last use; at most max_entries.

    Nodes are numbers, children are found by (node, token), entries by (node, key). The least recently used
    entry goes first, of those of one insertion the shortest. Nodes that lead to no entry any more go from time
    to time, so memory follows the entries and their lengths, not all that was ever inserted.
    """

    def __init__(self, max_entries: int = 8192):
        self.max_entries = max_entries
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, int], int] = {}
        self.depth = {0: 0}
        self.last = 0
        self.entries: dict[tuple[int, object], list] = {}  # [handle, last use]
        self.heap: list[tuple[int, int, int, object]] = []
        self.clock = 0

    def __len__(self) -> int:
        return len(self.entries)

    def _walk(self, tokens: bytes | list[int]) -> Iterator[int]:
        node = 0
        for token in tokens:
            node = self.child.get((node, token), -1)
            if node < 0:
                return
            yield node

    def _touch(self, at: tuple[int, object]) -> None:
        self.entries[at][1] = self.clock
        heapq.heappush(self.heap, (self.clock, self.depth[at[0]], *at))

    def lookup(self, key: object, tokens: bytes | list[int]) -> tuple[int, int | None]:
        """(length, handle) of the longest stored prefix, (0, None) without; the entry counts as used."""
        found = None
        for node in self._walk(tokens):
            if (node, key) in self.entries:
                found = node, key
        if found is None:
            return 0, None
        self.clock += 1
        self._touch(found)
        return self.depth[found[0]], self.entries[found][0]

    def insert(self, key: object, tokens: bytes | list[int], length: int, handle: int | None) -> None:
        """Stores all prefixes up to a length; those already there keep their handle, but for the longest."""
        tokens = tokens[:length] if length > 0 else tokens[:0]
        if not len(tokens):
            return
        self.clock += 1
        node = 0
        for token in tokens:
            at = (node, token)
            node = self.child.get(at, -1)
            if node < 0:
                self.last += 1
                node = self.child[at] = self.last
                self.depth[node] = self.depth[at[0]] + 1
            if (node, key) not in self.entries:
                self.entries[node, key] = [handle, self.clock]
                self._touch((node, key))
        self.entries[node, key][0] = handle
        self._touch((node, key))
        while len(self.entries) > self.max_entries:
            used, _, n, k = heapq.heappop(self.heap)
            if (n, k) in self.entries and self.entries[n, k][1] == used:
                del self.entries[n, k]
        if max(len(self.heap), len(self.depth)) > 8 * len(self.entries) + 4096:
            self._compact()

    def _compact(self) -> None:
        above = {n: at for at, n in self.child.items()}
        live = {0}
        for node, _ in self.entries:
            while node not in live:
                live.add(node)
                node = above[node][0]
        self.child = {at: n for at, n in self.child.items() if n in live}
        self.depth = {n: d for n, d in self.depth.items() if n in live}
        self.heap = [(used, self.depth[n], n, k) for (n, k), (_, used) in self.entries.items()]
        heapq.heapify(self.heap)

    def invalidate(self, handle: int) -> None:
        for at in [at for at, e in self.entries.items() if e[0] == handle]:
            del self.entries[at]

    def dump(self) -> list[tuple[object, bytes, int]]:
        """(key, tokens, last use) of all entries, by depth and use; handles do not survive."""
        above = {n: at for at, n in self.child.items()}
        out = []
        for (node, key), (_, used) in self.entries.items():
            path = []
            while node:
                node, token = above[node]
                path.append(token)
            out.append((key, bytes(reversed(path)), used))
        return sorted(out, key=lambda x: (x[2], len(x[1]), x[1]))

    def restore(self, entries: list[tuple[object, bytes, int]]) -> None:
        for key, tokens, _ in entries:
            self.insert(key, tokens, len(tokens), None)


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: each step compares slices of bytes."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class SortedPrefixes:
    """What a PrefixCache gives as long as nothing is evicted or restored: look-ups among sorted byte strings.

    The longest stored prefix of a query is what it shares with a neighbour in order; `size` counts prefixes.
    """

    def __init__(self) -> None:
        self.stored: dict[object, list[bytes]] = {}
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def _longest(self, stored: list[bytes], tokens: bytes) -> tuple[int, int]:
        at = bisect.bisect_left(stored, tokens)
        return at, max((shared_length(s, tokens) for s in stored[max(0, at - 1) : at + 1]), default=0)

    def lookup(self, key: object, tokens: bytes) -> tuple[int, int | None]:
        length = self._longest(self.stored.get(key, []), tokens)[1]
        return length, 1 if length else None

    def insert(self, key: object, tokens: bytes, length: int, handle: int | None) -> None:
        tokens = tokens[:length] if length > 0 else b""
        stored = self.stored.setdefault(key, [])
        at, known = self._longest(stored, tokens)
        if known < len(tokens):
            stored.insert(at, tokens)
            self.size += len(tokens) - known


def replay(cache: PrefixCache | SortedPrefixes, key: object, tokens: bytes, handle: int, policy: str = "always", threshold: int = 1, max_tokens: int = 0) -> dict:
    """One step of a session: what is predicted, what happens, and what is stored.

    The session first looks up every prompt, whatever the policy. Execution looks up again unless the policy
    is never, and reuses if the policy lets it. A reused entry without a handle shortens what is left to
    compute but is no reuse of state, and then the whole prompt is stored.
    """
    n = len(tokens)
    takes = lambda length: policy == "always" or (policy == "threshold" and length >= threshold)
    length, _ = cache.lookup(key, tokens)
    predicted = length if length and takes(length) else 0
    used, state = 0, None
    if policy != "never" and n:
        length, found = cache.lookup(key, tokens)
        if length and takes(length):
            used, state = length, found
    saved = used if state is not None else 0
    cache.insert(key, tokens, saved if saved > 0 else n, handle)
    return {"predicted_hit_len": predicted, "hit_len": used, "used_cached_state": state is not None, "tokens_saved": saved, "tokens_sent": n - used, "compute_steps": n - used + max_tokens, "cache_size": len(cache)}


_REPLAYED = "predicted_hit_len int, hit_len int, used_cached_state boolean, tokens_saved int, tokens_sent int, compute_steps int, cache_size int"


def sequential_reuse(prompts: DataFrame, policy: str = "always", threshold: int = 1, max_entries: int = 8192, warm: DataFrame | None = None) -> DataFrame:
    """(session_id, step, total_tokens, ...): every session's steps in order against an exact cache.

    For thresholds, eviction and caches loaded without handles, where what is stored depends on each step
    before it. One session is one group and needs memory for its own cache only, which max_entries bounds.
    `warm`: saved entries (session_id, model_id, op_name, max_tokens, temp_milli, prefix, last_used) to begin with.
    """
    rows = keyed(prompts).select("session_id", "step", *KEY, "tokens", "total_tokens")
    schema = f"session_id {rows.schema['session_id'].dataType.simpleString()}, step long, total_tokens int, {_REPLAYED}"

    def steps(pdf: pd.DataFrame, cache: PrefixCache | SortedPrefixes) -> list[dict] | None:
        out = []
        for handle, r in enumerate(pdf.sort_values("step").to_dict("records"), 1):
            done = replay(cache, tuple(r[k] for k in KEY), bytes(r["tokens"]), handle, policy, threshold, int(r["max_tokens"]))
            out.append({"session_id": r["session_id"], "step": r["step"], "total_tokens": r["total_tokens"], **done})
            if len(cache) > max_entries:
                return None  # without eviction: this session needs the exact cache from its beginning
        return out

    def run(pdf: pd.DataFrame, saved: pd.DataFrame | None = None) -> pd.DataFrame:
        out = None
        if saved is None or not len(saved):
            out = steps(pdf, SortedPrefixes())
        if out is None:
            cache = PrefixCache(max_entries)
            if saved is not None and len(saved):
                cache.restore([(tuple(r[k] for k in KEY), bytes(r["prefix"]), 0) for r in saved.sort_values(["last_used", "prefix"]).to_dict("records")])
            out = steps(pdf, cache)
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    if warm is None:
        return rows.groupBy("session_id").applyInPandas(lambda pdf: run(pdf), schema)
    both = rows.groupBy("session_id").cogroup(warm.groupBy("session_id"))
    return both.applyInPandas(lambda pdf, saved: run(pdf, saved) if len(pdf) else run(pdf), schema)


def cache_after(prompts: DataFrame, policy: str = "always", threshold: int = 1, max_entries: int = 8192) -> DataFrame:
    """The entries that a session leaves: session_id, key columns, prefix, prefix_len, last_used."""
    rows = keyed(prompts).select("session_id", "step", *KEY, "tokens")
    sid = rows.schema["session_id"].dataType.simpleString()
    schema = f"session_id {sid}, model_id string, op_name string, max_tokens int, temp_milli int, prefix binary, prefix_len int, last_used long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache = PrefixCache(max_entries)
        for handle, r in enumerate(pdf.sort_values("step").to_dict("records"), 1):
            replay(cache, tuple(r[k] for k in KEY), bytes(r["tokens"]), handle, policy, threshold)
        session = pdf["session_id"].iloc[0]
        return pd.DataFrame([(session, *key, p, len(p), used) for key, p, used in cache.dump()], columns=["session_id", *KEY, "prefix", "prefix_len", "last_used"])

    return rows.groupBy("session_id").applyInPandas(run, schema)


def evict(store: DataFrame, max_entries: int, by: list[str]) -> DataFrame:
    """The max_entries most recently used entries of each group; of equal use the deeper ones."""
    order = Window.partitionBy(*by).orderBy(F.col("last_used").desc(), F.col("prefix_len").desc())
    return store.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= max_entries).drop("_nth")


def invalidate(store: DataFrame, handles: DataFrame | Column | int) -> DataFrame:
    """The store without the entries of one handle, or of those in a table with a column handle."""
    if isinstance(handles, DataFrame):
        return store.join(handles.select("handle").distinct(), "handle", "left_anti")
    return store.where(~F.col("handle").eqNullSafe(F.lit(handles) if isinstance(handles, int) else handles))


def save_metadata(store: DataFrame, path: str) -> None:
    """The store without its handles, as Parquet."""
    store.drop("handle").write.mode("overwrite").parquet(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved store, handles null; None if the folder is no complete store."""
    needed = {*KEY, "prefix", "last_used"}
    try:
        found = spark.read.parquet(path)
    except Exception as e:  # the analyser's word for a missing or broken folder
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "CANNOT_READ_FILE" in str(e):
            return None
        raise
    return found.withColumn("handle", F.lit(None).cast("long")) if needed <= set(found.columns) else None
