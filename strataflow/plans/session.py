"""Sessions of operator graphs: what each run of a graph reuses, and what it computes.

A row is a run. The outputs of all nodes are columns, as without a session; what a token operator reuses
depends on the runs before it, so a session's runs go in order through one exact cache, one group a session.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions import generators
from strataflow.functions.text import joined_inputs, temp_milli
from strataflow.operators.backends import BackendRegistry
from strataflow.operators.prefix import PrefixCache
from strataflow.operators.session import ReusePolicy, ratio
from strataflow.plans import graph as graphs

_STEP = (
    "step long, node_id long, node_name string, total_tokens int, cache_hit boolean, prefix_hit_len int, tokens_saved int, "
    "backend string, hit_len int, used_cached_state boolean, reused_prefix_len int, tokens_sent int, compute_steps int, cache_size int"
)


def _tokens(inputs: list[Column], kinds: list[str], fixed: bool) -> tuple[Column, Column]:
    """(bytes, ids) of what the cache compares: the ids of a first input of tokens, or else the joined text's bytes."""
    if inputs and kinds[0] == "tokens":
        return F.lit(None).cast("binary"), inputs[0].cast("array<int>")
    return F.encode(joined_inputs(*inputs, kinds=kinds, fixed=fixed), "UTF-8"), F.lit(None).cast("array<int>")


def _call(graph: graphs.Graph, node: graphs.Node, made: dict, given: dict, registry: BackendRegistry | None) -> Column:
    """What the cache has to know of one token operator in one run.

    The session looks up what the operator's given inputs say before anything has run; the operator itself
    looks up all its inputs.
    """
    ins, kinds = [made[p][0] for p in node.inputs], [made[p][1] for p in node.inputs]
    known = [k for k, p in enumerate(node.inputs) if p in given]
    first = _tokens([ins[k] for k in known], [kinds[k] for k in known], True)
    own = _tokens(ins, kinds, False)
    backend = registry.select_backend("TokenOp") if registry else None
    rule = graphs.default_rule(node) if backend is None else backend.rule or "fake"
    prompt = generators.read_inputs(rule, ins, kinds)
    text = F.to_binary(F.array_join(F.transform(prompt, lambda x: F.lpad(F.hex(x), 2, "0")), ""), F.lit("hex")) if rule == "vllm" else F.lit(None).cast("binary")
    return F.struct(
        F.lit(node.id).cast("long").alias("node_id"), F.lit(node.debug_name).alias("node_name"), F.lit(rule if backend is None else backend.name).alias("backend"), F.lit(rule).alias("rule"),
        F.lit(node.model_id).alias("model_id"), F.lit(node.op_name).alias("op_name"), F.lit(node.max_tokens).alias("max_tokens"), temp_milli(F.lit(node.temperature)).alias("temp_milli"),
        first[0].alias("given_text"), first[1].alias("given_ids"), own[0].alias("text"), own[1].alias("ids"), F.size(prompt).alias("prompt_size"), text.alias("prompt_text"),
    )


def _reusable(prompt: bytes) -> bytes:
    mark = b" Question:"
    at = prompt.rfind(mark)
    return prompt if at < 0 else prompt[: at + len(mark)]


@dataclass
class Result:
    """values: the rows with node_<id> columns; steps: one row a token operator and run, in the order of lookups."""

    values: DataFrame
    steps: DataFrame


@dataclass
class Session:
    """Runs of graphs that share a cache, by session_id; `policy` decides when a hit is used."""

    registry: BackendRegistry | None = None
    policy: ReusePolicy = field(default_factory=ReusePolicy.always)
    max_cache_entries: int = 8192

    def set_policy(self, policy: ReusePolicy) -> None:
        self.policy = policy

    def run(self, graph: graphs.Graph, rows: DataFrame, inputs: dict[int, str], session: str = "session_id", step: str = "step", **more) -> Result:
        """Rows of one session are its runs, by `step`; equal steps keep no set order. Null inputs count as empty.

        A run first looks up every token operator by its given inputs, which the metrics count, then executes
        them in plan order: look-up, policy, call, insertion. A reused entry's prompt is stored up to the reused
        length, any other whole.
        """
        kinds = graphs.kinds_of(rows, inputs)
        made = graphs._made(graph, {i: F.col(c) for i, c in inputs.items()}, registry=self.registry, kinds=kinds, **more)
        plan = [i for group in graph.schedule() for i in group]
        values = rows.select("*", *[made[i][0].alias(f"node_{i}") for i in plan])
        looked = [i for i in graph.topo_order() if graph.nodes[i].kind == "TokenOp"]
        calls = {i: _call(graph, graph.nodes[i], made, inputs, self.registry) for i in looked}
        return Result(values, self._steps(rows, session, step, looked, [i for i in plan if i in calls], calls))

    def _steps(self, rows: DataFrame, session: str, step: str, looked: list[int], plan: list[int], calls: dict[int, Column]) -> DataFrame:
        kind = dict(rows.dtypes)[session]
        schema = f"session_id {kind}, {_STEP}"
        if not looked:
            return rows.sparkSession.createDataFrame([], schema)
        told = rows.select(F.col(session).alias("session_id"), F.col(step).cast("long").alias("step"), *[calls[i].alias(f"call_{i}") for i in looked])
        policy, entries = self.policy, self.max_cache_entries
        takes = lambda n: policy.kind == "always" or (policy.kind == "threshold" and n >= policy.min_len)

        def tokens(call: dict, text: str, ids: str) -> bytes | list[int]:
            return bytes(call[text] or b"") if call[ids] is None else [int(x) for x in call[ids]]

        def execute(call: dict, cache: PrefixCache, prompts: dict[int, bytes]) -> dict:
            key, own = (call["model_id"], call["op_name"], call["max_tokens"], call["temp_milli"]), tokens(call, "text", "ids")
            used, state = 0, None
            if policy.kind != "never" and len(own):
                length, found = cache.lookup(key, own)
                if length and takes(length):
                    used, state = length, found
            left, handle, prompt = max(0, len(own) - used), len(prompts) + 1, bytes(call["prompt_text"] or b"")
            if call["rule"] == "vllm":
                before = prompts.get(state, b"")
                has = bool(before) and prompt.startswith(before)
                reused = len(before) if has else 0
                sent = (len(prompt) - reused if left > 0 else 0) if has else len(prompt)
                computed = sent
            else:
                has = state is not None
                reused = max(0, int(call["prompt_size"]) - left) if has else 0
                sent, computed = left if call["rule"] == "fake" else 0, left + max(0, int(call["max_tokens"]))
            prompts[handle] = _reusable(prompt)
            cache.insert(key, own, min(reused, len(own)) if reused > 0 else len(own), handle)
            return {"backend": call["backend"], "hit_len": used, "used_cached_state": has, "reused_prefix_len": reused, "tokens_sent": sent, "compute_steps": computed, "cache_size": len(cache)}

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            cache, prompts, out = PrefixCache(entries), {}, []
            for r in pdf.sort_values("step").to_dict("records"):
                records = {}
                for i in looked:
                    call = r[f"call_{i}"]
                    own = tokens(call, "given_text", "given_ids")
                    length, _ = cache.lookup((call["model_id"], call["op_name"], call["max_tokens"], call["temp_milli"]), own)
                    hit = bool(length) and takes(length)
                    saved = length if hit else 0
                    records[i] = {"session_id": r["session_id"], "step": r["step"], "node_id": i, "node_name": call["node_name"], "total_tokens": len(own), "cache_hit": hit, "prefix_hit_len": saved, "tokens_saved": saved}
                for i in plan:
                    records[i] |= execute(r[f"call_{i}"], cache, prompts)
                out += [records[i] for i in looked]
            return pd.DataFrame(out, columns=["session_id", *[c.split()[0] for c in _STEP.split(", ")]])

        return told.groupBy("session_id").applyInPandas(run, schema)


def session_metrics(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a result's steps: runs, lookups, hits, tokens saved and processed, hit_rate, token_reduction."""
    saved, processed = F.sum("tokens_saved"), F.sum(F.col("total_tokens") - F.col("tokens_saved"))
    hits = F.sum(F.col("cache_hit").cast("long"))
    return steps.groupBy(*(by or ["session_id"])).agg(
        F.count_distinct("step").alias("run_count"), F.count("*").alias("lookups"), hits.alias("hits"), saved.cast("long").alias("tokens_saved"), processed.cast("long").alias("tokens_processed"),
        ratio(hits, F.count("*")).alias("hit_rate"), ratio(saved, saved + processed).alias("token_reduction"),
    )
