"""Session reuse over a stream of prompts: state for each session, in the order of arrival.

A micro-batch's prompts are taken by step; steps that come late are taken when they come. The state of the policy
that always reuses is the first prompt of each key and first byte, so it does not grow with the session; that of
the other policies, and of a bounded cache, is the exact cache, which the bound on its entries bounds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataflow.operators.prefix import KEY, PrefixCache, keyed, replay, shared_length
from strataflow.operators.session import ReusePolicy

_OUT = "session_id string, model_id string, op_name string, max_tokens int, temp_milli int, step long, total_tokens int, hit_len int"


def stream_reuse(prompts: DataFrame, idle_ms: int | None = None, policy: ReusePolicy | None = None, max_entries: int | None = None) -> DataFrame:
    """Each prompt of a stream with its reuse. idle_ms: a session's state goes after so long without prompts.

    Without max_entries the policy that always reuses needs no cache; other policies have 8192 entries then.
    """
    policy = policy or ReusePolicy.always()
    if policy.kind != "always" or max_entries is not None:
        return _cached(prompts, idle_ms, policy, max_entries or 8192)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    rows = keyed(prompts).selectExpr("cast(session_id as string) session_id", *KEY, "step", "tokens", "total_tokens")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        firsts, leaders = state.get if state.exists else ([], [])
        known = dict(zip(firsts, map(bytes, leaders), strict=True))
        out = []
        for r in pd.concat(list(batches)).sort_values("step").itertuples():
            tokens, hit = bytes(r.tokens), 0
            if tokens:
                hit = shared_length(tokens, known[tokens[0]]) if tokens[0] in known else 0
                known.setdefault(tokens[0], tokens)
            out.append((*key, r.step, r.total_tokens, hit))
        state.update((list(known), list(known.values())))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return rows.groupBy("session_id", *KEY).applyInPandasWithState(step, _OUT, "firsts array<int>, leaders array<binary>", "append", timeout)


def _cached(prompts: DataFrame, idle_ms: int | None, policy: ReusePolicy, max_entries: int) -> DataFrame:
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    rows = keyed(prompts).selectExpr("cast(session_id as string) session_id", *KEY, "step", "tokens", "total_tokens")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cache, steps = PrefixCache(max_entries), 0
        if state.exists:
            held, steps = state.get
            cache.__dict__.update(pickle.loads(held))
        out = []
        for r in pd.concat(list(batches)).sort_values("step").itertuples():
            steps += 1
            done = replay(cache, tuple(getattr(r, k) for k in KEY), bytes(r.tokens), steps, policy.kind, policy.min_len, int(r.max_tokens))
            out.append((*key, *[getattr(r, k) for k in KEY], r.step, r.total_tokens, done["hit_len"]))
        state.update((pickle.dumps(cache.__dict__), steps))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return rows.groupBy("session_id").applyInPandasWithState(step, _OUT, "cache binary, steps long", "append", timeout)
