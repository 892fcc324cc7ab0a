"""Prefix reuse: windows and the sequential cache against a plain model, streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators import prefix, session
from strataflow.plans import benchmarks
from strataflow.sources.prompts import conversation_prompts, session_prompts
from strataflow.streaming.session_reuse import stream_reuse

COLS = "session_id string, step long, model_id string, op_name string, temperature float, max_tokens int, prompt string"


def lcp(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_lookup_of_the_deepest_entry():
    c = prefix.PrefixCache()
    c.insert("k", [10, 20], 2, 1)
    c.insert("k", [10, 20, 30, 40], 4, 2)
    assert c.lookup("k", [10, 20, 30, 40, 50]) == (4, 2)
    assert c.lookup("other", [10, 20]) == (0, None)


def test_least_recently_used_goes():
    c = prefix.PrefixCache(2)
    for t in (1, 2):
        c.insert("k", [t], 1, t)
    c.lookup("k", [1])
    c.insert("k", [3], 1, 3)
    assert c.lookup("k", [2]) == (0, None)
    assert c.lookup("k", [1])[0] == c.lookup("k", [3])[0] == 1


def test_invalidate():
    c = prefix.PrefixCache()
    c.insert("k", [7, 8], 2, 1)
    c.insert("k", [7, 8, 9], 3, 1)
    c.insert("k", [5], 1, 2)
    c.invalidate(1)
    assert c.lookup("k", [7, 8, 9]) == (0, None)
    assert c.lookup("k", [5, 6]) == (1, 2)


def test_static_lookup_is_the_longest_common_prefix(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
    store, asked = [word() for _ in range(40)], [word() for _ in range(60)]
    s = spark.createDataFrame([("m", w.encode(), i) for i, w in enumerate(store)], "model_id string, prefix binary, handle long")
    q = spark.createDataFrame([("m", w.encode(), i) for i, w in enumerate(asked)], "model_id string, tokens binary, query_id long")
    got = {r["query_id"]: r for r in prefix.longest_prefix(s, q, ["model_id"]).collect()}
    for i, w in enumerate(asked):
        assert got[i]["hit_len"] == max(lcp(w, x) for x in store)
        if got[i]["hit_len"]:
            assert lcp(store[got[i]["handle"]], w) == got[i]["hit_len"]


def test_every_page_is_asked_against_all_others(spark):
    from strataflow.plans.catalogue import QUERIES

    pages = [(r["page_id"], r["url"].encode()) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = QUERIES["longest_prefix_pages"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted((i, max(lcp(u, v) for j, v in pages if j != i)) for i, u in pages)


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_rows_find_others_but_not_themselves(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice("kl"), bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7)))) for i in range(n)]
    df = spark.createDataFrame(rows, "query_id long, model_id string, tokens binary").repartition(7)
    got = prefix.longest_prefix_of_others(df, ["model_id"]).collect()
    best = {i: max((lcp(t, u) for j, l, u in rows if j != i and l == k), default=0) for i, k, t in rows}
    assert {r["query_id"]: r["hit_len"] for r in got} == best and len(got) == n
    held = {i: (k, t) for i, k, t in rows}
    for r in got:
        if r["hit_len"]:
            (k, t), (l, u) = held[r["query_id"]], held[r["handle"]]
            assert r["handle"] != r["query_id"] and k == l and lcp(t, u) == r["hit_len"]
        else:
            assert r["handle"] is None



@pytest.mark.parametrize("seed", range(3))
def test_window_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{s}", i, "fake/m1", "generate", 0.0, 8, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 12)))) for s in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, COLS)
    a = {(r["session_id"], r["step"]): r["hit_len"] for r in prefix.session_reuse(df).collect()}
    b = {(r["session_id"], r["step"]): r["hit_len"] for r in prefix.sequential_reuse(df).collect()}
    assert a == b


@pytest.mark.parametrize("policy, saved", [(session.ReusePolicy.always(), 675), (session.ReusePolicy.threshold(10), 675), (session.ReusePolicy.threshold(35), 675), (session.ReusePolicy.threshold(40), 0), (session.ReusePolicy.never(), 0)])
def test_published_session_counts(spark, policy, saved):
    m = benchmarks.session(spark, policy=policy).first()
    assert (m["tokens_saved"], m["tokens_processed"], m["hits"]) == (saved, 1081 - saved, 19 if saved else 0)


def test_temperature_is_part_of_the_key(spark):
    rows = [("s", i, "m", "generate", t, 8, "same prompt") for i, t in enumerate((0.1, 0.9, 0.1))]
    got = {r["step"]: r["hit_len"] for r in prefix.session_reuse(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {0: 0, 1: 0, 2: 11}


def test_metadata_round_trip(spark, tmp_path):
    store = prefix.cache_after(session_prompts(spark, 3))
    prefix.save_metadata(store, str(tmp_path / "m"))
    assert prefix.load_metadata(spark, str(tmp_path / "m")).count() == store.count()
    assert prefix.load_metadata(spark, str(tmp_path / "none")) is None
    assert prefix.evict(store, 5, ["session_id"]).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    prompts = conversation_prompts(spark, "/root/testdata/sf0.001")
    prompts.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = stream_reuse(spark.readStream.schema(prompts.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("reuse").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("reuse").select("session_id", "model_id", "step", "hit_len").collect()))
    want = prefix.session_reuse(prompts).select(F.col("session_id").cast("string"), "model_id", "step", "hit_len")
    assert got == sorted(map(tuple, want.collect()))
