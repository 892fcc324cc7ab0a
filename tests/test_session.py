"""Sessions of graphs, backend routing, value bytes, numbering, tensors of any rank; the cache against its fast form."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataflow.functions import tensor, text
from strataflow.operators import backends, prefix
from strataflow.operators.session import ReusePolicy
from strataflow.plans import graph as g
from strataflow.plans.session import Session, session_metrics
from strataflow.sources import log, values
from strataflow.sources.numbering import number_rows
from strataflow.streaming.session_reuse import stream_reuse

COLS = "session_id string, step long, model_id string, op_name string, temperature float, max_tokens int, prompt string"


def token_graph(model="fake/m", n=1, **payload):
    out = g.Graph()
    i = out.add(g.Node("TensorOp", op_name="input"))
    for k in range(n):
        out.add(g.Node("TokenOp", (i,), op_name="generate", model_id=model, max_tokens=6, debug_name=f"t{k}", **payload))
    return out, i


def test_first_input_is_read_byte_by_byte(spark):
    out, i = token_graph()
    got = g.run(out, spark.sql("SELECT 'a  b' AS p"), {i: "p"}).first()["node_2"]
    raw = b"a  b"
    assert got == [raw[k % 4] + k + 97 for k in range(6)]


def test_the_registry_routes_token_operators(spark):
    out, i = token_graph("openai/m")
    r = backends.BackendRegistry()
    r.register_backend(backends.Backend("default", 10, supports_token=True, rule="openai"))
    r.register_backend(backends.Backend("plugin", 100, supports_token=True, complete=lambda prompts: [p.upper() for p in prompts]))
    rows = spark.sql("SELECT ' some  text' AS p")
    assert g.run(out, rows, {i: "p"}, registry=r).first()["node_2"] == "SOME TEXT"
    none = backends.BackendRegistry()
    none.register_backend(backends.Backend("tensors", 1, supports_tensor=True))
    with pytest.raises(ValueError):
        g.run(out, rows, {i: "p"}, registry=none)


def test_a_hit_reduces_work(spark):
    out, i = token_graph("openai/gpt", temperature=0.1)
    rows = spark.createDataFrame([("s", 0, [1, 2, 3, 4]), ("s", 1, [1, 2, 3, 4]), ("s", 2, [1, 2, 9]), ("z", 0, [1, 2])], "session_id string, step long, ids array<int>")
    done = Session().run(out, rows, {i: "ids"})
    steps = {(r["session_id"], r["step"]): r for r in done.steps.collect()}
    assert [steps["s", k]["prefix_hit_len"] for k in range(3)] == [0, 4, 2] and steps["z", 0]["prefix_hit_len"] == 0
    assert steps["s", 1]["compute_steps"] < steps["s", 0]["compute_steps"]
    assert steps["s", 1]["used_cached_state"] and not steps["s", 0]["used_cached_state"]
    outs = {(r["session_id"], r["step"]): r["node_2"] for r in done.values.collect()}
    assert outs["s", 0] == outs["s", 1] and len(outs["s", 2]) == 6
    m = {r["session_id"]: r for r in session_metrics(done.steps).collect()}
    assert (m["s"]["run_count"], m["s"]["hits"], m["s"]["tokens_saved"]) == (3, 2, 6)


def test_policies_and_operators_of_one_run(spark):
    out, i = token_graph(n=2)
    rows = spark.createDataFrame([("s", k, f"a shared beginning {k}") for k in range(4)], "session_id string, step long, p string")
    session = Session()
    always = session.run(out, rows, {i: "p"}).steps.toPandas().sort_values(["step", "node_id"])
    # Both look up before either has run, so in the first run the second finds nothing; when it runs, it does.
    # A reused prompt is stored up to the reused length only.
    assert always.prefix_hit_len.tolist() == [0, 0] + [19] * 6
    assert always.hit_len.tolist() == [0, 20] + [19] * 6
    session.set_policy(ReusePolicy.never())
    assert session.run(out, rows, {i: "p"}).steps.agg(F.sum("hit_len") + F.sum("tokens_saved")).first()[0] == 0
    session.set_policy(ReusePolicy.threshold(20))
    assert session.run(out, rows, {i: "p"}).steps.toPandas().sort_values(["step", "node_id"]).hit_len.tolist() == [0, 20] * 4
    assert Session().run(out, rows.limit(0), {i: "p"}).steps.count() == 0


def test_vllm_reuses_up_to_the_question(spark):
    out, i = token_graph("vllm/m")
    rows = spark.createDataFrame([("s", 0, "Context here. Question: one"), ("s", 1, "Context here. Question: two")], "session_id string, step long, p string")
    a, b = Session().run(out, rows, {i: "p"}).steps.orderBy("step").collect()
    n = len("Context here. Question:")
    assert (a["tokens_sent"], b["reused_prefix_len"], b["tokens_sent"]) == (27, n, 4)


def test_lone_operators_builders_and_tools(spark):
    assert spark.range(1).select(g.emit("TensorOp", (F.expr("array(-1f, 2f)"),), op_name="relu").alias("x")).first()["x"] == [0.0, 2.0]
    assert spark.range(1).select(g.eager_step("TensorOp", (F.expr("array(1f)"),)).alias("x")).first()["x"] == [1.0]
    b = g.GraphBuilder()
    i = b.add("TensorOp", op_name="input")
    c = b.add("TensorOp", op_name="const", attrs=(1, 2))
    s = b.add("TensorOp", (i, c), op_name="add")
    assert b.finalize().run(spark.sql("SELECT array(1f, 1f) AS v"), {i: "v"}).first()[f"node_{s}"] == [2.0, 3.0]

    @g.tool
    def shout(x):
        return F.upper(x)

    t = g.Graph()
    i = t.add(g.Node("PromptOp", template_id="hello"))
    k = t.add(g.Node("ToolOp", (i,), tool_name=shout.name))
    assert g.run(t, spark.range(1), {}, tools={"shout": shout}, templates={"hello": "hi"}).first()[f"node_{k}"] == "HI"

    @g.program
    def twice(x):
        g.emit("TensorOp", (x, x), op_name="add")

    assert twice.cir() is None
    twice(spark.sql("SELECT array(1f) AS v"), "v")
    assert len(twice.cir().nodes) == 2 and twice.compile("spark")["graph"] is twice.cir()


def test_a_default_tensor_backend_takes_tools(spark):
    t = g.Graph()
    a, b = t.add(g.Node("TensorOp", op_name="input")), t.add(g.Node("TensorOp", op_name="input"))
    k = t.add(g.Node("ToolOp", (a, b), tool_name="unknown"))
    c = t.add(g.Node("ControlOp", (a, b)))
    rows = spark.sql("SELECT 'x' AS p, 'y' AS q")
    bare = g.run(t, rows, {a: "p", b: "q"}).first()
    with_default = g.run(t, rows, {a: "p", b: "q"}, registry=backends.tensor_registry(spark)).first()
    assert (bare[f"node_{k}"], with_default[f"node_{k}"], with_default[f"node_{c}"]) == ("y", "x", "y")


def test_names_that_share_nothing_stay_apart():
    x = g.Graph()
    a, b = x.add(g.Node("TensorOp", op_name="input")), x.add(g.Node("TensorOp", op_name="input"))
    p, q = x.add(g.Node("TokenOp", (a,))), x.add(g.Node("TokenOp", (b,)))
    u = x.add(g.Node("TensorOp", (q,), op_name="id"))
    out = g.hoist_prefixes(x)
    assert out.get(u).inputs == (q,) and out.get(q).inputs == (b,) and p


ANY = st.one_of(
    st.text(max_size=20), st.floats(allow_nan=False), st.integers(-(2**63), 2**63 - 1), st.builds(values.Schema, st.text(max_size=20)),
    st.builds(values.Tokens, st.lists(st.integers(-(2**31), 2**31 - 1), max_size=9).map(tuple)),
    st.lists(st.floats(width=32, allow_nan=False), max_size=6).map(lambda x: values.Tensor((len(x),), tuple(x), "é")),
)


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_values_come_back(v):
    raw = values.to_bytes(v)
    assert values.from_bytes(raw) == v
    for wrong in (raw[:-1], raw + b"\x00", b"", b"\x63" + raw[1:]):
        with pytest.raises(values.ValueFormatError):
            values.from_bytes(wrong)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_are_a_value_or_an_error(raw):
    try:
        values.from_bytes(raw)
    except values.ValueFormatError:
        pass


def test_tensor_shapes_have_to_fit():
    with pytest.raises(values.ValueFormatError):
        values.to_bytes(values.Tensor((2, 2), (1.0,)))
    assert values.to_bytes(7) == b"\x06" + struct.pack("<q", 7)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbers_are_gapless_and_in_order(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 1, 2, 3]) if i % 3 else 1) for i in range(n)]
    numbered, total = number_rows(spark.createDataFrame(rows, "id long, k int").repartition(5), [F.col("k"), F.col("id")])
    got = sorted((r["row_number"], r["k"], r["id"]) for r in numbered.collect())
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert total == n and [(k, i) for _, k, i in got] == [(k, i) for i, k in want] and [x[0] for x in got] == list(range(n))


def nd(a):
    a = np.asarray(a, np.float32)
    shape = F.array(*[F.lit(d) for d in a.shape])
    return tensor.shaped(shape, F.array(*[F.lit(float(x)) for x in a.ravel()]))


@pytest.mark.parametrize("shape, dim", [((5,), 0), ((2, 3), 0), ((2, 3), -1), ((2, 3, 4), 1), ((2, 3, 4), -3)])
def test_softmax_along_an_axis(spark, shape, dim):
    a = np.random.default_rng(1).normal(0, 3, shape)
    e = np.exp(a - a.max(axis=dim, keepdims=True))
    got = spark.range(1).select(tensor.softmax_along(nd(a), dim).alias("t")).first()["t"]
    assert tuple(got["shape"]) == shape and np.allclose(got["data"], (e / e.sum(axis=dim, keepdims=True)).ravel(), atol=1e-5)


@pytest.mark.parametrize("p, q", [((3,), (3,)), ((2, 3), (3, 4)), ((3,), (3, 4)), ((2, 3), (3,)), ((5, 2, 3), (3, 4)), ((5, 1, 2, 3), (4, 3, 2)), ((2, 2, 3), (2, 3, 1))])
def test_products_of_any_rank(spark, p, q):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=p), rng.normal(size=q)
    want = np.matmul(a, b)
    got = spark.range(1).select(tensor.matmul_any(nd(a), nd(b)).alias("t")).first()["t"]
    assert tuple(got["shape"]) == (want.shape or (1,)) and np.allclose(got["data"], want.ravel(), atol=1e-4)


def test_tensors_that_do_not_fit_are_errors(spark):
    a, b = nd(np.ones((2, 3))), nd(np.ones((2, 4)))
    for wrong in (tensor.matmul_any(a, b), tensor.softmax_along(a, 2), tensor.apply("add", a, b, shaped=True), tensor.matmul_any(nd(np.ones((2, 2, 3))), nd(np.ones((3, 3, 3))))):
        with pytest.raises(Exception, match="differ|no such axis"):
            spark.range(1).select(wrong.alias("x")).collect()


def test_the_setting_names_the_tensor_backend(spark):
    assert backends.tensor_registry(spark).select_backend("TensorOp").name == "default"
    spark.conf.set(backends.TENSOR_SETTING, "arrow")
    try:
        r = backends.tensor_registry(spark)
        assert r.select_backend("TensorOp").name == "arrow"
        x = g.Graph()
        i = x.add(g.Node("TensorOp", op_name="input"))
        j = x.add(g.Node("TensorOp", (i,), op_name="softmax"))
        k = x.add(g.Node("TensorOp", (j, i), op_name="matmul"))
        rows = spark.sql("SELECT array(1f, 2f, 0.5f) AS v")
        one, two = (g.run(x, rows, {i: "v"}, registry=y).first()[f"node_{k}"] for y in (r, None))
        assert np.allclose(one, two)
    finally:
        spark.conf.unset(backends.TENSOR_SETTING)


@pytest.mark.parametrize("seed", range(4))
def test_sorted_prefixes_equal_the_cache(seed):
    rng = random.Random(seed)
    fast, exact = prefix.SortedPrefixes(), prefix.PrefixCache()
    for step in range(1, 60):
        tokens = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14)))
        policy, least = rng.choice([("always", 1), ("never", 1), ("threshold", 3)])
        key = rng.choice("kl")
        assert prefix.replay(fast, key, tokens, step, policy, least) == prefix.replay(exact, key, tokens, step, policy, least)


def test_compaction_changes_nothing():
    rng = random.Random(1)
    a, b = prefix.PrefixCache(40), prefix.PrefixCache(40)
    for step in range(400):
        tokens = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9)))
        b._compact()
        assert prefix.replay(a, "k", tokens, step) == prefix.replay(b, "k", tokens, step)
    assert len(b.depth) <= 40 * 9 + 1


@pytest.mark.parametrize("policy, entries", [(ReusePolicy.threshold(3), None), (ReusePolicy.always(), 30)])
def test_streams_with_a_cache_equal_batches(spark, tmp_path, policy, entries):
    rng = random.Random(7)
    rows = [(f"s{s}", i, "fake/m1", "generate", 0.0, 8, "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))) for s in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, COLS)
    for half in (0, 1):
        df.where((F.col("step") >= 10) == bool(half)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{half}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    name = f"cached_{policy.kind}"
    q = stream_reuse(stream, policy=policy, max_entries=entries).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    got = {(r["session_id"], r["step"]): r["hit_len"] for r in spark.table(name).collect()}
    want = prefix.sequential_reuse(df, policy.kind, policy.min_len, entries or 8192)
    assert got == {(r["session_id"], r["step"]): r["hit_len"] for r in want.collect()}


def test_small_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(ReusePolicy.threshold(3).should_attempt(F.lit(3))) and not one(ReusePolicy.threshold(3).should_attempt(F.lit(2)))
    assert one(ReusePolicy.always().should_attempt(F.lit(0))) and not one(ReusePolicy.never().should_attempt(F.lit(9)))
    key = lambda t, p: text.prefix_hash(F.lit("m"), F.lit("generate"), F.lit(8), text.temp_milli(F.lit(t)), F.lit(p).cast("binary"))
    assert one(key(0.1, "ab")) == one(key(0.1, "ab")) != one(key(0.2, "ab")) != one(key(0.2, "ac"))
    params = lambda t, n: F.struct(F.lit("generate").alias("op_name"), F.lit(t).alias("temperature"), F.lit(n).alias("max_tokens"))
    assert one(text.same_decode(params(0.1, 8), params(0.1000001, 8))) and not one(text.same_decode(params(0.1, 8), params(0.1, 9)))
    assert one(tensor.convert(F.expr("array(1, 2)"), F.expr("array(2L)")))["shape"] == [2]
    assert one(tensor.convert(F.expr("array(1)"), F.expr("cast(array() as array<bigint>)")))["shape"] == [1]
    assert one(text.general_number(F.lit(0.25))) == "0.25" and one(text.general_number(F.lit(3.0))) == "3" and one(text.general_number(F.lit(1234567.0))) == "1.23457e+06"
    spark.udtf.register("retrieve_documents", text.Retrieve)
    assert [tuple(r) for r in spark.sql("SELECT q, nth, doc FROM VALUES ('a'), ('b') AS v(q), LATERAL retrieve_documents(q, 2) ORDER BY 1, 2").collect()] == [("a", 0, "doc:a:0"), ("a", 1, "doc:a:1"), ("b", 0, "doc:b:0"), ("b", 1, "doc:b:1")]
    assert set(log.setup()) == set(log.NAMES) and all(len(x.handlers) == 1 for x in log.setup().values())
