"""Graphs, types, search, and helper expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataflow.functions import tensor, text
from strataflow.operators.backends import Backend, BackendRegistry, complete_with, http_client
from strataflow.plans import graph as g
from strataflow.plans import qa
from strataflow.plans.optimize import Optimizer, Param
from strataflow.plans.types import EffectType, SchemaType, TensorType, TokensType, is_subtype, meet


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def scheduled():
    out = g.Graph()
    a, b = out.add(g.Node("TensorOp", op_name="input")), out.add(g.Node("TensorOp", op_name="input"))
    out.add(g.Node("TensorOp", (a,), op_name="id"))
    out.add(g.Node("TokenOp", (a,), effect=g.NETWORK))
    out.add(g.Node("TensorOp", (b,), op_name="id", effect=g.IDEMPOTENT))
    out.add(g.Node("TokenOp", (b,), effect=g.MUTATING))
    return out


def test_schedule_puts_effects_first_and_alone():
    assert scheduled().schedule() == [[1, 2], [4], [6], [3, 5]]
    assert scheduled().topo_order() == [1, 2, 3, 4, 5, 6]


def test_cycles_and_missing_inputs_are_errors():
    x = g.Graph({1: g.Node("ToolOp", (2,), id=1), 2: g.Node("ToolOp", (1,), id=2)})
    with pytest.raises(g.GraphError):
        x.topo_order()
    with pytest.raises(g.GraphError):
        g.Graph({1: g.Node("ToolOp", (9,), id=1)}).topo_order()


def test_hash_and_round_trip():
    x = scheduled()
    assert g.Graph.from_json(x.to_json()).nodes == x.nodes
    assert x.subgraph([3]).structural_hash() != x.structural_hash()
    assert len(x.subgraph([6]).nodes) == 2
    y = scheduled()
    y.update(3, op_name="relu")
    assert y.structural_hash() != x.structural_hash()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_a_graph_or_an_error(t):
    try:
        g.Graph.from_json(t)
    except g.GraphError:
        pass


def test_rewrites():
    x = g.Graph()
    a = x.add(g.Node("ToolOp", tool_name="search", effect=3))
    b = x.add(g.Node("ToolOp", tool_name="search", effect=3))
    c = x.add(g.Node("TensorOp", (b,), op_name="id"))
    assert g.merge_tools(x).get(c).inputs == (a,)
    y = g.Graph()
    i = y.add(g.Node("TensorOp", op_name="input"))
    t1 = y.add(g.Node("TokenOp", (i,), debug_name="Answer: X"))
    t2 = y.add(g.Node("TokenOp", (i,), debug_name="Answer: Y"))
    u = y.add(g.Node("TensorOp", (t2,), op_name="id"))
    z = g.hoist_prefixes(y)
    assert z.get(t2).inputs == (t1,) and z.get(u).inputs == (t2,)
    w = g.Graph()
    k = w.add(g.Node("TokenOp", op_name="generate", out_type=SchemaType("{}", 1)))
    assert g.specialize_structured(g.specialize_structured(w)).get(k).op_name == "generate:structured"


def test_types():
    assert is_subtype(TensorType((16, 64)), TensorType((-1, 64))) and not is_subtype(TensorType((-1, 64)), TensorType((16, 64)))
    assert not is_subtype(TensorType((1,), "F16"), TensorType((1,)))
    assert meet(TensorType((16, -1)), TensorType((16, 32))).shape == (16, 32)
    assert meet(EffectType(3), EffectType(1)) == EffectType(1) and meet(TokensType(), SchemaType()) == EffectType(0)
    assert meet(TokensType("v", 5, "f"), TokensType("v", 3, "f")).max_len == 3


def test_checkpoint_and_resume(spark, tmp_path):
    x = g.Graph()
    a = x.add(g.Node("TensorOp", op_name="input"))
    b = x.add(g.Node("TensorOp", (a,), op_name="relu"))
    c = x.add(g.Node("TensorOp", (b, b), op_name="add"))
    rows = spark.sql("SELECT array(1f, -2f) AS v")
    g.checkpoint(x, rows, {a: "v"}, b, str(tmp_path / "c"))
    whole, rest = g.run(x, rows, {a: "v"}), g.resume(spark, str(tmp_path / "c"))
    assert rest.select(f"node_{c}").first() == whole.select(f"node_{c}").first()


def test_deep_graphs_have_levels_and_only_cycles_are_errors(spark):
    chain = [("deep", k + 1, k) for k in range(150)] + [("wide", 3, 1), ("wide", 3, 2), ("wide", 4, 3), ("wide", 4, 1), ("none", 8, 7)]
    nodes = [("deep", k) for k in range(151)] + [("wide", k) for k in range(1, 5)] + [("bare", 9)]
    edges = spark.createDataFrame(chain, "graph_id string, child long, parent long")
    table = spark.createDataFrame(nodes, "graph_id string, node_id long")
    got = {(r["graph_id"], r["node_id"]): r["level"] for r in g.levels(edges, table).collect()}
    assert got == {("deep", k): k for k in range(151)} | {("wide", 1): 0, ("wide", 2): 0, ("wide", 3): 1, ("wide", 4): 2, ("bare", 9): 0}
    roots = spark.createDataFrame([("deep", 150), ("wide", 3), ("bare", 9)], "graph_id string, node_id long")
    need = sorted([("deep", k) for k in range(151)] + [("wide", k) for k in (1, 2, 3)] + [("bare", 9)])
    assert sorted(map(tuple, g.reachable(edges, roots).collect())) == need
    turned = edges.union(spark.createDataFrame([("wide", 1, 4)], edges.schema))
    with pytest.raises(g.GraphError):
        g.levels(turned, table)


def test_program_is_traced_once(spark):
    calls = []

    @g.program
    def twice(x):
        calls.append(1)
        r = g.emit("TensorOp", (x,), op_name="relu")
        g.emit("TensorOp", (r, r), op_name="add")

    rows = spark.sql("SELECT array(1f, -2f) AS v")
    assert twice(rows, "v").first()["node_3"] == [2.0, 0.0]
    twice(rows, "v")
    assert len(calls) == 1
    with pytest.raises(g.GraphError):
        g.emit("TensorOp")


def test_tensors(spark):
    a, b = F.expr("array(-1f, 2f)"), F.expr("array(3f, 4f)")
    assert one(spark, tensor.relu(a)) == [0.0, 2.0]
    assert one(spark, tensor.add(a, b)) == [2.0, 6.0]
    assert sum(one(spark, tensor.softmax(b))) == pytest.approx(1)
    assert one(spark, tensor.add(F.expr("array(1f)"), b, broadcast=True)) == [4.0, 5.0]
    assert one(spark, tensor.linear(b, [[1.0, 2.0]], [0.5])) == [11.5]
    with pytest.raises(Exception, match="shapes differ"):
        one(spark, tensor.add(a, F.expr("array(1f)")))
    with pytest.raises(ValueError, match="unsupported"):
        tensor.apply("sigmoid", a)


def test_text(spark):
    assert one(spark, text.canonicalize(F.lit(" a \n\t b\x0b "))) == "a b\x0b"
    assert one(spark, text.byte_tokens(F.lit("é"))) == [195, 169] and one(spark, text.byte_tokens(F.lit(""))) == []
    assert one(spark, text.common_text_prefix(F.lit("abcd"), F.lit("abxd"))) == 2
    assert one(spark, text.common_array_prefix(F.expr("array(1,2)"), F.expr("array(1,2,3)"))) == 2
    assert one(spark, text.retrieve(F.lit("q"), 2)) == ["doc:q:0", "doc:q:1"] and one(spark, text.retrieve(F.lit("q"), 0)) == []
    assert one(spark, text.json_field(F.lit('{"text": "a\\"b"}'), "text")) == 'a\\"b'


def test_backends(spark):
    r = BackendRegistry()
    for name, p, t in (("token_low", 10, False), ("token_high", 50, False), ("tensor", 40, True)):
        r.register_backend(Backend(name, p, supports_tensor=t, supports_token=not t))
    assert r.select_backend("TokenOp").name == "token_high" and r.select_backend("TensorOp").name == "tensor"
    with pytest.raises(ValueError):
        r.select_backend("PromptOp")
    with pytest.raises(ValueError):
        r.register_backend(Backend("old", version=0))
    call = http_client(lambda request: '{"choices": [{"text": "' + request["prompt"].upper() + '"}]}', "m")
    rows = spark.sql("SELECT 'ab' AS prompt")
    assert complete_with(rows, Backend("x", complete=call)).first()["output"] == "AB"


def test_search_improves(spark):
    rows = spark.sql("SELECT * FROM VALUES (0.0D), (1.0D) AS v(x)")
    params = {"t": Param.tensor(initial=0.0), "c": Param.continuous(0.0, min_value=0, max_value=2), "d": Param.discrete(0, choices=[0, 1, 2]), "w": Param.text("bad", tokens=["bad", "good"])}
    out = lambda v: F.col("x") + v["t"] + v["c"] + v["d"] + v["w"].split().count("good")
    opt = Optimizer(out, lambda o: -F.pow(o - (F.col("x") + 5), F.lit(2)), params, seed=1)
    before = opt.score(rows)
    opt.fit(lambda: [rows], 3)
    assert opt.score(rows) > before and params["d"].value == 2


def test_qa_improves(spark):
    got = qa.benchmark(spark, (11,), 60, 1)
    assert got["baseline_mean"] <= got["optimized_mean"] < 1
