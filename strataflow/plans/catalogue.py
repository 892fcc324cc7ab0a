"""The registered queries of the engine's own operators, with the SQL they are checked against.

Row ids of the operator inventory stand beside each query. Small inputs that exist in no table are VALUES lists,
the same in both languages. Floats are rounded to four digits on both sides, as sums differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import generators, tensor, text
from strataflow.operators import prefix
from strataflow.operators.backends import Backend, BackendRegistry, select_by_priority
from strataflow.operators.session import ReusePolicy, metrics, reuse
from strataflow.plans import benchmarks, graph, nn, qa, types
from strataflow.plans.optimize import Optimizer, Param, scores
from strataflow.plans.session import Session, session_metrics
from strataflow.sources.prompts import conversation_prompts
from strataflow.sources.qa import CAPITALS, CONTEXTS, QUESTIONS, batched, qa_rows, split_train_test, wordings
from strataflow.sources.values import bytes_column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column) -> Column:
    return c.cast("long")


#: DuckDB's canonical text of a column t, its bytes as hex, and the common prefix of two hex texts in bytes.
_CANON = "trim(regexp_replace({0}, '[ ' || chr(10) || chr(9) || chr(13) || ']+', ' ', 'g'))"
_HEX = "hex(encode({0}))"
_LCP = "coalesce(list_min(list_filter(range(0, CAST(least(length({0}), length({1})) // 2 AS BIGINT)), lambda i: substr({0}, CAST(2 * i + 1 AS BIGINT), 2) <> substr({1}, CAST(2 * i + 1 AS BIGINT), 2))), CAST(least(length({0}), length({1})) // 2 AS BIGINT))"


# Text functions -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(octet_length(encode(c)) AS BIGINT) AS n_bytes, md5(c) AS digest FROM (SELECT doc_id, {_CANON.format('text')} AS c FROM documents)")
def canonicalize_documents(spark, sf_dir):  # F1, F2
    c = text.canonicalize(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", _long(text.token_count(c)).alias("n_bytes"), F.md5(F.encode(c, "UTF-8")).alias("digest"))


@query(
    f"SELECT conv_id, turn, CAST(length(h) // 2 AS BIGINT) AS n_tokens, CAST(coalesce(list_sum(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER))), 0) AS BIGINT) AS token_sum "
    f"FROM (SELECT conv_id, turn, {_HEX.format("coalesce(text, '')")} AS h FROM conversations)"
)
def byte_token_stats(spark, sf_dir):  # F2
    rows = _table(spark, sf_dir, "conversations").withColumn("t", text.byte_tokens(F.coalesce("text", F.lit(""))))
    return rows.select("conv_id", "turn", _long(F.size("t")).alias("n_tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"))


@query(
    "SELECT n_nationkey, 'what is in ' || n_name || ' of ' || r_name AS prompt, 'critique: ' || n_name AS critique, n_name || ' | ' || r_name AS refined, 'm1:' || n_name AS echoed, "
    "CASE WHEN n_nationkey % 2 = 0 THEN 'math' ELSE 'no_math' END AS label, n_name AS expr, CAST(n_nationkey AS VARCHAR) AS shown FROM nation JOIN region ON r_regionkey = n_regionkey"
)
def prompt_helpers(spark, sf_dir):  # F4-F10
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    asked = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("MATH of "), "n_name")).otherwise(F.col("n_name"))
    return rows.select(
        "n_nationkey", text.format_prompt(F.lit("what is in"), F.col("n_name"), F.lit("of"), F.col("r_name")).alias("prompt"), text.critique_prompt(F.col("n_name")).alias("critique"),
        text.refine(F.col("n_name"), F.col("r_name")).alias("refined"), text.lm("m1", F.col("n_name")).alias("echoed"), text.classify(asked, F.array(F.lit("math"), F.lit("no_math"))).alias("label"),
        text.extract_expr(F.col("n_name")).alias("expr"), text.format_value(F.col("n_nationkey")).alias("shown"),
    )


@query("SELECT c_custkey, i AS nth, 'doc:' || c_name || ':' || i AS doc FROM customer, unnest(range(0, 4)) AS u(i)")
def retrieve_documents(spark, sf_dir):  # S5
    return _table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(text.retrieve(F.col("c_name"), 4)).alias("nth", "doc")).select("c_custkey", _long(F.col("nth")).alias("nth"), "doc")


_CONTEXTS = (
    "(1, 'Guide: The capital of France is Paris. Note: The capital of New Land is Old Town.'), (2, 'no pairs here'), (3, 'It is known: the answer is Rome.'), "
    "(4, 'The capital of Italy is Rome'), (5, ''), (6, 'this is  spaced .')"
)


@query(
    f"SELECT id, CASE WHEN contains(context, 'is ') THEN regexp_replace(trim(list_last(string_split(context, 'is '))), '\\.$', '') ELSE 'unknown' END AS answer, "
    "coalesce(array_to_string(list_transform(list_zip(regexp_extract_all(context, 'The capital of ([A-Za-z ]+) is ([A-Za-z ]+)', 1), regexp_extract_all(context, 'The capital of ([A-Za-z ]+) is ([A-Za-z ]+)', 2)), lambda p: trim(p[1]) || '=' || trim(p[2])), ','), '') AS pairs "
    f"FROM (VALUES {_CONTEXTS}) AS v(id, context)"
)
def answers_and_pairs(spark, sf_dir):  # F11, F13
    rows = spark.sql(f"SELECT * FROM VALUES {_CONTEXTS} AS v(id, context)")
    pairs = F.array_join(F.transform(text.capital_pairs(F.col("context")), lambda p: F.concat(p["country"], F.lit("="), p["capital"])), ",")
    return rows.select("id", text.answer_from_context(F.col("context")).alias("answer"), pairs.alias("pairs"))


@query(
    "SELECT conv_id, turn, CAST(octet_length(encode(CASE WHEN regexp_matches(p, '(?s)^.* Question:') THEN regexp_extract(p, '(?s)^(.*) Question:', 0) ELSE p END)) AS BIGINT) AS reusable "
    "FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' Question: what of ' || role ELSE text END AS p FROM conversations)"
)
def reusable_prefixes(spark, sf_dir):  # F12
    p = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" Question: what of "), "role")).otherwise(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", _long(F.octet_length(text.reusable_prefix(p))).alias("reusable"))


@query(
    "SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS digest FROM conversations"
)
def json_escapes(spark, sf_dir):  # F17
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.encode(text.json_escape(F.col("text")), "UTF-8")).alias("digest"))


@query("SELECT event_id, json_extract_string('{\"id\": ' || event_id || ', \"props\": ' || props || ', \"text\": \"' || event_type || '\", \"more\": \"x\"}', '$.text') AS field FROM events")
def json_fields(spark, sf_dir):  # F18
    body = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit(', "text": "'), "event_type", F.lit('", "more": "x"}'))
    return _table(spark, sf_dir, "events").select("event_id", text.json_field(body, "text").alias("field"))


@query("SELECT event_type, coalesce(quantile_cont(value, 0.5), 0) AS p50, coalesce(quantile_cont(value, 0.95), 0) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):  # F19
    v = F.col("value")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(text.percentile(v, 50).alias("p50"), text.percentile(v, 95).alias("p95"), F.count("*").alias("n"))


@query("SELECT r_name, avg(CASE WHEN n_nationkey % 3 = 0 OR lower(n_name) = lower(r_name) THEN 1.0 ELSE 0.0 END) AS em FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def exact_match_rate(spark, sf_dir):  # F16, O10: every third answer is right but for case and blanks
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    said = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lower("n_name"), F.lit(" \n"))).otherwise(F.col("r_name"))
    return rows.groupBy("r_name").agg(F.avg(text.exact_match(F.concat(F.lit(" "), F.upper(said)), F.col("n_name"))).alias("em"))


@query("SELECT CAST(t AS DOUBLE) AS t, m FROM (VALUES (0.29, 290), (0.1, 100), (0.7, 700), (1.0, 1000)) AS v(t, m)")
def temperature_keys(spark, sf_dir):  # F21
    return spark.sql("SELECT * FROM VALUES (0.29BD), (0.1BD), (0.7BD), (1.0BD) AS v(t)").select(F.col("t").cast("double").alias("t"), text.temp_milli(F.col("t")).alias("m"))


# Tensors --------------------------------------------------------------------------------------------------


@query(
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0.0))), 4) AS relu_sum, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS squared, "
    "round(2 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS doubled FROM embeddings"
)
def vector_relu_add_mul(spark, sf_dir):  # T1, T2, T4, T6
    e = F.col("embedding")
    total = lambda a: F.round(F.aggregate(F.transform(a, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x), 4)
    return _table(spark, sf_dir, "embeddings").select("vec_id", total(tensor.relu(tensor.identity(e))).alias("relu_sum"), F.round(tensor.dot(e, e), 4).alias("squared"), total(tensor.add(e, e)).alias("doubled"))


@query(
    "SELECT vec_id, round(list_max(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - m) / s)), 4) AS top, round(list_sum(list_transform(embedding, lambda x, i: i * CAST(CAST(exp(CAST(x AS DOUBLE) - m) / s AS FLOAT) AS DOUBLE))), 3) AS centre FROM "
    "(SELECT vec_id, embedding, m, list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - m))) AS s FROM (SELECT vec_id, embedding, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings))"
)
def vector_softmax(spark, sf_dir):  # T3
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", tensor.softmax(F.col("embedding")).alias("s"))
    centre = F.aggregate(F.transform("s", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(F.array_max("s").cast("double"), 4).alias("top"), F.round(centre, 3).alias("centre"))


@query(
    "WITH c AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT *, i // 16 AS a, (i // 4) % 4 AS b, i % 4 AS c FROM c) "
    "SELECT vec_id, round(sum((i + 1) * CAST(CAST(s AS FLOAT) AS DOUBLE)), 3) AS centre FROM (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id, a, c) AS s FROM m) GROUP BY vec_id"
)
def softmax_axis(spark, sf_dir):  # T3: vectors as tensors 4 x 4 x 4, along the middle axis, by a graph node's attribute
    g = graph.Graph()
    a = g.add(graph.Node("TensorOp", op_name="input"))
    g.add(graph.Node("TensorOp", (a,), op_name="softmax", attrs=(1,)))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", tensor.shaped(F.array(F.lit(4), F.lit(4), F.lit(4)), F.col("embedding")).alias("t"))
    centre = F.aggregate(F.transform("node_2.data", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return graph.run(g, rows, {a: "t"}).select("vec_id", F.round(centre, 3).alias("centre"))


@query(
    "WITH c AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT vec_id, x, i // 16 AS n, (i // 4) % 4 AS r, i % 4 AS k FROM c) "
    "SELECT vec_id, round(sum((16 * n + 4 * r + k + 1) * CAST(CAST(v AS FLOAT) AS DOUBLE)), 3) AS total, '4,4,4' AS shape FROM (SELECT p.vec_id, p.n, p.r, q.k, sum(p.x * q.x) AS v FROM m p JOIN m q ON q.vec_id = p.vec_id AND q.n = 1 AND q.r = p.k GROUP BY p.vec_id, p.n, p.r, q.k) GROUP BY vec_id"
)
def matmul_batched(spark, sf_dir):  # T5: four matrices of each vector by its second one
    cube, square = F.array(F.lit(4), F.lit(4), F.lit(4)), F.array(F.lit(4), F.lit(4))
    e = F.col("embedding")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", tensor.apply("matmul", tensor.shaped(cube, e), tensor.shaped(square, F.slice(e, 17, 16)), shaped=True).alias("m"))
    total = F.aggregate(F.transform("m.data", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(total, 3).alias("total"), F.array_join(F.col("m.shape").cast("array<string>"), ",").alias("shape"))


@query("SELECT * FROM (VALUES ('add', 0.0), ('relu', 0.0), ('softmax', 0.0), ('mul', 0.0), ('matmul', 0.0)) AS v(op, d)".replace("SELECT *", "SELECT op, CAST(d AS DOUBLE) AS max_abs_diff"))
def tensor_parity(spark, sf_dir):  # Q7, T10: expressions against Arrow batches
    return benchmarks.tensor_parity(spark).select("op", F.round("max_abs_diff", 6).alias("max_abs_diff"))


@query(
    "SELECT event_id, '06' || (SELECT string_agg(lpad(hex((event_id >> (8 * b)) & 255), 2, '0'), '' ORDER BY b) FROM range(0, 8) AS r(b)) AS id_bytes, "
    "'04' || lpad(hex(length(event_type)), 2, '0') || '00000000000000' || hex(encode(event_type)) AS type_bytes FROM events"
)
def value_bytes(spark, sf_dir):  # S10: integers and texts as tagged bytes
    rows = _table(spark, sf_dir, "events")
    return rows.select("event_id", F.hex(bytes_column(F.col("event_id"), "integer")).alias("id_bytes"), F.hex(bytes_column(F.col("event_type"), "text")).alias("type_bytes"))


@query(
    "SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def vector_dot_next(spark, sf_dir):  # T5
    a = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(tensor.dot(F.col("embedding"), F.col("other")), 4).alias("dot"))


@query(
    "SELECT vec_id, round(CAST(CAST(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (((i - 1) * 7) % 5 - 2) / 4)) + 0.25 AS FLOAT) AS DOUBLE), 4) AS y0, "
    "round(CAST(CAST(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (((i - 1) * 3) % 7 - 3) / 2)) - 1 AS FLOAT) AS DOUBLE), 4) AS y1 FROM embeddings"
)
def linear_layer(spark, sf_dir):  # T12
    weights = [[((k * 7) % 5 - 2) / 4 for k in range(64)], [((k * 3) % 7 - 3) / 2 for k in range(64)]]
    y = tensor.linear(F.col("embedding"), weights, [0.25, -1.0])
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(y[0].cast("double"), 4).alias("y0"), F.round(y[1].cast("double"), 4).alias("y1"))


@query(
    "WITH c AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS k FROM embeddings) "
    "SELECT a.k AS i, b.k AS j, round(sum(CAST(a.v AS DOUBLE) * b.v), 3) + 0.0 AS v FROM c a JOIN c b USING (vec_id) GROUP BY a.k, b.k"
)
def matmul_coo(spark, sf_dir):  # T5: the product of the transposed table with itself, one partial matrix a task
    rows = _table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("e"))
    cells = rows.select("e", F.posexplode("e").alias("i", "a")).select("i", "a", F.posexplode("e").alias("j", "b"))
    return cells.groupBy(_long(F.col("i")).alias("i"), _long(F.col("j")).alias("j")).agg((F.round(F.sum(F.col("a").cast("double") * F.col("b").cast("double")), 3) + F.lit(0.0)).alias("v"))


@query("SELECT * FROM (VALUES (1, CAST(4.0 AS DOUBLE), CAST(6.0 AS DOUBLE), CAST(11.0 AS DOUBLE), CAST(58.0 AS DOUBLE))) AS v(id, sum_0, sum_1, dot, cell)")
def tensor_goldens(spark, sf_dir):  # T4, T5, T8
    a, b = F.expr("array(1f, 2f)"), F.expr("array(3f, 4f)")
    m = tensor.matmul(F.expr("array(1f, 2f, 3f, 4f, 5f, 6f)"), F.expr("array(7f, 8f, 9f, 10f, 11f, 12f)"), 2, 3, 2)
    out = spark.sql("SELECT 1 AS id").withColumn("s", tensor.apply("add", a, b)).withColumn("d", tensor.apply("matmul", a, b)).withColumn("m", m)
    return out.select("id", F.col("s")[0].cast("double").alias("sum_0"), F.col("s")[1].cast("double").alias("sum_1"), F.col("d")[0].cast("double").alias("dot"), F.col("m")[0].cast("double").alias("cell"))


# Generators and backends ----------------------------------------------------------------------------------


def _generated(name: str) -> tuple[Query, str]:
    rule = generators.RULES[name]

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = generators.run(name, F.col("text"), 16)["output"]
        return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(out.cast("array<string>"), ",").alias("tokens"))

    source = _CANON.format("text") if rule.canonical else "text"
    byte = "CAST('0x' || substr(h, CAST(2 * (i % (length(h) // 2)) + 1 AS BIGINT), 2) AS INTEGER)"
    token = f"(({byte} + {rule.salt}) % {rule.modulus})" if rule.salted_text else f"coalesce({byte}, 0)"
    read = source if rule.canonical else f"CASE WHEN {source} = '' THEN ' ' ELSE {source} END"
    sql = (
        f"SELECT conv_id, turn, array_to_string(list_transform(range(0, 16), lambda i: ({token} + i + {rule.salt}) % {rule.modulus}), ',') AS tokens "
        f"FROM (SELECT conv_id, turn, {_HEX.format(read)} AS h FROM conversations)"
    )
    return fn, sql


for _name in generators.RULES:
    QUERIES[f"{_name}_tokens"], ORACLE_SQL[f"{_name}_tokens"] = _generated(_name)  # B1-B4

_BACKENDS = "('token_low', 10, false, true), ('token_high', 50, false, true), ('tensor', 40, true, false)"


@query("SELECT * FROM (VALUES (1, 'TokenOp', 'token_high'), (2, 'TensorOp', 'tensor'), (3, 'PromptOp', NULL)) AS v(node_id, kind, backend)")
def backend_select(spark, sf_dir):  # registry
    backends = spark.sql(f"SELECT * FROM VALUES {_BACKENDS} AS v(name, priority, supports_tensor, supports_token)")
    nodes = spark.sql("SELECT * FROM VALUES (1, 'TokenOp'), (2, 'TensorOp'), (3, 'PromptOp') AS v(node_id, kind)")
    return select_by_priority(backends, nodes)


# Prefix reuse ---------------------------------------------------------------------------------------------


@query(
    f"WITH q AS (SELECT doc_id, {_HEX.format("coalesce(text, '')")} AS h FROM documents), s AS (SELECT {_HEX.format("coalesce(text, '')")} AS h FROM benchmark) "
    f"SELECT doc_id, CAST(max({_LCP.format('q.h', 's.h')}) AS BIGINT) AS hit_len FROM q, s GROUP BY doc_id"
)
def longest_prefix_static(spark, sf_dir):  # C2a: every document against all stored test items
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    store = _table(spark, sf_dir, "benchmark").select(F.lit("m").alias("model_id"), raw.alias("prefix"), F.col("item_id").alias("handle"))
    asked = _table(spark, sf_dir, "documents").select(F.lit("m").alias("model_id"), raw.alias("tokens"), F.col("doc_id").alias("query_id"))
    return prefix.longest_prefix(store, asked, ["model_id"]).select(F.col("query_id").alias("doc_id"), _long(F.col("hit_len")).alias("hit_len"))


@query(
    f"WITH u AS (SELECT page_id, {_HEX.format('url')} AS h FROM pages) SELECT q.page_id, CAST(max({_LCP.format('q.h', 's.h')}) AS BIGINT) AS hit_len FROM u q JOIN u s ON s.page_id <> q.page_id GROUP BY q.page_id"
)
def longest_prefix_pages(spark, sf_dir):  # C2a: every page against all others
    rows = _table(spark, sf_dir, "pages").select(F.lit("m").alias("model_id"), F.col("page_id").alias("query_id"), F.encode("url", "UTF-8").alias("tokens"))
    return prefix.longest_prefix_of_others(rows, ["model_id"]).select(F.col("query_id").alias("page_id"), _long(F.col("hit_len")).alias("hit_len"))


_STEPS = (
    f"WITH c AS (SELECT conv_id, turn, role, {_HEX.format(_CANON.format('text'))} AS h FROM conversations), "
    "f AS (SELECT *, first_value(h) OVER w AS lead, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY conv_id, role, substr(h, 1, 2) ORDER BY turn)), "
    f"s AS (SELECT conv_id, turn, role, CAST(length(h) // 2 AS BIGINT) AS total_tokens, CAST(CASE WHEN n = 1 THEN 0 ELSE {_LCP.format('h', 'lead')} END AS BIGINT) AS hit_len FROM f) "
)


@query(_STEPS + "SELECT conv_id, turn, role, total_tokens, hit_len, hit_len > 0 AS cache_hit FROM s")
def session_reuse_steps(spark, sf_dir):  # C2b, M2, M3
    steps = reuse(conversation_prompts(spark, sf_dir))
    return steps.select(F.col("session_id").alias("conv_id"), F.col("step").alias("turn"), F.col("model_id").alias("role"), _long(F.col("total_tokens")).alias("total_tokens"), _long(F.col("hit_len")).alias("hit_len"), "cache_hit")


@query(
    _STEPS + "SELECT role, count(*) AS lookups, CAST(sum(CAST(hit_len > 0 AS BIGINT)) AS BIGINT) AS hits, CAST(sum(hit_len) AS BIGINT) AS tokens_saved, CAST(sum(total_tokens - hit_len) AS BIGINT) AS tokens_processed, "
    "coalesce(round(sum(CAST(hit_len > 0 AS BIGINT)) / count(*), 6), 0) AS hit_rate, coalesce(round(sum(hit_len) / nullif(sum(total_tokens), 0), 6), 0) AS token_reduction FROM s GROUP BY role"
)
def session_reuse_metrics(spark, sf_dir):  # M4, F23: the flagship
    out = metrics(reuse(conversation_prompts(spark, sf_dir)), ["model_id"]).withColumnRenamed("model_id", "role")
    return out.withColumn("hit_rate", F.round("hit_rate", 6)).withColumn("token_reduction", F.round("token_reduction", 6))


@query("SELECT count(*) AS lookups, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS tokens_saved FROM conversations")
def policy_never(spark, sf_dir):  # M5
    out = metrics(reuse(conversation_prompts(spark, sf_dir), ReusePolicy.never()), [])
    return out.select("lookups", "hits", "tokens_saved")


#: A session's prompts one after another; stored are those that were not reused, so the longest prefix is among them.
_THRESHOLD = (
    f"WITH RECURSIVE c AS (SELECT conv_id, role, {_HEX.format(_CANON.format('text'))} AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), "
    "hit AS (SELECT conv_id, role, h, n, CAST(0 AS BIGINT) AS hit_len, [{'role': role, 'h': h}] AS stored FROM c WHERE n = 1 UNION ALL "
    "SELECT conv_id, role, h, n, CASE WHEN best >= 5 THEN best ELSE 0 END, CASE WHEN best >= 5 THEN stored ELSE list_append(stored, {'role': role, 'h': h}) END FROM ("
    f"SELECT c.conv_id, c.role, c.h, c.n, p.stored, coalesce(list_max(list_transform(list_filter(p.stored, lambda s: s.role = c.role), lambda s: {_LCP.format('c.h', 's.h')})), 0) AS best "
    "FROM hit p JOIN c ON c.conv_id = p.conv_id AND c.n = p.n + 1)) "
)


@query(
    _THRESHOLD + "SELECT conv_id AS session_id, count(*) AS lookups, CAST(sum(CAST(hit_len > 0 AS BIGINT)) AS BIGINT) AS hits, CAST(sum(hit_len) AS BIGINT) AS tokens_saved, "
    "CAST(sum(length(h) // 2 - hit_len) AS BIGINT) AS tokens_processed, round(sum(CAST(hit_len > 0 AS BIGINT)) / count(*), 6) AS hit_rate, coalesce(round(sum(hit_len) / nullif(sum(length(h) // 2), 0), 6), 0) AS token_reduction FROM hit GROUP BY conv_id"
)
def policy_threshold(spark, sf_dir):  # C2c, M5
    out = metrics(reuse(conversation_prompts(spark, sf_dir), ReusePolicy.threshold(5)), ["session_id"])
    return out.withColumn("hit_rate", F.round("hit_rate", 6)).withColumn("token_reduction", F.round("token_reduction", 6))


@query()
def lru_eviction(spark, sf_dir):  # C3
    return metrics(reuse(conversation_prompts(spark, sf_dir), ReusePolicy.always(), max_entries=256), ["session_id"])


@query("SELECT * FROM (VALUES ('warm', CAST(4 AS BIGINT), CAST(5 AS BIGINT), CAST(0.8 AS DOUBLE), 36), ('cold', CAST(5 AS BIGINT), CAST(5 AS BIGINT), CAST(1.0 AS DOUBLE), 40)) AS v(phase, hits, steps, hit_rate, cache_size)")
def cold_start(spark, sf_dir):  # Q5, S7, S8
    return benchmarks.cold_start(spark)


@query("SELECT CAST(31526.0 AS DOUBLE) AS ms_no_cache, CAST(7526.0 AS DOUBLE) AS ms_with_cache, CAST(0.8 AS DOUBLE) AS hit_rate, round(CAST(24000.0 AS DOUBLE) / 31526, 6) AS latency_reduction, true AS meets_hit_target, true AS meets_latency_target")
def deterministic_benchmark(spark, sf_dir):  # Q1
    return benchmarks.deterministic_totals(spark).withColumn("latency_reduction", F.round("latency_reduction", 6))


@query("SELECT 'bench' AS session_id, CAST(20 AS BIGINT) AS lookups, CAST(19 AS BIGINT) AS hits, CAST(675 AS BIGINT) AS tokens_saved, CAST(406 AS BIGINT) AS tokens_processed, CAST(0.95 AS DOUBLE) AS hit_rate, round(CAST(675 AS DOUBLE) / 1081, 6) AS token_reduction")
def session_benchmark(spark, sf_dir):  # Q4
    return benchmarks.session(spark).withColumn("token_reduction", F.round("token_reduction", 6))


_PAIRED = "3000 + length(chr(10) || 'Question: Summarize cache behavior.')"


@query(
    f"SELECT ({_PAIRED} + 1) * 2.0 AS p50_no_cache, CAST(2.0 AS DOUBLE) AS p50_with_cache, ({_PAIRED} + 1) * 2.0 AS p95_no_cache, CAST(2.0 AS DOUBLE) AS p95_with_cache, "
    f"CAST(1.0 AS DOUBLE) AS token_reduction, round(2.0 / (({_PAIRED} + 1) * 2.0), 6) AS latency_ratio".replace("AS p50_no_cache", "::DOUBLE AS p50_no_cache").replace("AS p95_no_cache", "::DOUBLE AS p95_no_cache")
)
def paired_benchmark(spark, sf_dir):  # Q3
    return benchmarks.paired(spark).withColumn("latency_ratio", F.round("latency_ratio", 6))


# Graphs ---------------------------------------------------------------------------------------------------

_NODES = "('g', 1, 'search', 1, 3), ('g', 2, 'search', 1, 3), ('g', 3, 'read', 2, 3), ('g', 4, 'read', 2, 1), ('g', 5, 'end', 3, 3)"
_EDGES = "('g', 3, 0, 1), ('g', 4, 0, 2), ('g', 5, 0, 3), ('g', 5, 1, 4), ('g', 4, 1, 3)"


def _edges(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_EDGES} AS v(graph_id, child, pos, parent)")


@query(
    f"WITH RECURSIVE e AS (SELECT * FROM (VALUES {_EDGES}) AS v(graph_id, child, pos, parent)), n AS (SELECT * FROM (VALUES {_NODES}) AS v(graph_id, node_id, tool, k, effect)), "
    "l AS (SELECT graph_id, node_id, 0 AS level FROM n UNION ALL SELECT e.graph_id, e.child, l.level + 1 FROM l JOIN e ON e.graph_id = l.graph_id AND e.parent = l.node_id) SELECT graph_id, node_id, max(level) AS level FROM l GROUP BY graph_id, node_id"
)
def graph_levels(spark, sf_dir):  # G3
    nodes = spark.sql(f"SELECT * FROM VALUES {_NODES} AS v(graph_id, node_id, tool, k, effect)")
    return graph.levels(_edges(spark), nodes)


@query(
    f"WITH RECURSIVE e AS (SELECT * FROM (VALUES {_EDGES}) AS v(graph_id, child, pos, parent)), r AS (SELECT 'g' AS graph_id, 4 AS node_id UNION SELECT e.graph_id, e.parent FROM r JOIN e ON e.graph_id = r.graph_id AND e.child = r.node_id) SELECT * FROM r"
)
def graph_reachability(spark, sf_dir):  # G5
    return graph.reachable(_edges(spark), spark.sql("SELECT 'g' AS graph_id, 4 AS node_id"))


@query("SELECT * FROM (VALUES ('g', 1, 1), ('g', 2, 1), ('g', 3, 3), ('g', 5, 5)) AS v(graph_id, node_id, first_id)")
def tool_merging(spark, sf_dir):  # R2
    rows = spark.sql(f"SELECT graph_id, node_id, tool AS tool_name, '' AS in_schema, '' AS out_schema, array(k) AS inputs, effect, node_id AS place FROM VALUES {_NODES} AS v(graph_id, node_id, tool, k, effect)")
    return graph.first_equal_tools(rows)


@query("SELECT * FROM (VALUES ('g', CAST(0 AS BIGINT), '1,2'), ('g', CAST(1 AS BIGINT), '4'), ('g', CAST(2 AS BIGINT), '6'), ('g', CAST(3 AS BIGINT), '3,5')) AS v(graph_id, group_no, nodes)")
def schedule_groups(spark, sf_dir):  # G6
    nodes = spark.sql("SELECT 'g' AS graph_id, * FROM VALUES (1, 1), (2, 1), (3, 1), (4, 4), (5, 2), (6, 8) AS v(node_id, effect)")
    edges = spark.sql("SELECT 'g' AS graph_id, * FROM VALUES (3, 0, 1), (4, 0, 1), (5, 0, 2), (6, 0, 2) AS v(child, pos, parent)")
    return graph.schedules(nodes, edges).withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query(
    "SELECT * FROM (VALUES (1, '-', 'generate', 'Answer: X'), (2, '1', 'generate', 'Answer: Y'), (3, '-', 'generate:structured', 'Zed')) AS v(node_id, inputs, op_name, name)"
)
def graph_rewrites(spark, sf_dir):  # R1, R3, R4, R5
    g = graph.Graph()
    a = g.add(graph.Node("TokenOp", op_name="generate", debug_name="Answer: X", out_type=types.TokensType()))
    g.add(graph.Node("TokenOp", (a,), op_name="generate", debug_name="Answer: Y", out_type=types.TokensType()))
    g.add(graph.Node("TokenOp", op_name="generate", debug_name="Zed", out_type=types.SchemaType("{}", 1)))
    rows = [(i, ",".join(map(str, n.inputs)) or "-", n.op_name, n.debug_name) for i, n in graph.rewrite(g).nodes.items()]
    return spark.createDataFrame(rows, "node_id int, inputs string, op_name string, name string")


@query("SELECT * FROM (VALUES (1, '16,32', true, false), (2, '16,64', false, true), (3, '', false, false)) AS v(id, shape, below, above)")
def type_meet(spark, sf_dir):  # R7, R8
    rows = spark.sql("SELECT * FROM VALUES (1, array(16L, 32L), array(16L, -1L)), (2, array(-1L, 64L), array(16L, 64L)), (3, array(1L), array(1L, 2L)) AS v(id, a, b)")
    a, b = F.col("a"), F.col("b")
    return rows.select("id", F.array_join(types.shape_meet(a, b).cast("array<string>"), ",").alias("shape"), types.shape_is_subtype(a, b).alias("below"), types.shape_is_subtype(b, a).alias("above"))


@query("SELECT * FROM (VALUES (3, 'add: dtype mismatch, F32 and F16')) AS v(node_id, message)")
def typecheck_errors(spark, sf_dir):  # R6
    g = graph.Graph()
    ids = [g.add(graph.Node("TensorOp", op_name="input", out_type=types.TensorType((2, 4), t))) for t in ("F32", "F16")]
    g.add(graph.Node("TensorOp", tuple(ids), op_name="add", out_type=types.TensorType((2, 4))))
    return spark.createDataFrame(graph.typecheck(g), "node_id int, message string")


@query(
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: 2 * greatest(CAST(x AS DOUBLE), 0.0))), 4) AS total FROM embeddings"
)
def graph_run(spark, sf_dir):  # G7, K1, S1: one select, a column a node
    g = graph.Graph()
    a = g.add(graph.Node("TensorOp", op_name="input"))
    b = g.add(graph.Node("TensorOp", (a,), op_name="relu"))
    g.add(graph.Node("TensorOp", (b, b), op_name="add"))
    out = graph.run(g, _table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), {a: "embedding"})
    return out.select("vec_id", F.round(F.aggregate(F.transform("node_3", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    f"SELECT conv_id, turn, array_to_string(list_transform(range(0, 8), lambda i: (CAST('0x' || substr(h, CAST(2 * (i % (length(h) // 2)) + 1 AS BIGINT), 2) AS INTEGER) + i + 97) % 10009), ',') AS raw, "
    f"array_to_string(list_transform(range(0, 8), lambda i: (coalesce(CAST('0x' || substr(k, CAST(2 * (i % (length(k) // 2)) + 1 AS BIGINT), 2) AS INTEGER), 0) + i + 43) % 10037), ',') AS joined, "
    f"array_to_string(list_transform(range(0, 8), lambda i: ((CAST('0x' || substr(h, CAST(2 * ((i % 8) % (length(h) // 2)) + 1 AS BIGINT), 2) AS INTEGER) + i + 97) % 10009 + i + 29) % 10009), ',') AS chained "
    f"FROM (SELECT conv_id, turn, {_HEX.format("CASE WHEN text = '' THEN ' ' ELSE text END")} AS h, {_HEX.format(_CANON.format("text || chr(10) || role"))} AS k FROM conversations)"
)
def graph_token_run(spark, sf_dir):  # K2, G7: first input byte by byte, all inputs canonical, and tokens of tokens
    g = graph.Graph()
    a, b = g.add(graph.Node("TensorOp", op_name="input")), g.add(graph.Node("TensorOp", op_name="input"))
    raw = g.add(graph.Node("TokenOp", (a, b), op_name="generate", model_id="fake/m", max_tokens=8))
    joined = g.add(graph.Node("TokenOp", (a, b), op_name="generate", model_id="vllm/m", max_tokens=8))
    chained = g.add(graph.Node("TokenOp", (raw,), op_name="generate", model_id="anthropic/m", max_tokens=8))
    out = graph.run(g, _table(spark, sf_dir, "conversations"), {a: "text", b: "role"})
    shown = lambda i, name: F.array_join(F.col(f"node_{i}").cast("array<string>"), ",").alias(name)
    return out.select("conv_id", "turn", shown(raw, "raw"), shown(joined, "joined"), shown(chained, "chained"))


_SESSION_STEPS = _STEPS.replace("conv_id, role, substr(h, 1, 2)", "conv_id, substr(h, 1, 2)")


@query(
    _SESSION_STEPS + "SELECT conv_id, turn, total_tokens, hit_len > 0 AS cache_hit, hit_len AS prefix_hit_len, total_tokens - hit_len AS tokens_sent, CAST(total_tokens - hit_len + 16 AS BIGINT) AS compute_steps FROM s"
)
def graph_session_run(spark, sf_dir):  # M1, M2, K2, G7: the graph's operators look up, run on the registry's choice, and store
    rows = _table(spark, sf_dir, "conversations")
    return _session(spark, rows).steps.select(
        F.col("session_id").alias("conv_id"), F.col("step").alias("turn"), _long(F.col("total_tokens")).alias("total_tokens"), "cache_hit",
        _long(F.col("prefix_hit_len")).alias("prefix_hit_len"), _long(F.col("tokens_sent")).alias("tokens_sent"), _long(F.col("compute_steps")).alias("compute_steps"),
    )


def _session(spark: SparkSession, rows: DataFrame):
    registry = BackendRegistry()
    registry.register_backend(Backend("first", 100, supports_token=True, supports_cache=True, rule="fake"))
    registry.register_backend(Backend("second", 10, supports_token=True, rule="openai"))
    g = graph.Graph()
    a = g.add(graph.Node("TensorOp", op_name="input"))
    g.add(graph.Node("TokenOp", (a,), op_name="generate", model_id="openai/m", temperature=0.0, max_tokens=16, debug_name="answer"))
    return Session(registry).run(g, rows, {a: "text"}, "conv_id", "turn")


@query(
    _SESSION_STEPS + "SELECT conv_id AS session_id, count(*) AS run_count, count(*) AS lookups, CAST(sum(CAST(hit_len > 0 AS BIGINT)) AS BIGINT) AS hits, CAST(sum(hit_len) AS BIGINT) AS tokens_saved FROM s GROUP BY conv_id"
)
def graph_session_metrics(spark, sf_dir):  # M4 over M1
    out = session_metrics(_session(spark, _table(spark, sf_dir, "conversations")).steps)
    return out.select("session_id", "run_count", "lookups", "hits", "tokens_saved")


@query("SELECT * FROM (VALUES (3, '1'), (4, '2'), (5, '3'), (6, '4'), (7, '1'), (8, '7'), (9, '7')) AS v(node_id, inputs)")
def hoist_unnamed(spark, sf_dir):  # R1, R5: operators without a name share nothing; equal names are one
    g = graph.Graph()
    a, b = g.add(graph.Node("TensorOp", op_name="input")), g.add(graph.Node("TensorOp", op_name="input"))
    plain = [g.add(graph.Node("TokenOp", (i,), op_name="generate")) for i in (a, b)]
    for i in plain:
        g.add(graph.Node("TensorOp", (i,), op_name="id"))
    same = [g.add(graph.Node("TokenOp", (i,), op_name="generate", debug_name="Answer")) for i in (a, b)]
    g.update(same[1], inputs=(same[0],))
    g.add(graph.Node("TensorOp", (same[1],), op_name="id"))
    out = graph.hoist_prefixes(g)
    return spark.createDataFrame([(i, ",".join(map(str, n.inputs))) for i, n in out.nodes.items() if n.inputs], "node_id int, inputs string")


@query()
def classifier_training(spark, sf_dir):  # T11
    return spark.createDataFrame(nn.train_classifier(nn.separable(spark), epochs=5), "epoch int, loss double, accuracy double")


# Search, data sets, reports -------------------------------------------------------------------------------


@query("SELECT CAST(x AS DOUBLE) AS x, round(-(avg((x - value) * (x - value))), 2) AS score FROM events, unnest([10.0, 20.0, 30.0]) AS u(x) GROUP BY x")
def candidate_scores(spark, sf_dir):  # O2, O3, O5, O6: every candidate in one aggregate
    rows, tried = _table(spark, sf_dir, "events"), [10.0, 20.0, 30.0]
    got = scores(rows, lambda s: F.lit(s["x"]), lambda out: -F.pow(out - F.col("value"), F.lit(2.0)), [{"x": x} for x in tried])
    return spark.createDataFrame(list(zip(tried, got, strict=True)), "x double, score double").withColumn("score", F.round("score", 2))


@query("SELECT CAST(max_by(x, s) AS DOUBLE) AS x FROM (SELECT x, -avg((x - value) * (x - value)) AS s FROM events, unnest([10.0, 20.0, 30.0, 90.0]) AS u(x) GROUP BY x)")
def optimizer_choice(spark, sf_dir):  # O1, O3, O5, O8: the optimizer's own step over a discrete parameter
    params = {"x": Param.discrete(10.0, choices=[10.0, 20.0, 30.0, 90.0])}
    opt = Optimizer(lambda s: F.lit(s["x"]), lambda out: -F.pow(out - F.col("value"), F.lit(2.0)), params, seed=3)
    opt.fit(lambda: [_table(spark, sf_dir, "events")])
    return spark.createDataFrame([(opt.values()["x"],)], "x double")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(count(*) OVER () * 0.8) AS train FROM labels")
def train_test_split(spark, sf_dir):  # O9
    train, test = split_train_test(_table(spark, sf_dir, "labels"), 0.8, 42, "doc_id")
    return train.select("doc_id", F.lit(True).alias("train")).union(test.select("doc_id", F.lit(False).alias("train")))


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch_id FROM labels")
def batching(spark, sf_dir):  # S6
    return batched(_table(spark, sf_dir, "labels"), 20, "doc_id").select("doc_id", "batch_id")


def _qa_sql() -> str:
    """The rows from their drawn wordings, and the program by string functions."""
    pairs = ", ".join(f"('{k}', '{v}', {n})" for n, (k, v) in enumerate(CAPITALS.items()))
    quoted = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
    drawn = ", ".join(f"({i}, {q + 1}, {c + 1})" for i, q, c in wordings(200, 11))
    filled = "replace(replace(replace(replace({0}, '{{country}}', a.k), '{{capital}}', a.v), '{{d_country}}', b.k), '{{d_capital}}', b.v)"
    pattern = "'The capital of ([A-Za-z ]+) is ([A-Za-z ]+)'"
    return (
        f"WITH p AS (SELECT * FROM (VALUES {pairs}) AS v(k, v, n)), d AS (SELECT * FROM (VALUES {drawn}) AS v(id, q, c)), "
        f"r AS (SELECT d.id, {filled.format(quoted(QUESTIONS) + '[d.q]')} AS question, {filled.format(quoted(CONTEXTS) + '[d.c]')} AS context, a.v AS answer, a.k AS own FROM d JOIN p a ON a.n = d.id % 12 JOIN p b ON b.n = (d.id + 3) % 12), "
        "w AS (SELECT *, coalesce((SELECT min_by(k, n) FROM p WHERE contains(lower(r.question), lower(k))), own) AS asked, "
        f"list_zip(list_transform(regexp_extract_all(context, {pattern}, 1), lambda x: trim(x)), list_transform(regexp_extract_all(context, {pattern}, 2), lambda x: trim(x))) AS said FROM r), "
        "o AS (SELECT *, CASE WHEN len(said) = 0 THEN 'unknown' ELSE coalesce(list_filter(said, lambda x: x[1] = asked)[1][2], said[1][2]) END AS predicted FROM w) "
        "SELECT id, question, predicted, answer, CAST(lower(trim(predicted)) = lower(trim(answer)) AS DOUBLE) AS em FROM o"
    )


@query(_qa_sql())
def qa_program(spark, sf_dir):  # S4, F14, F15
    rows = qa_rows(spark, 200, 11)
    values = {"instruction": "question-first", "fewshot": "", "reasoning_style": "chain", "temperature": 0.9}
    return rows.select("id", "question", qa.answer(values).alias("predicted"), "answer", qa.metric(qa.answer(values)).alias("em"))


@query(
    "SELECT r_name, count(*) AS customers, round(avg(c_acctbal), 4) AS mean_balance, CAST(sum(length('Region ' || r_name || ', nation ' || n_name || ': ' || c_name)) AS BIGINT) AS prompt_chars "
    "FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"
)
def nation_prompt_report(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(_table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    prompt = F.concat(F.lit("Region "), "r_name", F.lit(", nation "), "n_name", F.lit(": "), "c_name")
    return rows.groupBy("r_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), _long(F.sum(F.length(prompt))).alias("prompt_chars"))
