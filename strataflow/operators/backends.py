"""Token and tensor backends: a registry with capabilities and priorities, and plugins that run in executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import generators, tensor

ABI_VERSION = 1


@dataclass(frozen=True)
class Backend:
    """name, what it can run, and how: a rule name of the generators, a function from prompts to texts, or for
    tensors a function (operator, a, b, shaped, dim) to a Column; without one, Column expressions."""

    name: str
    priority: int = 0
    supports_tensor: bool = False
    supports_token: bool = False
    supports_cache: bool = False
    rule: str | None = None
    complete: Callable[[list[str]], list[str]] | None = None
    tensor: Callable[..., Column] | None = None
    version: int = ABI_VERSION


class BackendRegistry:
    def __init__(self) -> None:
        self._all: dict[str, Backend] = {}

    def register_backend(self, backend: Backend) -> None:
        """Adds a backend, in place of an earlier one of its name."""
        if backend.version != ABI_VERSION:
            raise ValueError(f"backend {backend.name}: version {backend.version}, not {ABI_VERSION}")
        self._all[backend.name] = backend

    def get(self, name: str) -> Backend:
        if name not in self._all:
            raise KeyError(f"backend not registered: {name}")
        return self._all[name]

    def has(self, name: str) -> bool:
        return name in self._all

    def select_backend(self, kind: str) -> Backend:
        """The capable backend of the highest priority; of equal ones the first by name."""
        able = [b for b in self._all.values() if (kind == "TensorOp" and b.supports_tensor) or (kind == "TokenOp" and b.supports_token)]
        if not able:
            raise ValueError(f"no backend for {kind}")
        return min(able, key=lambda b: (-b.priority, b.name))


def select_by_priority(backends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, kind, backend) for a table of nodes, by a table of backends; null where none is able."""
    able = backends.select("name", "priority", F.explode(F.array(F.struct(F.lit("TensorOp").alias("k"), F.col("supports_tensor").alias("s")), F.struct(F.lit("TokenOp").alias("k"), F.col("supports_token").alias("s")))).alias("c"))
    best = able.where("c.s").groupBy(F.col("c.k").alias("kind")).agg(F.min(F.struct((-F.col("priority")).alias("p"), F.col("name").alias("name")))["name"].alias("backend"))
    return nodes.join(best, "kind", "left").select("node_id", "kind", "backend")


def complete_with(prompts: DataFrame, backend: Backend, prompt_col: str = "prompt", output_col: str = "output") -> DataFrame:
    """prompts with a backend's output: the rule's tokens as a Column, or a plugin's texts in Arrow batches.

    A plugin may be called again where a task is retried, so it has to be idempotent; persist its output before
    using it twice.
    """
    if backend.rule:
        return prompts.withColumn(output_col, generators.run(backend.rule, F.col(prompt_col), 128)["output"])
    return prompts.withColumn(output_col, completion(backend)(F.col(prompt_col)))


def completion(backend: Backend) -> Callable[[Column], Column]:
    """A plugin's call as a function from a Column of prompts to one of texts."""
    if backend.complete is None:
        raise ValueError(f"backend {backend.name} has nothing to run")
    call = backend.complete

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(call(texts.fillna("").tolist()), dtype="object")

    return answer.asNondeterministic()


#: The setting that names the tensor backend of tensor_registry().
TENSOR_SETTING = "spark.strataflow.tensor.backend"


def arrow_tensor(op: str, a: Column, b: Column | None = None, shaped: bool = False, dim: int = -1) -> Column:
    """The flat tensor operators over Arrow batches, in single precision: a second backend beside the expressions."""
    if shaped or op not in (*tensor.UNARY, "add", "mul", "matmul"):
        raise ValueError(f"unsupported tensor op: {op}")
    if op in tensor.BINARY and b is None:
        raise ValueError(f"{op} takes two tensors")
    if op in ("input", "identity", "id"):
        return a

    def one(x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
        if op == "relu":
            return np.maximum(x, np.float32(0))
        if op == "softmax":
            e = np.exp(x - x.max(initial=-np.inf))
            return e / e.sum()
        if len(x) != len(y):
            raise ValueError("tensor shapes differ")
        return {"add": lambda: x + y, "mul": lambda: x * y, "matmul": lambda: np.array([x @ y], np.float32)}[op]()

    @F.pandas_udf("array<float>")
    def unary(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else one(np.asarray(v, np.float32), None))

    @F.pandas_udf("array<float>")
    def binary(x: pd.Series, y: pd.Series) -> pd.Series:
        both = zip(x, y, strict=True)
        return pd.Series([None if v is None or w is None else one(np.asarray(v, np.float32), np.asarray(w, np.float32)) for v, w in both])

    return binary(a, b) if op in tensor.BINARY else unary(a)


def tensor_registry(spark: SparkSession) -> BackendRegistry:
    """Expressions as the default backend; where the session's setting says "arrow", that one goes before it."""
    out = BackendRegistry()
    out.register_backend(Backend("default", 10, supports_tensor=True))
    if spark.conf.get(TENSOR_SETTING, "") == "arrow":
        out.register_backend(Backend("arrow", 100, supports_tensor=True, tensor=arrow_tensor))
    return out


def http_client(post: Callable[[dict], str], model: str, max_tokens: int = 128, temperature: float = 0.0) -> Callable[[list[str]], list[str]]:
    """A completion function over a caller's own transport: post(request) gives the body of a JSON answer."""
    import json

    def one(prompt: str) -> str:
        got = json.loads(post({"model": model, "prompt": prompt, "max_tokens": max_tokens, "temperature": temperature}))
        choice = (got.get("choices") or [{}])[0]
        return choice.get("text") or (choice.get("message") or {}).get("content") or ""

    return lambda prompts: [one(p) for p in prompts]
