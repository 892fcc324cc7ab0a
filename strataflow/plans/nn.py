"""Modules whose forward pass is a Column expression, and a small classifier trained over a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import tensor
from strataflow.plans.optimize import Param


class Module:
    """Parameters and submodules are found by their attributes, own parameters first."""

    def parameters(self) -> list[Param]:
        own = [v for v in self.__dict__.values() if isinstance(v, Param)]
        return own + [p for v in self.__dict__.values() if isinstance(v, Module) for p in v.parameters()]

    def forward(self, x: Column) -> Column:
        raise NotImplementedError

    def __call__(self, x: Column) -> Column:
        return self.forward(x)


class Linear(Module):
    """W x + b; weights and bias begin at zero and are the module's parameters."""

    def __init__(self, inputs: int, outputs: int):
        self.weight = Param.tensor((outputs, inputs), initial=[[0.0] * inputs for _ in range(outputs)])
        self.bias = Param.tensor((outputs,), initial=[0.0] * outputs)

    def forward(self, x: Column) -> Column:
        return tensor.linear(x, self.weight.value, self.bias.value)


class Sequential(Module):
    def __init__(self, *parts: Module):
        self.parts = parts

    def parameters(self) -> list[Param]:
        return [p for m in self.parts for p in m.parameters()]

    def forward(self, x: Column) -> Column:
        for m in self.parts:
            x = m(x)
        return x


def separable(spark: SparkSession, rows: int = 1024, seed: int = 42) -> DataFrame:
    """(x0, x1, label): normal points, labelled by the sign of x0 + 0.75 x1."""
    points = spark.range(0, rows, 1, 4).select(F.randn(seed).alias("x0"), F.randn(seed + 1).alias("x1"))
    return points.withColumn("label", (F.col("x0") + 0.75 * F.col("x1") > 0).cast("int"))


def train_classifier(points: DataFrame, epochs: int = 20, lr: float = 0.5, hidden: int = 16, seed: int = 42) -> list[dict]:
    """Full-batch gradient descent of a network 2-hidden-2 with ReLU and cross-entropy; one row an epoch.

    An epoch is one job: partitions give their part of the gradient, which is summed before it reaches the
    driver; weights go out in the task's closure. The loss is that before the step, the accuracy that after it.
    """
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.7, (2, hidden)), np.zeros(hidden), rng.normal(0, 0.3, (hidden, 2)), np.zeros(2)]
    data = points.select("x0", "x1", "label").persist()
    size = sum(x.size for x in w)
    names = [f"g{i}" for i in range(size)] + ["loss", "hits", "n"]

    def parts(weights: list[np.ndarray]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x, y = b[["x0", "x1"]].to_numpy(), b["label"].to_numpy()
                h = np.maximum(x @ weights[0] + weights[1], 0)
                z = h @ weights[2] + weights[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = p - np.eye(2)[y]
                back = (d @ weights[2].T) * (h > 0)
                grads = [x.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0)]
                row = np.concatenate([*(g.ravel() for g in grads), [-np.log(p[np.arange(len(y)), y] + 1e-12).sum(), (p.argmax(axis=1) == y).sum(), len(y)]])
                yield pd.DataFrame([row], columns=names)

        return run

    out = []
    for epoch in range(epochs + 1):
        total = data.mapInPandas(parts(w), ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        n = total["n"] or 1.0
        if out:
            out[-1]["accuracy"] = total["hits"] / n
        if epoch == epochs:
            break
        out.append({"epoch": epoch + 1, "loss": total["loss"] / n, "accuracy": 0.0})
        at = 0
        for i, x in enumerate(w):
            w[i] = x - lr * np.array([total[f"g{k}"] for k in range(at, at + x.size)]).reshape(x.shape) / n
            at += x.size
    data.unpersist()
    return out
