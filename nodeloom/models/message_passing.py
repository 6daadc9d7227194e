"""Message passing over nodes and edges tables: neighbour aggregates and scoring of SAGE and GIN regressors.

Neighbour sums are one join and one aggregate with a column for each feature (partial sums on
the map side), over edges that are laid out once for all layers (``wiring``); dense layers are applied to Arrow batches with NumPy.  Weights are a dict of
arrays, as small as the model, and travel with the task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.models.wiring import Wiring


def neighbor_aggregate(nodes: DataFrame, edges: DataFrame, features: str, width: int, how: str = "mean", column: str = "agg") -> DataFrame:
    """``nodes`` with the mean or sum of the in-neighbours' ``features`` (zeros without any)."""
    fn = {"mean": F.avg, "sum": F.sum}[how]
    sent = nodes.select("graph_id", F.col("node_id").alias("src"), F.col(features).alias("_f"))
    got = edges.select("graph_id", "src", "dst").join(sent, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id"))
    sums = got.agg(*[fn(F.get("_f", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(width)])
    arrays = sums.select("graph_id", "node_id", F.array(*[F.col(f"_{i}") for i in range(width)]).alias(column))
    zeros = F.array_repeat(F.lit(0.0), width)
    return nodes.drop(column).join(arrays, ["graph_id", "node_id"], "left").withColumn(column, F.coalesce(column, zeros))


@dataclass
class Sage:
    """Mean-aggregating regressor: per layer SAGE, normalisation, ReLU, residual; then a linear head.

    ``norm`` is 'layer', 'batch' (with running statistics in the weights) or None.  ``outputs`` above 1
    gives a head for several markers (logits).
    """

    n_markers: int
    hidden: int = 64
    layers: int = 3
    residual: bool = True
    norm: str | None = "layer"
    outputs: int = 1
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def init(self, seed: int = 0) -> Sage:
        rng = np.random.default_rng(seed)
        dense = lambda i, o: rng.uniform(-1, 1, (i, o)) / np.sqrt(i)
        w: dict[str, np.ndarray] = {}
        for k in range(self.layers):
            i = self.n_markers if k == 0 else self.hidden
            w[f"l{k}.near"], w[f"l{k}.own"], w[f"l{k}.bias"] = dense(i, self.hidden), dense(i, self.hidden), np.zeros(self.hidden)
            if self.norm:
                w[f"l{k}.gain"], w[f"l{k}.shift"] = np.ones(self.hidden), np.zeros(self.hidden)
            if self.norm == "batch":
                w[f"l{k}.mean"], w[f"l{k}.var"] = np.zeros(self.hidden), np.ones(self.hidden)
        if self.residual and self.n_markers != self.hidden:
            w["project"] = dense(self.n_markers, self.hidden)
        w["head"], w["head.bias"] = dense(self.hidden, self.outputs), np.zeros(self.outputs)
        self.weights = w
        return self

    def num_parameters(self) -> int:
        return sum(v.size for k, v in self.weights.items() if not k.endswith((".mean", ".var")))

    def layer(self, k: int, h: np.ndarray, near: np.ndarray) -> np.ndarray:
        w = self.weights
        z = near @ w[f"l{k}.near"] + h @ w[f"l{k}.own"] + w[f"l{k}.bias"]
        if self.norm == "layer":
            z = (z - z.mean(1, keepdims=True)) / np.sqrt(z.var(1, keepdims=True) + 1e-5) * w[f"l{k}.gain"] + w[f"l{k}.shift"]
        elif self.norm == "batch":
            z = (z - w[f"l{k}.mean"]) / np.sqrt(w[f"l{k}.var"] + 1e-5) * w[f"l{k}.gain"] + w[f"l{k}.shift"]
        out = np.maximum(z, 0)
        if self.residual:
            out = out + (h @ w["project"] if k == 0 and "project" in w else h)
        return out

    def transform(self, nodes: DataFrame, edges: DataFrame, wiring: Wiring | None = None) -> DataFrame:
        """``nodes`` with ``yhat`` (a number, or an array of logits for several outputs); null for rows with a null graph_id.

        ``wiring`` is the layout of the edges, made here unless the caller has it from before.
        """
        scored = _scored(self, nodes, wiring or Wiring.of(nodes, edges), "mean")
        return scored.withColumn("yhat", F.get("yhat", F.lit(0))) if self.outputs == 1 else scored


@dataclass
class Gin:
    """Sum-aggregating regressor: per layer a two-layer perceptron of (1 + eps) h + sum of neighbours, ReLU; linear head."""

    n_markers: int
    hidden: int = 128
    layers: int = 3
    eps: float = 0.0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def init(self, seed: int = 0) -> Gin:
        rng = np.random.default_rng(seed)
        dense = lambda i, o: rng.uniform(-1, 1, (i, o)) / np.sqrt(i)
        w: dict[str, np.ndarray] = {}
        for k in range(self.layers):
            w[f"l{k}.a"], w[f"l{k}.a.bias"] = dense(self.n_markers if k == 0 else self.hidden, self.hidden), np.zeros(self.hidden)
            w[f"l{k}.b"], w[f"l{k}.b.bias"] = dense(self.hidden, self.hidden), np.zeros(self.hidden)
        w["head"], w["head.bias"] = dense(self.hidden, 1), np.zeros(1)
        self.weights = w
        return self

    def num_parameters(self) -> int:
        return sum(v.size for v in self.weights.values())

    def layer(self, k: int, h: np.ndarray, near: np.ndarray) -> np.ndarray:
        w = self.weights
        z = np.maximum(((1 + self.eps) * h + near) @ w[f"l{k}.a"] + w[f"l{k}.a.bias"], 0)
        return np.maximum(z @ w[f"l{k}.b"] + w[f"l{k}.b.bias"], 0)

    def transform(self, nodes: DataFrame, edges: DataFrame, wiring: Wiring | None = None) -> DataFrame:
        """``nodes`` with ``yhat``; null for rows with a null graph_id."""
        return _scored(self, nodes, wiring or Wiring.of(nodes, edges), "sum").withColumn("yhat", F.get("yhat", F.lit(0)))


def _scored(model: Sage | Gin, nodes: DataFrame, wiring: Wiring, how: str) -> DataFrame:
    """``nodes`` with the head's outputs as ``yhat``: a layer is one pass over the wiring and one dense step."""
    now, width = nodes.select("graph_id", "node_id", F.transform("x", lambda v: v.cast("double")).alias("_h")), model.n_markers
    for k in range(model.layers):
        step = _dense(lambda h, near, k=k: model.layer(k, h, near))
        now = wiring.passed(now, "_h", width, how).select("graph_id", "node_id", step("own", "near").alias("_h"))
        width = model.hidden
    head = _dense(lambda h, _: h @ model.weights["head"] + model.weights["head.bias"])
    return nodes.drop("yhat").join(now.select("graph_id", "node_id", head("_h", "_h").alias("yhat")), ["graph_id", "node_id"], "left")


def _dense(apply):
    """An Arrow-batched function of two array<double> columns."""

    @F.pandas_udf("array<double>")
    def run(h: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series(list(apply(np.stack(h.to_numpy()), np.stack(near.to_numpy()))))

    return run
