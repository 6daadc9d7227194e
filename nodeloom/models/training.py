"""Training of SAGE and GIN regressors (and multi-marker classifiers) on Spark.

Minibatches are dealt anew each epoch, by hash or, with ``batch_size``, to the exact size by a keyed permutation.  A step sums loss and
gradient over the minibatch and takes an AdamW step with a clipped norm.  The state with the best validation error (without a
validation set, training error) is kept; training stops after ``patience`` epochs without improvement.

``by`` chooses how a step's sums are made:

* 'graph': graphs are packed, one row a graph; a step is a job, and executors add its vectors position by position, so the driver sees one vector as large as the model.
* 'barrier': packed as well; an epoch is one job whose tasks run at the same time, hand each other their sums and take the same steps.  Spark looks
  for such a hand-over once a second.  Where an epoch has more small minibatches than tasks, each task holds whole minibatches and takes their
  steps by itself, then hands weights and moments to the next one: the same steps, with a hand-over a task in place of one a minibatch.
* 'joins': by joins over nodes and edges, so that a graph may be of any size; the edges are laid out once, before the first step.

Several models that read the same packed graphs train side by side (``train_together``; 'relay' in ``depth_scan``): an epoch's minibatches are dealt and
laid out once for all of them, in ranges of about ``TURN`` nodes and edges; in each turn every model takes a range's steps in a task of its own,
and in the next turn it goes on from there with its next range.  One model's steps are one after the other by nature, different models' are not.

With ``state_path``, every epoch's weights, moments, history and patience are written to that folder, and a later call goes on from the last one written.

Batch norm uses the whole minibatch's statistics, whatever the partitions: a job for each layer sums the moments
on the way forward, another what its derivative needs on the way back.  The calibration penalty is defined on the whole
minibatch too; a job sums its moments.

Packed, a training graph is one row and one task: at 6 markers, hidden width 128 and three layers a task holds about 10 KB a node, so a
graph of 100,000 nodes takes 1 GB.  For larger graphs take ``by="joins"``.  Graphs pass through a task in pieces of about ``PIECE`` nodes and edges, so
its memory doesn't grow with their number; a barrier task that needs several passes over a minibatch keeps what is beyond ``SPOOL`` bytes in a file.
"""

from __future__ import annotations

import json
import pickle
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from copy import deepcopy
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from tempfile import SpooledTemporaryFile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.columns import sigmoid
from nodeloom.models.message_passing import Gin, Sage
from nodeloom.models.wiring import Wiring
from nodeloom.operators.markers import baseline_means, baseline_of, marker_baseline, relative_mse_across_graphs, residualize, with_baseline
from nodeloom.operators.prep import hash_rank
from nodeloom.sources.builders import minibatch_of_size, with_minibatch
from nodeloom.storage import checkpointed

#: Added to variances before the root, and the weight of a step's statistics in the stored ones.
EPS, MOMENTUM = 1e-5, 0.1
#: Nodes and edges of packed graphs that a task works on at a time (a larger graph is a piece of its own), and bytes of pieces that it keeps in memory.
PIECE, SPOOL = 1 << 15, 64 << 20
#: Nodes of a minibatch beyond which the tasks of a barrier job share it.
SHARED_FROM = 200_000
#: Nodes and edges of the minibatches whose steps a task takes in a turn, and how many turns an epoch has at most.
TURN, TURNS = 1 << 20, 64
#: Nodes and edges that several models score at a time.
SCORED = 1 << 12


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 80
    batches: int = 1  # minibatches an epoch, of about equal size
    batch_size: int | None = None  # graphs a minibatch, exactly (the last one may be smaller); in place of ``batches``
    lr: float = 2e-3
    weight_decay: float = 1e-4
    patience: int = 12
    loss: str = "huber"  # or "mse", the mean squared error
    huber_delta: float = 1.0
    calibration_weight: float = 0.0
    calibration_mode: str = "corr"
    clip_norm: float | None = 2.0
    dropout: float = 0.0
    seed: int = 0


def packed_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: ``ids`` (ascending), ``x``, ``y`` in their order, ``src``, ``dst`` (ids).

    ``y`` may be a number or an array per node.  A graph must fit in a row.
    """
    y = F.col("y") if dict(nodes.dtypes)["y"].startswith("array") else F.array(F.col("y").cast("double"))
    rows = nodes.select("graph_id", "node_id", F.struct("node_id", F.transform("x", lambda v: v.cast("double")).alias("x"), F.transform(y, lambda v: v.cast("double")).alias("y")).alias("_n"))
    packed = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list("_n")).alias("_n"))
    ends = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("_e"))
    met = packed.join(ends, "graph_id", "left")
    end = lambda c: F.transform(F.coalesce("_e", F.array()), lambda e: e[c]).alias(c)
    part = lambda c: F.transform("_n", lambda n: n[c]).alias("ids" if c == "node_id" else c)
    return met.select("graph_id", part("node_id"), part("x"), part("y"), end("src"), end("dst"))


def trainable(model: Sage | Gin) -> list[str]:
    """Names of the weights that gradients exist for (not the stored statistics of batch norm)."""
    return [k for k in model.weights if not k.endswith((".mean", ".var"))]


def sage_sums(model: Sage, k: int, h: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Layer k before its normalisation."""
    w = model.weights
    return near @ w[f"l{k}.near"] + h @ w[f"l{k}.own"] + w[f"l{k}.bias"]


def sage_out(model: Sage, k: int, h: np.ndarray, z: np.ndarray, moments: tuple | None) -> tuple[np.ndarray, tuple]:
    """(layer k's output, what its derivative needs); ``moments``: the minibatch's mean and variance, for batch norm."""
    w, n = model.weights, z
    unit = spread = None
    if model.norm:
        mean, var = z.mean(1, keepdims=True), z.var(1, keepdims=True)
        if model.norm == "batch":
            mean, var = moments if moments is not None else (w[f"l{k}.mean"], w[f"l{k}.var"])
        spread = np.sqrt(var + EPS)
        unit = z - mean
        unit /= spread
        n = unit * w[f"l{k}.gain"] + w[f"l{k}.shift"]
    out = np.maximum(n, 0)
    if model.residual:
        out = out + (h @ w["project"] if k == 0 and "project" in w else h)
    return out, (unit, spread, n > 0)


def sage_unit_slope(model: Sage, k: int, kept: tuple, d: np.ndarray) -> np.ndarray:
    """du: the slope of the normalised sums."""
    dz = d * kept[2]
    return dz * model.weights[f"l{k}.gain"] if model.norm else dz


def sage_back(model: Sage, k: int, h: np.ndarray, near: np.ndarray, kept: tuple, d: np.ndarray, means: tuple | None) -> tuple[dict, np.ndarray, np.ndarray]:
    """(gradients of layer k's weights, slope of h, slope of near); ``means``: the minibatch's mean of du and du * unit, for batch norm."""
    w, g, (unit, spread, on) = model.weights, {}, kept
    dz = d * on
    if model.norm:
        g[f"l{k}.gain"], g[f"l{k}.shift"] = (dz * unit).sum(0), dz.sum(0)
        du = dz * w[f"l{k}.gain"]
        if model.norm == "layer":
            du = du - du.mean(1, keepdims=True) - unit * (du * unit).mean(1, keepdims=True)
        elif means is not None:
            du = du - means[0] - unit * means[1]
        dz = du / spread
    g[f"l{k}.near"], g[f"l{k}.own"], g[f"l{k}.bias"] = near.T @ dz, h.T @ dz, dz.sum(0)
    back = dz @ w[f"l{k}.own"].T
    if model.residual:
        if k == 0 and "project" in w:
            g["project"] = h.T @ d
            back = back + d @ w["project"].T
        else:
            back = back + d
    return g, back, dz @ w[f"l{k}.near"].T


def gin_out(model: Gin, k: int, h: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(layer k's output, what its derivative needs); ``near`` is the sum over neighbours."""
    w, mixed = model.weights, (1 + model.eps) * h + near
    inner = np.maximum(mixed @ w[f"l{k}.a"] + w[f"l{k}.a.bias"], 0)
    out = np.maximum(inner @ w[f"l{k}.b"] + w[f"l{k}.b.bias"], 0)
    return out, (mixed, inner, out > 0)


def gin_back(model: Gin, k: int, kept: tuple, d: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """(gradients of layer k's weights, slope of h, slope of near)."""
    w, (mixed, inner, on) = model.weights, kept
    d = d * on
    di = (d @ w[f"l{k}.b"].T) * (inner > 0)
    near = di @ w[f"l{k}.a"].T
    return {f"l{k}.b": inner.T @ d, f"l{k}.b.bias": d.sum(0), f"l{k}.a": mixed.T @ di, f"l{k}.a.bias": di.sum(0)}, (1 + model.eps) * near, near


def sums_at(h: np.ndarray, start: np.ndarray, end: np.ndarray, rounds: list[tuple] | None = None) -> np.ndarray:
    """Rows of ``h`` at the edges' starts, added up at their ends in the edges' order; with ``rounds_of`` the edges, whole rows at a time."""
    if rounds is None:
        return np.stack([np.bincount(end, column[start], len(h)) for column in np.ascontiguousarray(h.T)], 1)
    out = np.zeros(h.shape)
    for some, ends in rounds:
        out[ends] += h.take(some, 0)
    return out


def rounds_of(start: np.ndarray, end: np.ndarray, most: int = 64) -> list[tuple] | None:
    """The (starts, ends) of an end's first edge each, then of its second, and so on: no end comes twice in a round.  None beyond ``most`` edges of an end."""
    order = np.argsort(end, kind="stable")
    first = np.flatnonzero(np.diff(end[order], prepend=-1))
    place = np.arange(len(end)) - np.repeat(first, np.diff(first, append=len(end)))
    sizes = np.bincount(place)
    if len(sizes) > most:
        return None
    parts = np.split(order[np.argsort(place, kind="stable")], np.cumsum(sizes)[:-1])
    return [(start[edges], end[edges]) for edges in parts if len(edges)]


class Tape:
    """SAGE's forward pass over a union of packed graphs, and the gradient of its outputs.

    ``moments`` are the minibatch's (mean, variance) by layer for batch norm; without them the stored ones
    count as constants.  ``upto`` stops before that layer's normalisation, whose input is then ``z``.
    """

    def __init__(
        self, model: Sage, x: np.ndarray, src: np.ndarray, dst: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None, moments: list | None = None, upto: int | None = None
    ):
        self.model, self.src, self.dst, self.moments, self.rounds = model, src, dst, moments, rounds_of(src, dst)
        self.degree = np.maximum(np.bincount(dst, minlength=len(x)), 1)[:, None]
        w, h, self.steps = model.weights, x, []
        for k in range(model.layers):
            near = self.mean(h)
            z = sage_sums(model, k, h, near)
            if k == upto:
                self.z = z
                return
            out, kept = sage_out(model, k, h, z, moments[k] if moments is not None else None)
            keep = (rng.random(out.shape) >= dropout) / (1 - dropout) if dropout else None
            self.steps.append((h, near, kept, keep))
            h = out if keep is None else out * keep
        self.last = h
        self.output = h @ w["head"] + w["head.bias"]

    def mean(self, h: np.ndarray) -> np.ndarray:
        return sums_at(h, self.src, self.dst, self.rounds) / self.degree

    def gradient(self, d_out: np.ndarray, means: dict | None = None, upto: int | None = None) -> dict[str, np.ndarray] | np.ndarray:
        """Of each trainable weight.  ``means``: the minibatch's mean of du and du * unit by layer, for batch norm; with ``upto``, that layer's sums of them."""
        w = self.model.weights
        g = {"head": self.last.T @ d_out, "head.bias": d_out.sum(0)}
        d, back_rounds = d_out @ w["head"].T, rounds_of(self.dst, self.src)
        for k in reversed(range(self.model.layers)):
            h, near, kept, keep = self.steps[k]
            if keep is not None:
                d = d * keep
            if k == upto:
                du = sage_unit_slope(self.model, k, kept, d)
                return np.concatenate([du.sum(0), (du * kept[0]).sum(0)])
            of_layer, back, sent = sage_back(self.model, k, h, near, kept, d, means[k] if self.moments is not None else None)
            g |= of_layer
            d = back + sums_at(sent / self.degree, self.dst, self.src, back_rounds)
        return g


class GinTape:
    """GIN's forward pass over a union of packed graphs, and the gradient of its outputs."""

    def __init__(self, model: Gin, x: np.ndarray, src: np.ndarray, dst: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None):
        self.model, self.src, self.dst = model, src, dst
        w, h, self.steps = model.weights, x, []
        for k in range(model.layers):
            near = sums_at(h, src, dst)
            out, kept = gin_out(model, k, h, near)
            keep = (rng.random(out.shape) >= dropout) / (1 - dropout) if dropout else None
            self.steps.append((kept, keep))
            h = out if keep is None else out * keep
        self.last = h
        self.output = h @ w["head"] + w["head.bias"]

    def gradient(self, d_out: np.ndarray) -> dict[str, np.ndarray]:
        w = self.model.weights
        g = {"head": self.last.T @ d_out, "head.bias": d_out.sum(0)}
        d = d_out @ w["head"].T
        for k in reversed(range(self.model.layers)):
            kept, keep = self.steps[k]
            of_layer, back, sent = gin_back(self.model, k, kept, d if keep is None else d * keep)
            g |= of_layer
            d = back + sums_at(sent, self.dst, self.src)
        return g


@dataclass
class Piece:
    """Some packed graphs of one minibatch, as Arrow columns."""

    rows: pa.RecordBatch
    batch: int = 0

    @cached_property
    def union(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return union_of(self.rows)

    def aimed(self, target: int) -> Piece:
        """The same graphs with one of several targets."""
        x, y, src, dst = self.union
        piece = Piece(self.rows, self.batch)
        piece.union = x, y[:, [target]], src, dst
        return piece

    def seed(self) -> int:
        return int(pd.util.hash_pandas_object(self.rows.column("graph_id").to_pandas(), index=False).sum() & 0x7FFFFFFF)


def _lists(rows: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(where each row's list starts, with the end; the values one after the other, numbers or lists as a matrix)."""
    column = rows.column(name)
    values, lengths = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if pa.types.is_list(values.type):
        width = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        if len(width) and (width != width[0]).any():
            raise ValueError(f"{name} differs in width")
        flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(width), int(width[0]) if len(width) else 0)
    else:
        flat = values.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), flat


def union_of(batch: pa.RecordBatch | pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, src, dst of a disjoint union of packed graphs."""
    if isinstance(batch, pd.DataFrame):
        batch = pa.RecordBatch.from_pandas(batch[["ids", "x", "y", "src", "dst"]], preserve_index=False)
    first, ids = _lists(batch, "ids")

    def at(name: str) -> np.ndarray:
        starts, ends = _lists(batch, name)
        found = [np.searchsorted(ids[a:b], ends[c:d]) + a for a, b, c, d in zip(first, first[1:], starts, starts[1:])]
        return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)

    return _lists(batch, "x")[1], _lists(batch, "y")[1], at("src"), at("dst")


def pieces(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[Piece]:
    """Packed graphs in their order, cut where their ``batch`` changes and where they have ``most`` nodes and edges (``PIECE``)."""
    most = most or PIECE
    for rows in batches:
        size = sum(rows.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "src"))
        of = rows.column("batch").to_numpy() if "batch" in rows.schema.names else np.zeros(len(size), int)
        start, held = 0, 0
        for i, n in enumerate(size):
            if i > start and (held + n > most or of[i] != of[start]):
                yield Piece(rows.slice(start, i - start), int(of[start]))
                start, held = i, 0
            held += n
        if start < len(size):
            yield Piece(rows.slice(start), int(of[start]))


class Minibatch:
    """A task's pieces of minibatch ``number`` from a stream in the minibatches' order (``ahead`` holds the piece that comes next).

    They can be gone through once, or, with ``again``, any number of times: the first pass writes them down, in memory or, beyond ``SPOOL`` bytes, in a file.
    """

    def __init__(self, stream: Iterator[Piece], ahead: list[Piece], number: int, again: bool):
        self.stream, self.ahead, self.number = stream, ahead, number
        self.kept = SpooledTemporaryFile(SPOOL) if again else None
        self.read = False

    def _next(self) -> Piece | None:
        if not self.ahead:
            self.ahead.extend(p for p in [next(self.stream, None)] if p is not None)
        return self.ahead.pop() if self.ahead and self.ahead[0].batch == self.number else None

    def __iter__(self) -> Iterator[Piece]:
        if self.read:
            if self.kept is None:
                raise RuntimeError("the pieces have been read")
            self.kept.seek(0)
            while True:
                try:
                    rows = pickle.load(self.kept)
                except EOFError:
                    return
                yield Piece(rows, self.number)
        self.read = True
        while (piece := self._next()) is not None:
            if self.kept is not None:
                pickle.dump(piece.rows, self.kept)
            yield piece

    def summed(self, per_piece: Callable[[Piece], np.ndarray], width: int) -> np.ndarray:
        return sum((per_piece(p) for p in self), np.zeros(width))

    def close(self) -> None:
        if self.kept is not None:
            self.kept.close()


def minibatches(stream: Iterator[Piece], again: bool) -> Iterator[Minibatch]:
    """The minibatches of a stream in their order, each gone through before the next one."""
    ahead = [p for p in [next(stream, None)] if p is not None]
    while ahead:
        yield Minibatch(stream, ahead, ahead[0].batch, again)


def loss_and_slope(out: np.ndarray, y: np.ndarray, cfg: TrainConfig, pos_weight: np.ndarray | None) -> tuple[float, np.ndarray]:
    """Summed loss and its derivative: Huber or squared, or logistic with positive weights (y are 0 or 1)."""
    if pos_weight is not None:
        p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
        loss = -(pos_weight * y * np.log(p + 1e-15) + (1 - y) * np.log(1 - p + 1e-15))
        return float(loss.mean(1).sum()), (p * (1 - y) - pos_weight * y * (1 - p)) / y.shape[1]
    e = out - y
    if cfg.loss == "mse":
        return float((e * e).sum()), 2 * e
    if cfg.huber_delta == 0:
        return float((0.5 * e * e).sum()), e
    near = np.minimum(np.abs(e), cfg.huber_delta)
    return float((0.5 * near**2 + cfg.huber_delta * (np.abs(e) - near)).sum()), np.clip(e, -cfg.huber_delta, cfg.huber_delta)


def penalty_and_slope(m: np.ndarray, mode: str, eps: float = 1e-12) -> tuple[float, tuple[float, float, float]]:
    """Calibration penalty from moments (n, sum r, sum y, sum ry, sum rr, sum yy), and (a, b, c): d/dr = a * r + b * y + c."""
    n, sr, sy, sry, srr, syy = m
    c, vr, vy = sry - sr * sy / n, srr - sr * sr / n, syy - sy * sy / n
    if mode == "cov":
        g = 2 * (c / n) / n
        return float((c / n) ** 2), (0.0, g, -g * sy / n)
    d = max(vr * vy, eps)
    by_y, by_r = 2 * c / d, (-2 * c * c * vy / d**2 if vr * vy > eps else 0.0)
    return float(c * c / d), (by_r, by_y, -by_y * sy / n - by_r * sr / n)


def _summed(rows: DataFrame, per_batch: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """Sum over partitions of the vectors that ``per_batch`` makes of Arrow batches of rows.

    Executors add the partitions' vectors position by position; ``width`` numbers reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(width)
        for batch in batches:
            if len(batch):
                sums += per_batch(batch)
        yield pd.DataFrame({"v": [sums]})

    return _added(rows.mapInPandas(run, "v array<double>"), width)


def _packed_sums(packed: DataFrame, per_piece: Callable[[Piece], np.ndarray], width: int) -> np.ndarray:
    """``_summed`` of packed graphs, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sum((per_piece(p) for p in pieces(batches)), np.zeros(width))
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["v"])

    return _added(packed.mapInArrow(run, "v array<double>"), width)


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The vectors ``v`` of all partitions added position by position."""
    out = np.zeros(width)
    for i, v in parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def step_sums(model: Sage | Gin, packed: DataFrame, cfg: TrainConfig, learn: bool, epoch: int, pos_weight: np.ndarray | None = None, frozen: bool = False) -> tuple:
    """(mean loss, mean absolute error or micro error rate, nodes, gradient of the mean loss, moments by layer) of one batch of packed graphs.

    ``moments`` are those of batch norm while learning; ``frozen`` learns without dropout and with the stored ones.
    """
    return sums_by(lambda per_piece, width: _packed_sums(packed, per_piece, width), model, cfg, learn, epoch, pos_weight, frozen)


def sums_by(summed: Callable[[Callable[[Piece], np.ndarray], int], np.ndarray], model: Sage | Gin, cfg: TrainConfig, learn: bool, epoch: int, pos_weight: np.ndarray | None = None, frozen: bool = False) -> tuple:
    """``step_sums`` for any way of adding up vectors: ``summed`` gives the sum of a function of packed graphs (and its width) over the minibatch."""
    names = trainable(model)
    width = 3 + (sum(model.weights[k].size for k in names) if learn else 0)
    drop = cfg.dropout if learn and not frozen else 0.0
    moments: list | None = [] if learn and not frozen and getattr(model, "norm", None) == "batch" else None

    def tape_of(piece: Piece, **more) -> tuple[Tape | GinTape, np.ndarray]:
        x, y, src, dst = piece.union
        rng = np.random.default_rng([cfg.seed, epoch, piece.seed()]) if drop else None
        if isinstance(model, Gin):
            return GinTape(model, x, src, dst, drop, rng), y
        return Tape(model, x, src, dst, drop, rng, moments, **more), y

    for k in range(model.layers if moments is not None else 0):

        def of_layer(piece: Piece, k=k) -> np.ndarray:
            z = tape_of(piece, upto=k)[0].z
            return np.concatenate([[len(z)], z.sum(0), (z * z).sum(0)])

        v = summed(of_layer, 1 + 2 * model.hidden)
        mean, square = np.split(v[1:] / max(v[0], 1), 2)
        moments.append((mean, np.maximum(square - mean * mean, 0)))

    penalty, slope, rows = 0.0, None, 0.0
    if cfg.calibration_weight and pos_weight is None:

        def of_penalty(piece: Piece) -> np.ndarray:
            tape, y = tape_of(piece)
            r = tape.output - y
            return np.array([r.size, r.sum(), y.sum(), (r * y).sum(), (r * r).sum(), (y * y).sum()])

        m = summed(of_penalty, 6)
        if rows := m[0]:
            penalty, slope = penalty_and_slope(m, cfg.calibration_mode)

    def sloped(tape: Tape | GinTape, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss, and the slope of the summed loss and penalty."""
        loss, d = loss_and_slope(tape.output, y, cfg, pos_weight)
        if slope is not None:
            a, b, c = slope
            d = d + rows * cfg.calibration_weight * (a * (tape.output - y) + b * y + c)
        return loss, d

    means: dict[int, tuple] = {}
    for k in reversed(range(model.layers if moments is not None else 0)):

        def of_back(piece: Piece, k=k) -> np.ndarray:
            tape, y = tape_of(piece)
            return np.append(tape.gradient(sloped(tape, y)[1], means, upto=k), len(y))

        v = summed(of_back, 2 * model.hidden + 1)
        means[k] = tuple(np.split(v[:-1] / max(v[-1], 1), 2))

    def sums(piece: Piece) -> np.ndarray:
        tape, y = tape_of(piece)
        loss, d = sloped(tape, y)
        error = np.abs(tape.output - y).mean(1).sum() if pos_weight is None else ((tape.output >= 0) != (y > 0.5)).mean(1).sum()
        head = np.array([loss, error, len(y)])
        if not learn:
            return head
        parts = tape.gradient(d, means) if moments is not None else tape.gradient(d)
        return np.concatenate([head, *(parts[k].ravel() for k in names)])

    v = summed(sums, width)
    n = max(int(v[2]), 1)
    gradient = None
    if learn:
        gradient, at = {}, 3
        for k in names:
            size = model.weights[k].size
            gradient[k] = v[at : at + size].reshape(model.weights[k].shape) / n
            at += size
    return v[0] / n + cfg.calibration_weight * penalty, v[1] / n, int(v[2]), gradient, moments


def _arrays(batch: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [np.stack(batch[n].to_numpy()) for n in names]


def _array_udf(apply: Callable[..., np.ndarray]):
    """An Arrow-batched function of array<double> columns."""

    @F.pandas_udf("array<double>")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(apply(*(np.stack(c.to_numpy()) for c in columns))))

    return run


@dataclass
class Joined:
    """A set for training by joins: nodes (with ``batch``, where they are dealt), edges laid out along and against their direction."""

    nodes: DataFrame
    forward: Wiring
    back: Wiring | None = None

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, learn: bool = True) -> Joined:
        against = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        return cls(nodes, Wiring.of(nodes, edges), Wiring.of(nodes, against) if learn else None)


def drop_masks(keys: np.ndarray, width: int, share: float, *salt: int) -> np.ndarray:
    """Rows of 0 and 1 / (1 - share) by hash of each node's key, so that a step's way forward and back agree."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for n in salt:
            h = (h ^ (h >> np.uint64(30)) ^ np.uint64(n & 0xFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(11)) * 2.0**-53 >= share) / (1 - share)


def joined_sums(model: Sage | Gin, data: Joined, cfg: TrainConfig, learn: bool, epoch: int, pos_weight: np.ndarray | None = None, frozen: bool = False, batch: int | None = None) -> tuple:
    """What ``step_sums`` gives, by joins over nodes and edges in place of a row for each graph.

    A layer's neighbour sums are a pass over the edges' layout, and slopes go back over the reverse one; so a graph
    may have any number of nodes.  Each layer is written to the shared folder on the way forward and on the way back.
    ``batch`` takes the nodes of one minibatch.
    """
    is_gin, names = isinstance(model, Gin), trainable(model)
    batched = learn and not frozen and getattr(model, "norm", None) == "batch"
    drop = cfg.dropout if learn and not frozen else 0.0
    moments: list | None = [] if batched else None
    nodes = data.nodes if batch is None else data.nodes.where(F.col("batch") == batch)
    y = F.col("y") if dict(nodes.dtypes)["y"].startswith("array") else F.array(F.col("y").cast("double"))
    cast = lambda c: F.transform(c, lambda v: v.cast("double"))
    key = F.array(F.xxhash64("graph_id", "node_id"))
    rows = nodes.where("graph_id is not null").select("graph_id", "node_id", cast("x").alias("_h"))

    def output(k: int, h: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, tuple]:
        if is_gin:
            return gin_out(model, k, h, near)
        return sage_out(model, k, h, sage_sums(model, k, h, near), moments[k] if batched else None)

    def mask(k: int, keys: np.ndarray, width: int) -> np.ndarray | float:
        return drop_masks(keys[:, 0], width, drop, cfg.seed, epoch, k) if drop else 1.0

    layers, width = [], model.n_markers
    for k in range(model.layers):
        passed = data.forward.passed(rows, "_h", width, "sum" if is_gin else "mean", degree=True)
        met = checkpointed(passed.select("graph_id", "node_id", F.col("own").alias("_h"), F.col("near").alias("_near"), F.array(F.greatest("degree", F.lit(1)).cast("double")).alias("_deg"), key.alias("_key")))
        layers.append(met)
        if batched:

            def of_layer(batch: pd.DataFrame, k=k) -> np.ndarray:
                z = sage_sums(model, k, *_arrays(batch, "_h", "_near"))
                return np.concatenate([[len(z)], z.sum(0), (z * z).sum(0)])

            v = _summed(met, of_layer, 1 + 2 * model.hidden)
            mean, square = np.split(v[1:] / max(v[0], 1), 2)
            moments.append((mean, np.maximum(square - mean * mean, 0)))
        step = _array_udf(lambda h, near, keys, k=k: output(k, h, near)[0] * mask(k, keys, model.hidden))
        rows, width = met.select("graph_id", "node_id", step("_h", "_near", "_key").alias("_h")), model.hidden
    last = checkpointed(rows.join(nodes.select("graph_id", "node_id", cast(y).alias("_y")), ["graph_id", "node_id"]))

    def scored(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, y = _arrays(batch, "_h", "_y")
        return h, h @ model.weights["head"] + model.weights["head.bias"], y

    penalty, slope, n_rows = 0.0, None, 0.0
    if cfg.calibration_weight and pos_weight is None:

        def of_penalty(batch: pd.DataFrame) -> np.ndarray:
            _, out, y = scored(batch)
            r = out - y
            return np.array([r.size, r.sum(), y.sum(), (r * y).sum(), (r * r).sum(), (y * y).sum()])

        m = _summed(last, of_penalty, 6)
        if n_rows := m[0]:
            penalty, slope = penalty_and_slope(m, cfg.calibration_mode)

    def sloped(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        loss, d = loss_and_slope(out, y, cfg, pos_weight)
        if slope is not None:
            a, b, c = slope
            d = d + n_rows * cfg.calibration_weight * (a * (out - y) + b * y + c)
        return loss, d

    def of_head(batch: pd.DataFrame) -> np.ndarray:
        h, out, y = scored(batch)
        loss, d = sloped(out, y)
        error = np.abs(out - y).mean(1).sum() if pos_weight is None else ((out >= 0) != (y > 0.5)).mean(1).sum()
        return np.concatenate([[loss, error, len(y)], (h.T @ d).ravel(), d.sum(0)])

    head = model.weights["head"]
    v = _summed(last, of_head, 3 + head.size + head.shape[1])
    n = max(int(v[2]), 1)
    result = v[0] / n + cfg.calibration_weight * penalty, v[1] / n, int(v[2])
    if not learn:
        return *result, None, None
    gradient = {"head": v[3 : 3 + head.size].reshape(head.shape), "head.bias": v[3 + head.size :]}
    d_head = _array_udf(lambda h, y: sloped(h @ head + model.weights["head.bias"], y)[1] @ head.T)
    back = last.select("graph_id", "node_id", d_head("_h", "_y").alias("_d"))
    for k in reversed(range(model.layers)):
        met = checkpointed(layers[k].join(back, ["graph_id", "node_id"]))
        means = None

        def masked(d: np.ndarray, keys: np.ndarray, k=k) -> np.ndarray:
            return d * mask(k, keys, model.hidden)

        if batched:

            def of_means(batch: pd.DataFrame, k=k, masked=masked) -> np.ndarray:
                h, near, d, keys = _arrays(batch, "_h", "_near", "_d", "_key")
                kept = output(k, h, near)[1]
                du = sage_unit_slope(model, k, kept, masked(d, keys))
                return np.concatenate([[len(d)], du.sum(0), (du * kept[0]).sum(0)])

            v = _summed(met, of_means, 1 + 2 * model.hidden)
            means = tuple(np.split(v[1:] / max(v[0], 1), 2))

        def through(h: np.ndarray, near: np.ndarray, d: np.ndarray, keys: np.ndarray, k=k, means=means, masked=masked) -> tuple[dict, np.ndarray, np.ndarray]:
            kept, d = output(k, h, near)[1], masked(d, keys)
            return gin_back(model, k, kept, d) if is_gin else sage_back(model, k, h, near, kept, d, means)

        mine = [name for name in names if name.startswith(f"l{k}.") or (k == 0 and name == "project")]

        def of_weights(batch: pd.DataFrame, through=through, mine=mine) -> np.ndarray:
            g = through(*_arrays(batch, "_h", "_near", "_d", "_key"))[0]
            return np.concatenate([g[name].ravel() for name in mine])

        v, at = _summed(met, of_weights, sum(model.weights[name].size for name in mine)), 0
        for name in mine:
            size = model.weights[name].size
            gradient[name] = v[at : at + size].reshape(model.weights[name].shape)
            at += size
        if k:
            own = _array_udf(lambda h, near, d, keys, through=through: through(h, near, d, keys)[1])
            sent = _array_udf(lambda h, near, d, keys, deg, through=through: through(h, near, d, keys)[2] / (1.0 if is_gin else deg))
            moved = checkpointed(met.select("graph_id", "node_id", own("_h", "_near", "_d", "_key").alias("_own"), sent("_h", "_near", "_d", "_key", "_deg").alias("_sent")))
            got = data.back.passed(moved, "_sent", model.hidden, "sum").join(moved.drop("_sent"), ["graph_id", "node_id"])
            back = got.select("graph_id", "node_id", F.zip_with("_own", "near", lambda a, b: a + b).alias("_d"))
    return *result, {name: gradient[name] / n for name in names}, moments


class AdamW:
    """Decoupled weight decay, moments 0.9 and 0.999, gradients clipped to a global norm if there is one."""

    def __init__(self, cfg: TrainConfig):
        self.cfg, self.t, self.m, self.v = cfg, 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], gradient: dict[str, np.ndarray]) -> None:
        scale = 1.0
        if self.cfg.clip_norm is not None:
            scale = min(1.0, self.cfg.clip_norm / (np.sqrt(sum((g * g).sum() for g in gradient.values())) + 1e-6))
        self.t += 1
        for k, g in gradient.items():
            g = g * scale
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            weights[k] = weights[k] * (1 - self.cfg.lr * self.cfg.weight_decay) - self.cfg.lr * m / (np.sqrt(v) + 1e-8)


def _remember(model: Sage | Gin, moments: list | None, n: int) -> None:
    """Move batch norm's stored statistics towards a step's (the variance of a sample)."""
    for k, (mean, var) in enumerate(moments or []):
        for name, value in ((f"l{k}.mean", mean), (f"l{k}.var", var * n / max(n - 1, 1))):
            model.weights[name] = (1 - MOMENTUM) * model.weights[name] + MOMENTUM * value


@dataclass
class TrainState:
    """What a run goes on from: weights and moments after an epoch, the best weights, and the history."""

    weights: dict[str, np.ndarray]
    best: dict[str, np.ndarray]
    m: dict[str, np.ndarray] = field(default_factory=dict)
    v: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0
    best_error: float = float("inf")
    waited: int = 0
    history: list[dict] = field(default_factory=list)

    def judge(self, weights: dict[str, np.ndarray], error: float) -> None:
        """Keep an epoch's weights if its error is the least so far."""
        if error < self.best_error - 1e-7:
            self.best, self.best_error, self.waited = deepcopy(weights), float(error), 0
        else:
            self.waited += 1

    def rows(self) -> list[tuple]:
        """(kind, name, shape, values) of everything, as large as four models."""
        out = [(kind, k, list(w.shape), w.ravel().tolist()) for kind in ("weights", "best", "m", "v") for k, w in getattr(self, kind).items()]
        told = {"steps": self.steps, "best_error": self.best_error, "waited": self.waited, "history": self.history}
        return [*out, ("told", json.dumps(told), [], [])]

    @classmethod
    def of_rows(cls, rows: list) -> TrainState:
        parts: dict[str, dict] = {"weights": {}, "best": {}, "m": {}, "v": {}}
        told = {}
        for kind, name, shape, values in rows:
            if kind == "told":
                told = json.loads(name)
            else:
                parts[kind][name] = np.array(values, float).reshape(shape)
        return cls(**parts, **told)


STATE = "kind string, name string, shape array<int>, v array<double>"


def save_state(spark: SparkSession, path: str, state: TrainState) -> None:
    """Append the state after its last epoch as one file: it is there as a whole or not at all."""
    rows = spark.createDataFrame(state.rows(), STATE).withColumn("epoch", F.lit(state.history[-1]["epoch"]))
    rows.coalesce(1).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str) -> TrainState | None:
    """The last state in the folder, None if there is none."""
    try:
        every = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    last = every.agg(F.max("epoch")).first()[0]
    # A step written twice (a job run again) gives equal rows.
    return TrainState.of_rows(every.where(F.col("epoch") == last).select("kind", "name", "shape", "v").distinct().collect()) if last is not None else None


def take_step(summed: Callable[[Callable[[Piece], np.ndarray], int], np.ndarray], model: Sage | Gin, adam: AdamW, cfg: TrainConfig, epoch: int, pos_weight: np.ndarray | None = None) -> np.ndarray:
    """The step of a minibatch, taken on ``model`` and ``adam``; returns the sums of loss and error by nodes, and the nodes."""
    loss, error, n, gradient, moments = sums_by(summed, model, cfg, True, epoch, pos_weight)
    if not n:
        return np.zeros(3)
    adam.step(model.weights, gradient)
    _remember(model, moments, n)
    return np.array([loss * n, error * n, n])


def barrier_epoch(
    model: Sage | Gin, adam: AdamW, dealt: DataFrame, cfg: TrainConfig, epoch: int, batches: int, pos_weight: np.ndarray | None = None, tasks: int = 4, relay: bool = False
) -> np.ndarray:
    """One epoch over packed graphs with ``batch`` as a single job; returns the sums of loss and error by nodes, and the nodes.

    ``tasks`` tasks run at the same time and stream their graphs.  They share each minibatch and hand each other their sums (batch norm's moments, the
    penalty's, loss and gradient), so all take the same step on weights of their own; or, with ``relay``, each holds whole minibatches, one range of
    them after the other, takes their steps when it is its turn, and hands weights and moments on.  The steps are the same.  The last one returns weights and
    moments.  What is handed over goes to every task as a text of 11 bytes a number, so tasks are meant to be some dozens.  If a task is
    lost, Spark runs all of them again from the epoch's start.
    """
    weights, moments = deepcopy(model.weights), (adam.t, dict(adam.m), dict(adam.v))
    again = getattr(model, "norm", None) == "batch" or bool(cfg.calibration_weight)

    def run(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, mine, own = BarrierTaskContext.get(), deepcopy(model), AdamW(cfg)
        mine.weights, (own.t, own.m, own.v) = dict(weights), moments
        stream, ahead, totals = pieces(batched), [], np.zeros(3)

        def step(b: int) -> None:
            part = Minibatch(stream, ahead, b, again)

            def shared(per_piece: Callable[[Piece], np.ndarray], width: int) -> np.ndarray:
                v = part.summed(per_piece, width)
                return sum(np.frombuffer(b64decode(t)) for t in context.allGather(b64encode(v.tobytes()).decode()))

            totals[:] += take_step(part.summed if relay else shared, mine, own, cfg, epoch, pos_weight)
            part.close()

        me, last = context.partitionId(), tasks - 1
        for turn in range(tasks if relay else 1):
            if not relay or turn == me:
                for b in range(*(_turn(turn, batches, tasks) if relay else (0, batches))):
                    step(b)
            if relay and turn < last:
                told = b64encode(pickle.dumps((mine.weights, own.t, own.m, own.v, totals))).decode() if turn == me else ""
                mine.weights, own.t, own.m, own.v, totals = pickle.loads(b64decode(context.allGather(told)[turn]))
        if me == last:
            rows = [*TrainState(mine.weights, {}, own.m, own.v, own.t).rows(), ("totals", "", [3], totals.tolist())]
            kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "name", "shape", "v"])

    # The partitions are the tasks: all must fit in the cluster at once.
    if relay:
        spread = dealt.repartitionById(tasks, _turn_of(tasks, batches))
    else:
        spread = dealt.repartition(tasks, "graph_id")
    rows = spread.sortWithinPartitions("batch", "graph_id").mapInArrow(run, STATE, barrier=True).collect()
    state = TrainState.of_rows([r for r in rows if r["kind"] != "totals"])
    model.weights, adam.t, adam.m, adam.v = state.weights, state.steps, state.m, state.v
    return np.array(next(r["v"] for r in rows if r["kind"] == "totals"))


def _turn(turn: int, batches: int, tasks: int) -> tuple[int, int]:
    """The minibatches from and up to which a task takes the steps in a relay."""
    return batches * turn // tasks, batches * (turn + 1) // tasks


def _turn_of(turns: int, batches: int) -> Column:
    """The turn that holds a row's minibatch: the inverse of ``_turn``."""
    return F.expr(f"cast((cast(batch as bigint) * {turns} + {turns - 1}) div {batches} as int)")


def prepared(data: tuple[DataFrame, DataFrame] | DataFrame | Joined, by: str, learn: bool = True) -> DataFrame | Joined:
    """What runs read, made once for any number of them: packed graphs or, by 'joins', nodes and laid out edges."""
    if not isinstance(data, tuple):
        return data
    return Joined.of(*map(checkpointed, data), learn=learn) if by == "joins" else checkpointed(packed_graphs(*data))


def _dealer(learn: DataFrame, cfg: TrainConfig) -> tuple[int, Callable[[int], DataFrame], DataFrame]:
    """(minibatches an epoch, what deals an epoch's rows into them as ``batch``, the rows)."""
    if not cfg.batch_size:
        return cfg.batches, lambda epoch: with_minibatch(learn, cfg.batches, epoch, cfg.seed), learn
    ranked = checkpointed(hash_rank(learn.select("graph_id").where("graph_id is not null").distinct(), "graph_id", cfg.seed).select("graph_id", (F.col("rank") - 1).alias("_index")))
    n, indexed = ranked.count(), checkpointed(learn.join(ranked, "graph_id"))
    return -(-n // cfg.batch_size), lambda epoch: indexed.withColumn("batch", minibatch_of_size(F.col("_index"), n, cfg.batch_size, epoch, cfg.seed)).drop("_index"), indexed


def train(
    model: Sage | Gin,
    train_set: tuple[DataFrame, DataFrame] | DataFrame | Joined,
    val_set: tuple[DataFrame, DataFrame] | DataFrame | Joined | None,
    cfg: TrainConfig = TrainConfig(),
    pos_weight: np.ndarray | None = None,
    by: str = "graph",
    state_path: str | None = None,
    tasks: int | None = None,
) -> tuple[Sage | Gin, dict, list[dict]]:
    """(model with the best state, {'val_mae'}, history rows); sets are (nodes, edges), or ``prepared``.

    Without ``val_set`` the best state is the one after the epoch of the least training error, ``val_mae`` is that error, and the history's validation columns are None.
    ``by``, ``state_path``: see the module.  ``tasks`` are those of a barrier job (at most 32 and the cluster's cores by default).
    """
    if by not in ("graph", "joins", "barrier"):
        raise ValueError(f"unknown way to train: {by}")
    joined = by == "joins"
    learn_set = prepared(train_set, by)
    learn = learn_set.nodes if joined else learn_set
    spark = learn.sparkSession
    if learn.isEmpty():
        raise ValueError("the training set is empty")
    batches, dealt, learn = _dealer(learn, cfg)
    val = prepared(val_set, by, learn=False) if val_set is not None else None
    tasks = tasks or min(32, spark.sparkContext.defaultParallelism)
    relay = by == "barrier" and batches > tasks and learn.agg(F.sum(F.size("ids"))).first()[0] <= SHARED_FROM * batches
    adam = AdamW(cfg)
    state = load_state(spark, state_path) if state_path else None
    if state is None:
        state = TrainState(model.weights, deepcopy(model.weights))
    else:
        model.weights, adam.t, adam.m, adam.v = state.weights, state.steps, state.m, state.v
    for epoch in range(len(state.history), cfg.epochs):
        if state.waited >= cfg.patience:
            break
        sums, rows = np.zeros(3), dealt(epoch)
        if by == "barrier":
            sums = barrier_epoch(model, adam, rows, cfg, epoch, batches, pos_weight, tasks, relay)
        for b in range(0 if by == "barrier" else batches):
            if joined:
                loss, error, n, gradient, moments = joined_sums(model, Joined(rows, learn_set.forward, learn_set.back), cfg, True, epoch, pos_weight, batch=b)
            else:
                loss, error, n, gradient, moments = step_sums(model, rows.where(F.col("batch") == b), cfg, True, epoch, pos_weight)
            if n:
                adam.step(model.weights, gradient)
                _remember(model, moments, n)
                sums += np.array([loss * n, error * n, n])
        train_loss, error = float(sums[0] / max(sums[2], 1)), float(sums[1] / max(sums[2], 1))
        row = {"epoch": epoch, "train_loss": train_loss, "train_mae": error, "val_loss": None, "val_mae": None}
        if val is not None:
            loss, error = (joined_sums if joined else step_sums)(model, val, cfg, False, epoch, pos_weight)[:2]
            row |= {"val_loss": float(loss), "val_mae": float(error)}
        state.history.append(row)
        state.judge(model.weights, error)
        state.weights, state.m, state.v, state.steps = model.weights, adam.m, adam.v, adam.t
        if state_path:
            save_state(spark, state_path, state)
    model.weights = state.best
    return model, {"val_mae": state.best_error}, state.history


def train_together(models: list[Sage | Gin], targets: list[int], learn: DataFrame, val: DataFrame, cfg: TrainConfig) -> list[list[dict]]:
    """Train several models on the same packed graphs, each on one of the targets that ``y`` holds; returns their histories.

    Every model takes the steps that ``train`` takes, stops on its own, and ends with its best weights.  An epoch is dealt once for all.  A turn is a job of one
    task for each model, at the same time; weights and moments reach the driver once a turn.  A job for each epoch scores the validation graphs with all models that
    still train.
    """
    if learn.isEmpty():
        raise ValueError("the training set is empty")
    context, again = learn.sparkSession.sparkContext, bool(cfg.calibration_weight) or any(getattr(m, "norm", None) == "batch" for m in models)
    batches, dealt, learn = _dealer(learn, cfg)
    turns = max(1, min(TURNS, batches, -(-(learn.agg(F.sum(F.size("ids") + F.size("src"))).first()[0] or 0) // TURN)))
    adams, states = [AdamW(cfg) for _ in models], [TrainState(m.weights, deepcopy(m.weights)) for m in models]

    def a_turn(i: int, told: Broadcast, held: RDD, turn: int, epoch: int) -> np.ndarray:
        """Take the steps of a turn on model ``i`` from what was ``told``; returns the sums of loss and error by nodes, and the nodes."""
        target = targets[i]

        def run(rows: Iterator) -> Iterator[tuple]:
            # The allocator keeps about as much freed memory as twice the largest block freed so far; else each step's arrays come from the system anew (a quarter of its time).
            np.empty(30 << 20, np.uint8)
            (model, t, m, v), adam, totals = told.value, AdamW(cfg), np.zeros(3)
            model, adam.t, adam.m, adam.v = replace(model, weights=dict(model.weights)), t, dict(m), dict(v)
            for part in minibatches(pieces(batch for (content,) in rows for batch in pa.ipc.open_stream(content)), again):
                totals += take_step(lambda per_piece, width, part=part: part.summed(lambda p: per_piece(p.aimed(target)), width), model, adam, cfg, epoch)
                part.close()
            yield model.weights, adam.t, adam.m, adam.v, totals

        ((models[i].weights, adams[i].t, adams[i].m, adams[i].v, totals),) = context.runJob(held, run, [turn])
        told.destroy()
        return totals

    with ThreadPoolExecutor(max(1, len(models))) as pool:
        for epoch in range(cfg.epochs):
            # The largest models first: where cores are fewer, the small ones fill up the end.
            going = sorted((i for i, state in enumerate(states) if state.waited < cfg.patience), key=lambda i: -models[i].num_parameters())
            if not going:
                break
            held, sums = _in_turns(dealt(epoch), turns, batches), np.zeros((len(going), 3))
            for turn in range(turns):
                told = [context.broadcast((models[i], adams[i].t, adams[i].m, adams[i].v)) for i in going]
                sums += [*pool.map(lambda i, t, turn=turn, held=held, epoch=epoch: a_turn(i, t, held, turn, epoch), going, told)]
            found = _errors([models[i] for i in going], [targets[i] for i in going], val, cfg)
            for i, of_train, (loss, error) in zip(going, sums / np.maximum(sums[:, 2:], 1), found, strict=True):
                states[i].history.append({"epoch": epoch, "train_loss": float(of_train[0]), "train_mae": float(of_train[1]), "val_loss": loss, "val_mae": error})
                states[i].judge(models[i].weights, error)
    for model, state in zip(models, states, strict=True):
        model.weights = state.best
    return [state.history for state in states]


def _in_turns(dealt: DataFrame, turns: int, batches: int) -> RDD:
    """An epoch's packed graphs in the order of their minibatches, as Arrow bytes, a part for each turn.  They are laid out once, however many jobs read a part."""

    def packed(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])

    spread = dealt.repartitionById(turns, _turn_of(turns, batches))
    return spread.sortWithinPartitions("batch", "graph_id").mapInArrow(packed, "content binary").rdd


def _errors(models: list[Sage | Gin], targets: list[int], packed: DataFrame, cfg: TrainConfig) -> list[tuple[float, float]]:
    """(mean loss, mean absolute error) of each model on its target, in one job."""
    told = packed.sparkSession.sparkContext.broadcast(models)

    def of(piece: Piece) -> np.ndarray:
        found = []
        for model, target in zip(told.value, targets, strict=True):
            x, y, src, dst = piece.aimed(target).union
            out = (GinTape if isinstance(model, Gin) else Tape)(model, x, src, dst).output
            r = out - y
            found += [loss_and_slope(out, y, cfg, None)[0], np.abs(r).sum(), r.size, r.sum(), y.sum(), (r * y).sum(), (r * r).sum(), (y * y).sum()]
        return np.array(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((of(p) for p in pieces(batches, SCORED)), np.zeros(8 * len(targets)))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    # A few numbers a part.
    sums = sum(np.array(v) for (v,) in packed.mapInArrow(run, "v array<double>").collect()).reshape(-1, 8)
    told.destroy()
    penalty = [penalty_and_slope(v[2:], cfg.calibration_mode)[0] if cfg.calibration_weight and v[2] else 0.0 for v in sums]
    return [(float(v[0] / max(v[2], 1) + cfg.calibration_weight * p), float(v[1] / max(v[2], 1))) for v, p in zip(sums, penalty, strict=True)]


def predict_markers(model: Sage, nodes: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``nodes`` with ``prob`` (per output) and ``pred`` (prob >= threshold)."""
    scored = model.transform(nodes, edges)
    prob = F.transform("yhat", sigmoid)
    return scored.withColumn("prob", prob).withColumn("pred", F.transform("prob", lambda p: (p >= threshold).cast("int")))


def strong_wolfe(at: Callable[[float], tuple], loss: float, slope: float, t: float, fall: float = 1e-4, flat: float = 0.9, tries: int = 25) -> tuple[float, tuple]:
    """(step, ``at`` of it) where the loss has fallen enough and the slope is flat enough; the lowest point tried if none is.

    ``at`` gives (loss, slope along the direction, ..) at a step.  A bracket grows by doubling, then shrinks by halving.
    """
    low, low_loss, high, best = 0.0, loss, None, None
    for _ in range(tries):
        point = at(t)
        if best is None or point[0] < best[1][0]:
            best = (t, point)
        if point[0] > loss + fall * t * slope or (low > 0 or high is not None) and point[0] >= low_loss:
            high = t
        elif abs(point[1]) <= -flat * slope:
            return t, point
        else:
            # The low end moves here; the minimum lies on the side to which the slope falls.
            if (point[1] >= 0) if high is None else (point[1] * (high - low) >= 0):
                high = low
            low, low_loss = t, point[0]
        t = 2 * t if high is None else (low + high) / 2
    return best


def lbfgs(
    model: Sage | Gin, train_set: tuple[DataFrame, DataFrame], steps: int = 60, memory: int = 100, inner: int = 20, lr: float = 0.5, cfg: TrainConfig = TrainConfig(loss="mse"), tolerance: float = 1e-12, by: str = "graph"
) -> tuple[Sage | Gin, list[dict]]:
    """Full-batch quasi-Newton training on the mean squared error, without dropout and with stored batch statistics.

    Each loss and gradient is one Spark job on packed graphs, or with ``by`` 'joins' a few over nodes and edges, for graphs of any size.

    A step makes at most ``inner`` iterations, each with a line search from ``lr`` that meets the strong Wolfe conditions; it all
    stops when the loss changes by less than ``tolerance``.  Returns the model of the least mean absolute error and a row per step.
    """
    names = trainable(model)
    data = prepared(train_set, by)
    shapes = [model.weights[k].shape for k in names]

    def put(flat: np.ndarray) -> None:
        at = 0
        for k, shape in zip(names, shapes, strict=True):
            size = int(np.prod(shape))
            model.weights[k] = flat[at : at + size].reshape(shape)
            at += size

    def at_point(flat: np.ndarray) -> tuple[float, float, np.ndarray]:
        put(flat)
        loss, error, _, g, _ = (joined_sums if by == "joins" else step_sums)(model, data, cfg, True, 0, frozen=True)
        return loss, error, np.concatenate([g[k].ravel() for k in names])

    x = np.concatenate([model.weights[k].ravel() for k in names])
    loss, error, g = at_point(x)
    best, best_error, pairs, history, settled = x, error, [], [{"epoch": 0, "train_loss": loss, "train_mae": error}], False
    for step in range(1, steps + 1):
        for _ in range(inner):
            d, alphas = -g, []
            for s, y in reversed(pairs):
                alphas.append((s @ d) / (s @ y))
                d = d - alphas[-1] * y
            if pairs:
                s, y = pairs[-1]
                d = d * (s @ y) / (y @ y)
            for (s, y), a in zip(pairs, reversed(alphas), strict=True):
                d = d + s * (a - (y @ d) / (s @ y))

            def along(t: float, x=x, d=d) -> tuple:
                new_loss, new_error, new_g = at_point(x + t * d)
                return new_loss, new_g @ d, new_error, new_g

            t, (new_loss, _, new_error, new_g) = strong_wolfe(along, loss, g @ d, lr * (1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))))
            if not new_loss < loss:
                settled = True
                break
            s, y = t * d, new_g - g
            if s @ y > 1e-10:
                pairs = [*pairs, (s, y)][-memory:]
            settled, x, loss, error, g = loss - new_loss < tolerance, x + s, new_loss, new_error, new_g
            if settled:
                break
        history.append({"epoch": step, "train_loss": loss, "train_mae": error})
        if error < best_error:
            best, best_error = x, error
        if settled:
            break
    put(best)
    return model, history


def epoch_sweep(
    budgets: list[int], data: tuple[DataFrame, DataFrame], n_markers: int, hidden: int = 16, layers: int = 2, optimizer: str = "lbfgs", steps: int = 60, cfg: TrainConfig | None = None, seed: int = 0, by: str = "graph"
) -> list[dict]:
    """One model per budget, fitted to and scored on the same graphs (usually one): rows of epochs, mse, mae.

    With 'lbfgs' the budget is the iterations that each of ``steps`` steps may make; with 'adamw' it is the epochs of a full-batch
    run on the mean squared error that keeps the state of the least training error.
    """
    rows = []
    for budget in budgets:
        model = Sage(n_markers, hidden, layers).init(seed)
        if optimizer == "lbfgs":
            model, _ = lbfgs(model, data, steps, inner=budget, by=by, **({"cfg": cfg} if cfg else {}))
        elif optimizer == "adamw":
            model, _, _ = train(model, data, None, replace(cfg or TrainConfig(loss="mse", lr=3e-3, weight_decay=0.0, clip_norm=None), epochs=budget, patience=budget), by=by)
        else:
            raise ValueError(f"unknown optimizer: {optimizer}")
        e = F.col("yhat") - F.col("y")
        mse, mae = model.transform(*data).agg(F.avg(e * e), F.avg(F.abs(e))).first()
        rows.append({"epochs": budget, "mse": mse, "mae": mae})
    return rows


def depth_scan(
    depths: list[int], train_set: tuple[DataFrame, DataFrame], val_set: tuple[DataFrame, DataFrame], markers: DataFrame, hidden: int = 16, cfg: TrainConfig = TrainConfig(), seed: int = 0, min_pos: int = 10, by: str = "graph"
) -> DataFrame:
    """Relative MSE per marker over graphs, for models of several depths fitted to the raw and to the residual target.

    Rows: ``kind`` ('baseline', 'raw' or 'residual'), ``split``, ``depth`` (0 for the baseline), ``marker_id``, ``rel_mean``,
    ``rel_sem``, ``n_graphs``.  Residual targets take marker means of the training nodes, and their predictions have them added
    back; errors are relative to the means over training and validation nodes together, which the baseline predicts too.
    ``by`` is a way of ``train``, one model after the other, or 'relay': all models side by side, on graphs packed once with both targets.
    """
    own = checkpointed(marker_baseline(train_set[0], markers))
    pooled = checkpointed(marker_baseline(train_set[0].unionByName(val_set[0]), markers, empty="zero"))
    n_markers = own.count()
    sets = {"train": train_set, "val": val_set}
    raw = {split: prepared(data, by, learn=split == "train") for split, data in sets.items()} if depths else {}
    models = [(kind, depth, Sage(n_markers, hidden, depth).init(seed)) for depth in depths for kind in ("raw", "residual")]
    if by == "relay" and depths:
        # As many parts as there are cores at least: small sets are packed into fewer, and every epoch scores one of them.
        parts = {split: max(data.sparkSession.sparkContext.defaultParallelism, data.rdd.getNumPartitions()) for split, data in raw.items()}
        raw = {split: checkpointed(_both(data, own).repartition(parts[split], "graph_id")) for split, data in raw.items()}
        train_together([model for _, _, model in models], [int(kind == "residual") for kind, _, _ in models], raw["train"], raw["val"], cfg)
    elif depths:
        of_kind = {"raw": raw, "residual": {split: _residual(data, own) for split, data in raw.items()}}
        for kind, _, model in models:
            train(model, of_kind[kind]["train"], of_kind[kind]["val"], cfg, by=by)

    def told(rows: DataFrame, split: str) -> DataFrame:
        return rows.select("kind", F.lit(split).alias("split"), "depth", "marker_id", "rel_mean", "rel_sem", "n_graphs")

    out = []
    for split, (nodes, _) in sets.items():
        rows = relative_mse_across_graphs(nodes.withColumn("yhat", F.col("y")), pooled, min_pos, against="baseline")
        out.append(told(rows.withColumns({"kind": F.lit("baseline"), "depth": F.lit(0)}), split))
    for split in raw:
        # The figures are a few rows; their shuffles aren't kept.
        if by == "joins":
            for kind, depth, model in models:
                scored = with_baseline(model.transform(sets[split][0], sets[split][1], raw[split].forward), own, "_b")
                scored = scored.withColumn("yhat", F.col("yhat") + (F.col("_b") if kind == "residual" else 0.0))
                out.append(told(checkpointed(relative_mse_across_graphs(scored, pooled, min_pos)).withColumns({"kind": F.lit(kind), "depth": F.lit(depth)}), split))
        else:
            scored = with_baseline(packed_scores(raw[split], [model for _, _, model in models]), own, "_b")
            added = [F.when(F.col("graph_id").isNotNull(), F.get("yhat", F.lit(i)) + (F.col("_b") if kind == "residual" else 0.0)) for i, (kind, _, _) in enumerate(models)]
            each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), yhat.alias("yhat")) for (kind, depth, _), yhat in zip(models, added, strict=True)]))
            rows = scored.select("graph_id", "x", "y", each.alias("_m")).select("graph_id", "x", "y", "_m.*")
            out.append(told(checkpointed(relative_mse_across_graphs(rows, pooled, min_pos, by=["kind", "depth"])), split))
    return reduce(DataFrame.unionByName, out)


def _residual(data: DataFrame | Joined, baseline: DataFrame) -> DataFrame | Joined:
    """Prepared graphs with each target less its baseline; nothing is packed or laid out again."""
    if isinstance(data, Joined):
        return replace(data, nodes=residualize(data.nodes, baseline))
    mu = baseline_means(baseline)
    base = lambda x: baseline_of(x, F.col("_mu"), F.col("_none"))
    rest = F.zip_with("y", "x", lambda y, x: F.transform(y, lambda v: v - base(x)))
    return data.crossJoin(F.broadcast(mu)).withColumn("y", rest).drop("_mu", "_none")


def _both(packed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Packed graphs with two targets for each node: its own and the one less its baseline."""
    return _residual(packed.withColumn("_y", F.col("y")), baseline).withColumn("y", F.zip_with("_y", "y", lambda a, b: F.concat(a, b))).drop("_y")


def packed_scores(packed: DataFrame, models: list[Sage | Gin]) -> DataFrame:
    """``graph_id``, ``node_id``, ``x``, ``y`` of the nodes of packed graphs, and ``yhat``: each model's output, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, SCORED):
            x, y, src, dst = piece.union
            yhat = np.stack([(GinTape if isinstance(m, Gin) else Tape)(m, x, src, dst).output[:, 0] for m in models], 1)
            first, ids = _lists(piece.rows, "ids")
            rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(np.ascontiguousarray(a).reshape(-1)))
            columns = [piece.rows.column("graph_id").take(pa.array(rows)), pa.array(ids), lists(x), pa.array(y[:, 0]), lists(yhat)]
            yield pa.RecordBatch.from_arrays(columns, names=["graph_id", "node_id", "x", "y", "yhat"])

    return packed.mapInArrow(run, "graph_id string, node_id bigint, x array<double>, y double, yhat array<double>")
