"""Graphs from arrays in memory, and minibatches of graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom import schema


def build_graph(spark: SparkSession, graph_id: str, x: Sequence[Sequence[float]], y: Sequence[float], edges: Sequence[tuple[int, int]] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, raw edges) of one small graph; lengths must agree and y must be finite."""
    if len(x) != len(y):
        raise ValueError("x and y differ in length")
    if any(v != v or abs(v) == float("inf") for v in y):
        raise ValueError("y is not finite")
    nodes = [(graph_id, i, [float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))]
    pairs = [(graph_id, int(u), int(v)) for u, v in edges]
    return spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(pairs, "graph_id string, u bigint, v bigint")


def permuted(index: Column, n: int, *key: int) -> Column:
    """A permutation of 0 .. n - 1 chosen by ``key``, computed from each index alone.

    Four Feistel rounds permute the numbers of as many bits as n - 1 has; a result of n or more is permuted again until it falls below n.  At least
    half of all results do each time; should one not within 64 times, the query fails rather than repeat a number.
    """
    bits = max(2, (n - 1).bit_length())
    low, high = bits // 2, bits - bits // 2
    rounds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(low, high), (high, low)] * 2)])

    def one_round(v: Column, r: Column) -> Column:
        left, right = F.call_function("shiftright", v, r["b"]), v.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), r["b"]) - 1)
        mixed = F.xxhash64(right, r["i"], *[F.lit(k) for k in key]).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), r["a"]) - 1)
        return F.call_function("shiftleft", right, r["a"]).bitwiseOR(left.bitwiseXOR(mixed))

    once = lambda v: F.aggregate(rounds, v.cast("long"), one_round)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(63)), once(index), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no place found in the permutation: take another seed")).cast("long"))


def minibatch_of_size(index: Column, n: int, size: int, epoch: int = 0, seed: int = 0) -> Column:
    """Number of the minibatch of each graph by its ``index`` (0 .. n - 1): every one has ``size`` graphs, the last one what is left; another order each epoch."""
    return F.floor(permuted(index, n, seed, epoch) / size).cast("int")


def with_minibatch(graphs: DataFrame, batches: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """``batch`` of each graph, dealt anew each epoch by a hash."""
    return graphs.withColumn("batch", F.pmod(F.xxhash64("graph_id", F.lit(epoch), F.lit(seed)), F.lit(batches)).cast("int"))
