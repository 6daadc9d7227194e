"""Binning by the true value: edges, binned error curves, uniform-weighted errors, histograms.

Bins are half-open; a value at the last edge is in no bin, so quantile edges drop the maximum.
Edges are a table of one array per series, computed once; rows meet it by series (broadcast if it is
counted small) and find their bin by counting edges, so there is no range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.columns import digitize, linspace, sem
from nodeloom.operators.quantiles import exact_quantiles
from nodeloom.storage import checkpointed, small_side


def edges_of(df: DataFrame, value: str = "y", nbins: int = 12, strategy: str = "quantile", by: Sequence[str] = (), clip: tuple[float, float] = (1, 99), fallback: str = "clipped") -> DataFrame:
    """``by`` columns and ``edges`` (array<double>) of each series with values.

    'quantile': the distinct quantiles i/nbins.  If there are too few of them, equal widths are
    taken instead: with ``fallback`` 'clipped', fewer than nbins + 1 edges give widths between the
    ``clip`` percentiles; with 'range', fewer than 3 give widths between minimum and maximum.
    'uniform': equal widths between the clip percentiles ('clipped') or the extremes ('range').
    """
    if strategy not in ("quantile", "uniform"):
        raise ValueError(f"unknown strategy {strategy!r}")
    probs = [i / nbins for i in range(nbins + 1)] + [clip[0] / 100, clip[1] / 100]
    q = exact_quantiles(df, value, probs, by)
    quantiles = F.array_distinct(F.transform(F.slice("q", 1, nbins + 1), lambda e: e + 0.0))
    lo, hi = (F.get("q", F.lit(nbins + 1)), F.get("q", F.lit(nbins + 2))) if fallback == "clipped" else (F.get("q", F.lit(0)), F.get("q", F.lit(nbins)))
    equal = linspace(lo, hi, nbins)
    enough = nbins + 1 if fallback == "clipped" else 3
    edges = equal if strategy == "uniform" else F.when(F.size(quantiles) < enough, equal).otherwise(quantiles)
    return checkpointed(q.select(*by, "n", edges.alias("edges")))


def in_bins(df: DataFrame, edges: DataFrame, value: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Rows that fall in a bin, with ``bin``."""
    small = F.broadcast(edges.select("edges")) if not by else small_side(edges.select(*by, "edges"))
    met = df.join(small, list(by)) if by else df.crossJoin(small)  # one row of edges
    return met.withColumn("bin", digitize(F.col(value), F.col("edges"))).drop("edges").where("bin is not null")


def bin_rows(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``bin``, ``edge_lo``, ``edge_hi`` of all bins."""
    each = edges.select(*by, "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    return each.select(*by, "bin", F.get("edges", F.col("bin")).alias("edge_lo"), F.get("edges", F.col("bin") + 1).alias("edge_hi"))


def _per_bin(df: DataFrame, edges: DataFrame, value: str, by: Sequence[str], *aggs: Column) -> DataFrame:
    stats = in_bins(df, edges, value, by).groupBy(*by, "bin").agg(F.count("*").alias("count"), *aggs)
    return bin_rows(edges, by).join(stats, [*by, "bin"], "left").fillna(0, subset=["count"])


def binned_metrics(predictions: DataFrame, edges: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Of each bin (empty ones too): count, mean and deviation of y, mean of yhat, MAE, RMSE, bias (yhat - y)."""
    r = F.col(yhat) - F.col(y)
    return _per_bin(
        predictions, edges, y, by,
        F.avg(y).alias("y_true_mean"), F.stddev_pop(y).alias("y_true_std"), F.avg(yhat).alias("y_pred_mean"),
        F.avg(F.abs(r)).alias("MAE"), F.sqrt(F.avg(r * r)).alias("RMSE"), F.avg(r).alias("bias"),
    )


def with_centers(df: DataFrame, edges: DataFrame, strategy: str = "quantile", value: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Bins with ``center``: the mean of the bin's values ('quantile'; the midpoint if empty) or the midpoint."""
    middle = (F.col("edge_lo") + F.col("edge_hi")) / 2
    if strategy == "uniform":
        return bin_rows(edges, by).withColumn("center", middle)
    return _per_bin(df, edges, value, by, F.avg(value).alias("center")).withColumn("center", F.coalesce("center", middle)).drop("count")


def bin_means(df: DataFrame, edges: DataFrame, value: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Count and mean of ``value`` in each bin of ``y``."""
    return _per_bin(df, edges, y, by, F.avg(value).alias("value_mean"))


def uniform_bins(predictions: DataFrame, edges: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Count, MSE and mean y of each bin."""
    r = F.col(yhat) - F.col(y)
    return _per_bin(predictions, edges, y, by, F.avg(r * r).alias("mse"), F.avg(y).alias("y_mean"))


def uniform_weighted_mse(predictions: DataFrame, edges: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat", min_count: int = 1) -> DataFrame:
    """Unweighted mean over non-empty bins of the bin's MSE, and its standard error; NULL without such bins."""
    bins = uniform_bins(predictions, edges, by, y, yhat)
    used = F.when(F.col("count") >= min_count, F.col("mse"))
    return bins.groupBy(*by).agg(F.avg(used).alias("uw_mse"), sem(used, 1).alias("uw_sem"), F.count(used).alias("n_bins"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts with the last bin closed; values outside are dropped.

    ``density`` is count / (rows inside * width).  Bins without rows are not returned.
    """
    width = (hi - lo) / bins
    v = F.col(value)
    inside = df.where((v >= lo) & (v <= hi)).withColumn("bin", F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int"))
    counts = inside.groupBy(*by, "bin").agg(F.count("*").alias("count"))
    sums = counts.groupBy(*by).agg(F.sum("count").alias("_n"))
    met = counts.join(sums, list(by)) if by else counts.crossJoin(F.broadcast(sums))  # one row
    return met.select(*by, "bin", (F.lit(lo) + F.col("bin") * width).alias("edge_lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("edge_hi"), "count", (F.col("count") / (F.col("_n") * width)).alias("density"))


def marker_series(predictions: DataFrame, min_pos: int, top: int | None = None) -> DataFrame:
    """Rows of each positive marker with at least ``min_pos`` nodes; ``top`` markers by count only (ties: least id)."""
    from nodeloom.operators.markers import positive_rows

    rows = positive_rows(predictions, *[c for c in predictions.columns if c != "x"])
    enough = rows.groupBy("marker_id").agg(F.count("*").alias("n_pos")).where(F.col("n_pos") >= min_pos)
    if top is not None:
        enough = enough.orderBy(F.desc("n_pos"), "marker_id").limit(top)
    return rows.join(F.broadcast(enough), "marker_id")  # as many rows as markers
