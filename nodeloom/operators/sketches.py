"""Bin edges from mergeable quantile sketches (KLL), kept as a small table that new files are added to.

A sketch answers within ``rank_error(k)`` of the wanted rank, two-sided, in 99 of 100 cases (the published error of KLL sketches of doubles); its
lowest and highest value are exact.  It takes some tens of kilobytes at most, whatever the number of values, so edges of a
growing collection need the new files only.  ``bins.edges_of`` gives exact edges from all values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.columns import finite, linspace

K = 2048


def rank_error(k: int = K) -> float:
    """Normalised rank error of a single quantile: 2.296 / k^0.9021 (fixed values, from the sketch's publication)."""
    return 2.296 / k**0.9021


def sketch_values(df: DataFrame, value: str = "y", by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``by`` columns, ``n`` and ``sketch`` of each series with finite values; other values are left out."""
    v = F.col(value).cast("double")
    return df.where(finite(v)).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch")).where("n > 0")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """One row a series of tables that were sketched apart and put together."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch")).where("n > 0")


def add_sketches(df: DataFrame, path: str, value: str = "y", by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Append the sketches of new rows to the table at ``path`` (a row a series and call) and return the merged ones of all."""
    sketch_values(df, value, by, k).write.mode("append").parquet(path)
    return merge_sketches(df.sparkSession.read.parquet(path), by, k)


def sketched_edges(sketches: DataFrame, nbins: int = 12, strategy: str = "quantile", by: Sequence[str] = (), clip: tuple[float, float] = (1, 99), fallback: str = "clipped") -> DataFrame:
    """``by`` columns, ``n`` and ``edges`` as ``bins.edges_of`` gives them, each edge within the sketch's rank error; the first and last quantile edge are exact."""
    if strategy not in ("quantile", "uniform"):
        raise ValueError(f"unknown strategy {strategy!r}")
    ranks = [i / nbins for i in range(nbins + 1)] + [clip[0] / 100, clip[1] / 100]
    q = sketches.select(*by, "n", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(r)) for r in ranks])).alias("q"))
    quantiles = F.array_distinct(F.transform(F.slice("q", 1, nbins + 1), lambda e: e + 0.0))
    lo, hi = (F.get("q", F.lit(nbins + 1)), F.get("q", F.lit(nbins + 2))) if fallback == "clipped" else (F.get("q", F.lit(0)), F.get("q", F.lit(nbins)))
    equal = linspace(lo, hi, nbins)
    enough = nbins + 1 if fallback == "clipped" else 3
    edges = equal if strategy == "uniform" else F.when(F.size(quantiles) < enough, equal).otherwise(quantiles)
    return q.select(*by, "n", edges.alias("edges"))
