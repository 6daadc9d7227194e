"""Losses and calibration terms as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.columns import huber


def error_stats(predictions: DataFrame, by: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """Huber loss, MSE and MAE."""
    e = F.col("yhat") - F.col("y")
    return predictions.groupBy(*by).agg(F.avg(huber(F.col("yhat"), F.col("y"), delta)).alias("huber"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))


def batch_weighted(batches: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    """Mean of batch losses weighted by their nodes; 0 / 1 for no nodes."""
    return batches.agg((F.coalesce(F.sum(F.col(loss) * F.col(n)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(n), F.lit(0)), F.lit(1))).alias("loss"))


def calibration(predictions: DataFrame, by: Sequence[str] = (), mode: str = "corr", eps: float = 1e-12) -> DataFrame:
    """Penalty on the tie between residual (yhat - y) and y: squared correlation ('corr') or squared population
    covariance ('cov'); and the residual's slope on y.

    Centred sums come from one pass (moments of the pair), so rows aren't shuffled to find a mean first.
    """
    if mode not in ("corr", "cov"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = predictions.withColumn("_r", F.col("yhat") - F.col("y"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("_r", "y").alias("_c"), F.var_pop("_r").alias("_vr"), F.var_pop("y").alias("_vy"))
    n, c = F.col("n"), F.col("_c")
    corr = F.pow(n * c / F.sqrt(F.greatest(n * F.col("_vr") * n * F.col("_vy"), F.lit(eps))), F.lit(2))
    slope = n * c / F.greatest(n * F.col("_vy"), F.lit(eps))
    return sums.select(*by, (corr if mode == "corr" else c * c).alias("penalty"), slope.alias("residual_slope"))
