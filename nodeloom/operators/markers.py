"""Per-marker aggregates, baselines and residuals.

Every operator makes one pass over the nodes: positive markers are found in the array before it
is exploded, so a node costs as many rows as it has positive markers, and aggregates combine
on the map side.  Results have one row per marker, so they are as small as the width of x.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.columns import baseline_of, has_no_positive, is_positive, positives, sem


def marker_dimension(spark: SparkSession, names: Sequence[str], width: int | None = None, policy: str = "pad") -> DataFrame:
    """``marker_id``, ``name``.

    ``policy`` for a number of names other than ``width``: 'pad' adds m{j}; 'fit' pads and
    truncates; 'replace' names all m{j}; 'strict' raises.
    """
    names, width = list(names), len(names) if width is None else width
    if len(names) != width:
        if policy == "strict":
            raise ValueError(f"{len(names)} names for {width} markers")
        if policy == "replace":
            names = []
        if policy in ("fit", "replace"):
            names = names[:width]
        names += [f"m{j}" for j in range(len(names), width)]
    return spark.createDataFrame(list(enumerate(names)), "marker_id int, name string")


def wanted_markers(markers: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``ordinal``, ``name``, ``marker_id`` in wanted order; the id is null for names that are missing."""
    asked = markers.sparkSession.createDataFrame(list(enumerate(wanted)), "ordinal int, name string")
    return asked.join(markers, "name", "left").select("ordinal", "name", "marker_id")


def true_target(nodes: DataFrame) -> Column:
    """``y_orig`` where the table has it, else ``y``."""
    return F.coalesce("y_orig", "y") if "y_orig" in nodes.columns else F.col("y")


def positive_rows(nodes: DataFrame, *keep: str | Column) -> DataFrame:
    """A row for each node and positive marker: ``marker_id`` and the columns kept."""
    return nodes.select(*keep, F.explode(positives(F.col("x"))).alias("marker_id"))


def all_marker_values(nodes: DataFrame, *keep: str | Column) -> DataFrame:
    """A row for each node and marker: ``marker_id``, ``value``."""
    return nodes.select(*keep, F.posexplode("x").alias("marker_id", "value"))


def _with_all(markers: DataFrame, stats: DataFrame, counts: Sequence[str] = ("n_pos",)) -> DataFrame:
    return markers.join(stats, "marker_id", "left").fillna(0, subset=list(counts))


def positive_counts(nodes: DataFrame, markers: DataFrame) -> DataFrame:
    """Number of positive nodes of each marker."""
    return _with_all(markers, positive_rows(nodes).groupBy("marker_id").agg(F.count("*").alias("n_pos")))


def overall_mean_std(predictions: DataFrame) -> DataFrame:
    """Mean and population deviation of y and yhat, in one row."""
    return predictions.agg(F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std"), F.avg("yhat").alias("yhat_mean"), F.stddev_pop("yhat").alias("yhat_std"))


def marker_mean_std(predictions: DataFrame, markers: DataFrame) -> DataFrame:
    """Mean and population deviation of y and yhat over each marker's positives."""
    rows = positive_rows(predictions, "y", "yhat").groupBy("marker_id")
    stats = rows.agg(F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std"), F.avg("yhat").alias("yhat_mean"), F.stddev_pop("yhat").alias("yhat_std"), F.count("*").alias("n_pos"))
    return _with_all(markers, stats)


def marker_baseline(nodes: DataFrame, markers: DataFrame, empty: str = "global") -> DataFrame:
    """``mu_pos``, ``n_pos`` of each marker, and ``mu_none``, ``count_none``, ``mu_global`` of the nodes without one.

    A marker without positives gets the global mean, zero or null (``empty``); ``mu_none``
    falls back to the global mean.
    """
    y = true_target(nodes)
    rows = nodes.select(y.cast("double").alias("y"), "x")
    mean = rows.agg(F.avg("y").alias("mu_global"), F.avg(F.when(has_no_positive(F.col("x")), F.col("y"))).alias("mu_none"), F.count_if(has_no_positive(F.col("x"))).alias("count_none"))
    stats = positive_rows(rows, "y").groupBy("marker_id").agg(F.avg("y").alias("mu_pos"), F.count("*").alias("n_pos"))
    fallback = {"global": F.col("mu_global"), "zero": F.lit(0.0), "null": F.lit(None).cast("double")}[empty]
    out = _with_all(markers, stats).crossJoin(F.broadcast(mean))  # `mean` is one row
    return out.select("marker_id", "name", F.coalesce("mu_pos", fallback).alias("mu_pos"), "n_pos", F.coalesce("mu_none", "mu_global").alias("mu_none"), "count_none", "mu_global")


def baseline_means(baseline: DataFrame) -> DataFrame:
    """One row, as wide as x: ``_mu`` (the markers' means in their order) and ``_none`` (of nodes without any)."""
    return baseline.agg(F.transform(F.array_sort(F.collect_list(F.struct("marker_id", "mu_pos"))), lambda s: s["mu_pos"]).alias("_mu"), F.first("mu_none").alias("_none"))


def with_baseline(nodes: DataFrame, baseline: DataFrame, column: str = "y_base", thresholded: bool = False) -> DataFrame:
    """``nodes`` with each node's baseline: the mean of its markers' means, ``mu_none`` without any."""
    return nodes.crossJoin(F.broadcast(baseline_means(baseline))).withColumn(column, baseline_of(F.col("x"), F.col("_mu"), F.col("_none"), thresholded)).drop("_mu", "_none")


def residualize(nodes: DataFrame, baseline: DataFrame) -> DataFrame:
    """y_orig := y, y_base := baseline, y := y - baseline."""
    based = with_baseline(nodes, baseline, "y_base")
    return based.withColumn("y_orig", F.col("y").cast("double")).withColumn("y", F.col("y_orig") - F.col("y_base"))


def _means(rows: DataFrame) -> DataFrame:
    """``marker_id``, ``mu``: as many rows as markers, so it is broadcast."""
    return F.broadcast(rows.groupBy("marker_id").agg(F.avg("y").alias("mu")))


def marker_baseline_mse(predictions: DataFrame, markers: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Over each marker's positives: mean and standard error (population) of (yhat - mean y)^2.

    The marker means are the table's own, or those of ``baseline`` (which spares a second pass over the predictions).
    """
    rows = positive_rows(predictions, "y", "yhat")
    mu = _means(rows) if baseline is None else F.broadcast(baseline.select("marker_id", F.col("mu_pos").alias("mu")))
    se = rows.join(mu, "marker_id").withColumn("se", F.pow(F.col("yhat") - F.col("mu"), 2))
    return _with_all(markers, se.groupBy("marker_id").agg(F.avg("se").alias("mse_mean"), sem(F.col("se"), 0).alias("mse_sem"), F.count("*").alias("n_pos"), F.first("mu").alias("mu")))


def marker_residuals(predictions: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """A row for each node and positive marker: ``r_base`` = y - marker mean, ``r_model`` = y - yhat.

    The marker means are the table's own, or those of ``baseline``.
    """
    rows = positive_rows(predictions, "graph_id", "node_id", "y", "yhat")
    mu = _means(rows) if baseline is None else F.broadcast(baseline.select("marker_id", F.col("mu_pos").alias("mu")))
    return rows.join(mu, "marker_id").select("graph_id", "node_id", "marker_id", (F.col("y") - F.col("mu")).alias("r_base"), (F.col("y") - F.col("yhat")).alias("r_model"))


def residual_mse(residuals: DataFrame, markers: DataFrame, ddof: int = 0) -> DataFrame:
    """Mean and standard error of squared residuals, and model minus baseline."""
    b, m = F.pow("r_base", F.lit(2)), F.pow("r_model", F.lit(2))
    stats = residuals.groupBy("marker_id").agg(F.avg(b).alias("mse_baseline"), F.avg(m).alias("mse_model"), sem(b, ddof).alias("sem_baseline"), sem(m, ddof).alias("sem_model"), F.count("*").alias("n_pos"))
    return _with_all(markers, stats).withColumn("delta_model_minus_base", F.col("mse_model") - F.col("mse_baseline"))


def relative_mse_across_graphs(predictions: DataFrame, baseline: DataFrame, min_pos: int = 10, eps: float = 1e-8, against: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """MSE / (mu^2 + eps) of each graph and marker with enough positives, then mean and standard error over graphs.

    ``against`` 'baseline' takes the marker's mean as the prediction; ``by`` are columns that part several predictions.
    """
    mu = F.broadcast(baseline.select("marker_id", F.col("mu_pos").alias("mu")))
    rows = positive_rows(predictions, *by, "graph_id", "y", "yhat").join(mu, "marker_id")
    pred = F.col("mu") if against == "baseline" else F.col("yhat")
    each = rows.groupBy(*by, "graph_id", "marker_id").agg(F.avg(F.pow(F.col("y") - pred, F.lit(2))).alias("mse"), F.count("*").alias("n"), F.first("mu").alias("mu")).where(F.col("n") >= min_pos)
    each = each.withColumn("rel", F.col("mse") / (F.col("mu") * F.col("mu") + eps))
    return each.groupBy(*by, "marker_id").agg(F.avg("rel").alias("rel_mean"), sem(F.col("rel"), 1).alias("rel_sem"), F.count("*").alias("n_graphs"))


def classification_metrics(scored: DataFrame, by: Sequence[str], truth: str, prob: str, threshold: float = 0.5) -> DataFrame:
    """acc, prec, rec, f1 and positivity_rate of each group (1e-12 is added to denominators)."""
    t, p = F.col(truth) > 0.5, F.col(prob) >= threshold
    c = lambda e: F.count_if(e).cast("double")
    sums = scored.groupBy(*by).agg(c(t & p).alias("tp"), c(~t & p).alias("fp"), c(t & ~p).alias("fn"), c(~t & ~p).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    out = sums.withColumns({"acc": F.try_divide(F.col("tp") + F.col("tn"), n), "prec": F.col("tp") / (F.col("tp") + F.col("fp") + 1e-12), "rec": F.col("tp") / (F.col("tp") + F.col("fn") + 1e-12), "positivity_rate": F.try_divide(F.col("tp") + F.col("fn"), n)})
    return out.withColumn("f1", 2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec") + 1e-12))


def pos_weights(nodes: DataFrame, markers: DataFrame, cap: float = 100.0, power: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """((1 - p) / p)^power, at most ``cap``, with p the share of positive nodes (inferred semantics)."""
    share = all_marker_values(nodes).groupBy("marker_id").agg(F.avg(is_positive(F.col("value").cast("double")).cast("double")).alias("p"))
    p = F.greatest(F.col("p"), F.lit(eps))
    return markers.join(share, "marker_id", "left").withColumn("pos_weight", F.least(F.pow((1 - F.col("p")) / p, F.lit(power)), F.lit(cap)))


def select_targets(nodes: DataFrame, marker_ids: Sequence[int]) -> DataFrame:
    """The inverse task: x := [y], y := the selected markers (inferred semantics)."""
    chosen = F.array(*[F.get("x", F.lit(int(i))).cast("double") for i in marker_ids])
    return nodes.select("graph_id", "node_id", F.array(F.col("y").cast("double")).alias("x"), chosen.alias("y"))
