"""Metadata, filters, splits, sampling and standardisation of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.columns import finite
from nodeloom.operators.quantiles import exact_quantiles
from nodeloom.storage import checkpointed


def graph_stat(nodes: DataFrame, stat: str = "median") -> DataFrame:
    """``graph_id``, ``stat``: exact median or mean of y."""
    if stat == "mean":
        return nodes.groupBy("graph_id").agg(F.avg("y").alias("stat"))
    if stat == "median":
        return exact_quantiles(nodes, "y", [0.5], ["graph_id"]).select("graph_id", F.get("q", F.lit(0)).alias("stat"))
    raise ValueError(f"unknown stat {stat!r}")


def filter_outliers(nodes: DataFrame, low_pct: float | None, high_pct: float | None, stat: str = "median") -> tuple[DataFrame, DataFrame]:
    """(kept nodes, one row of thresholds): graphs whose stat lies within the percentiles of all graphs' stats.

    One-sided limits are open on the other side; without limits all nodes stay and the thresholds are null.
    """
    spark = nodes.sparkSession
    if low_pct is None and high_pct is None:
        return nodes, spark.createDataFrame([(None, None)], "low double, high double")
    stats = checkpointed(graph_stat(nodes, stat))  # one row a graph, read three times
    q = exact_quantiles(stats, "stat", [(low_pct or 0.0) / 100, (100.0 if high_pct is None else high_pct) / 100])
    low = F.lit(float("-inf")) if low_pct is None else F.get("q", F.lit(0))
    high = F.lit(float("inf")) if high_pct is None else F.get("q", F.lit(1))
    limits = q.select(low.alias("low"), high.alias("high"))
    kept = stats.crossJoin(F.broadcast(limits)).where("stat between low and high").select("graph_id")  # one row of limits
    return nodes.join(kept, "graph_id", "left_semi"), limits


def attach_metadata(graphs: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join of metadata by graph_id; ``matched`` tells whether there was any."""
    return graphs.join(meta.withColumn("matched", F.lit(True)), "graph_id", "left").fillna(False, subset=["matched"])


def metadata_frame(graphs: DataFrame, score: str = "complexity_score", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per graph: organoid (its key), total_surface_area, total_volume, the score, num_nodes and extra keys of ``meta``."""
    get = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    return graphs.select(F.col("graph_id").alias("organoid"), get("total_surface_area"), get("total_volume"), get(score), F.col("n_nodes").alias("num_nodes"), *map(get, extra))


def filter_by_metadata(graphs: DataFrame, key: str = "complexity", least: float = -1.0) -> DataFrame:
    """Graphs whose metadata value is finite and at least ``least``; missing values go."""
    v = F.try_element_at("meta", F.lit(key)).cast("double")
    return graphs.where(F.coalesce(finite(v) & (v >= least), F.lit(False)))


def hash_rank(df: DataFrame, key: str, seed: int, chunk_digits: int = 4) -> DataFrame:
    """``df`` (a row for each key) with ``rank`` from 1 in the order of md5(key:seed), key.

    Ranks are counted within chunks of equal leading hex digits and offset by the chunks before, so no task sees all rows.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = df.withColumn("_h", digest).withColumn("_c", F.substring("_h", 1, chunk_digits))
    sizes = rows.groupBy("_c").agg(F.count("*").alias("_n"))  # at most 16^chunk_digits rows
    first = sizes.select("_c", (F.sum("_n").over(Window.orderBy("_c")) - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key))
    return rows.withColumn("_r", inside).join(F.broadcast(first), "_c").withColumn("rank", F.col("_first") + F.col("_r")).drop("_h", "_c", "_r", "_first")


def split_graphs(graphs: DataFrame, val_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``graph_id``, ``split``: max(1, half-even round(n * val_frac)) graphs are 'val', the others 'train'."""
    ranked = hash_rank(graphs.select("graph_id").distinct(), "graph_id", seed)
    n = F.broadcast(ranked.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(val_frac)).cast("long")).alias("_val")))  # one row
    return ranked.crossJoin(n).select("graph_id", F.when(F.col("rank") <= F.col("_val"), "val").otherwise("train").alias("split"))


def sample_graphs(graphs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most ``k`` graphs without replacement: the first by md5(graph_id:seed)."""
    return graphs.orderBy(F.md5(F.concat(F.col("graph_id").cast("string"), F.lit(f":{seed}"))), "graph_id").limit(k)


def target_scaling(train: DataFrame, robust: bool = False) -> DataFrame:
    """``center``, ``scale`` of the training targets in one row: mean and population deviation, or median and IQR / 1.349.

    A deviation or IQR of at most 1e-12 gives scale 1.
    """
    if robust:
        q = exact_quantiles(train, "y", [0.25, 0.5, 0.75])
        spread, center = F.get("q", F.lit(2)) - F.get("q", F.lit(0)), F.get("q", F.lit(1))
        return q.select(center.alias("center"), F.when(spread > 1e-12, spread / 1.349).otherwise(1.0).alias("scale"))
    sums = train.agg(F.avg("y").alias("center"), F.stddev_pop("y").alias("_sd"))
    return sums.select("center", F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0).alias("scale"))


def standardize(nodes: DataFrame, scaling: DataFrame) -> DataFrame:
    """y := (y - center) / scale."""
    return nodes.crossJoin(F.broadcast(scaling)).withColumn("y", (F.col("y") - F.col("center")) / F.col("scale")).drop("center", "scale")  # one row


def top_by(df: DataFrame, metric: str, k: int, tie: str = "marker_id", absolute: bool = True) -> DataFrame:
    """The ``k`` rows of largest (absolute) metric; NULL comes last, ties by id."""
    return df.orderBy(F.desc_nulls_last(F.abs(metric) if absolute else F.col(metric)), tie).limit(k)


def align_by_name(chosen: DataFrame, other: DataFrame, suffix: str = "_other") -> DataFrame:
    """Rows of ``chosen`` with the columns of ``other`` of the same name."""
    return chosen.join(other.select("name", *[F.col(c).alias(c + suffix) for c in other.columns if c not in ("name", "marker_id")]), "name", "left")


def marker_pairs(markers: DataFrame, k: int) -> DataFrame:
    """The first ``k`` pairs i < j in lexicographic order."""
    a, b = markers.select(F.col("marker_id").alias("i"), F.col("name").alias("name_i")), markers.select(F.col("marker_id").alias("j"), F.col("name").alias("name_j"))
    return a.join(b, F.col("i") < F.col("j")).orderBy("i", "j").limit(k)


def top_coefficients(coefficients: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest absolute weights of each ``kind`` ('self', 'neighbour', 'cross'), with ``rank``; ties by name."""
    order = Window.partitionBy("kind").orderBy(F.desc_nulls_last(F.abs("weight")), "name")
    return coefficients.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
