"""Adapters that read the driver's tables as graphs, nodes, edges and markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators import graphs, markers

EVENT_TYPES = ("click", "purchase", "signup", "view")
MARKER_NAMES = (*EVENT_TYPES, "k50", "night")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each user, a node for each event; six markers; y is the event's value."""
    flags = [F.col("event_type") == t for t in EVENT_TYPES]
    flags += [F.get_json_object("props", "$.k").cast("int") >= 50, F.hour("ts") < 6]
    x = F.array(*[F.coalesce(f, F.lit(False)).cast("float") for f in flags])
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("graph_id"), F.col("event_id").alias("node_id"), x.alias("x"), F.col("value").alias("y"), "ts")


def event_edges(nodes: DataFrame, hours: int = 6) -> DataFrame:
    """Symmetric edges between a user's events at most ``hours`` apart."""
    return graphs.normalise_edges(graphs.connect_by_time(nodes, "ts", hours))


def event_graphs(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))


def event_markers(spark: SparkSession) -> DataFrame:
    return markers.marker_dimension(spark, MARKER_NAMES)


def one_hop_predictions(nodes: DataFrame, edges: DataFrame, baseline: DataFrame) -> DataFrame:
    """yhat = half the node's baseline and half the mean y of its neighbours; the baseline where it has none."""
    based = markers.with_baseline(nodes, baseline, "b")
    near = edges.join(nodes.select("graph_id", F.col("node_id").alias("src"), F.col("y").alias("ny")), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.avg("ny").alias("near"))
    met = based.join(near, ["graph_id", "node_id"], "left")
    return met.withColumn("yhat", F.coalesce(0.5 * F.col("b") + 0.5 * F.col("near"), F.col("b"))).drop("near")


@dataclass
class OneHop:
    """``one_hop_predictions`` as a model."""

    baseline: DataFrame

    def transform(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return one_hop_predictions(nodes, edges, self.baseline)


def event_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.marker_baseline(event_nodes(spark, sf_dir), event_markers(spark))


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = event_nodes(spark, sf_dir)
    return one_hop_predictions(nodes, event_edges(nodes), markers.marker_baseline(nodes, event_markers(spark)))


def lineitem_multigraph(spark: SparkSession, sf_dir: str, n: int = 95) -> tuple[DataFrame, DataFrame]:
    """(graphs, raw directed edges) of a dirty multigraph for each line status; ids from 0 to n - 1 are valid."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("graph_id"), F.pmod("l_suppkey", F.lit(100)).alias("src"), F.pmod("l_partkey", F.lit(100)).alias("dst"))
    return edges.select("graph_id").distinct().withColumn("n_nodes", F.lit(n).cast("long")), edges


def embedding_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each label with wide x: sign of each component; y is the first component."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("graph_id"), F.col("vec_id").alias("node_id"), F.transform(e, lambda v: (v > 0).cast("float")).alias("x"), F.get(e, F.lit(0)).cast("double").alias("y"))


def copurchase_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, symmetric edges): a graph for each customer, a node for each part bought, an edge between parts of one order.

    An order has a handful of lines, so its pairs stay few.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = lines.select(F.col("o_custkey").cast("string").alias("graph_id"), F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("node_id"))
    # An order's parts lie in one row: its pairs need no join.
    orders = bought.groupBy("graph_id", "order").agg(F.array_sort(F.collect_set("node_id")).alias("parts"))
    first = orders.select("graph_id", "parts", F.posexplode("parts").alias("i", "u"))
    raw = first.select("graph_id", "u", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))).alias("v"))
    return bought.select("graph_id", "node_id").distinct(), graphs.normalise_edges(raw)


def part_hubs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a graph for each return flag; the parts, and a hub (its id below 0) for each line number that orders them; an edge for each line, so edges repeat."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("graph_id"), (-F.col("l_linenumber")).cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"))
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct(), edges
