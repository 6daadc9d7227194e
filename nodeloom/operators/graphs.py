"""Building and expanding edges; every operator works on all graphs at once, keyed by graph_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.operators.quantiles import GROUP_ROWS, row_ranks
from nodeloom.storage import checkpointed, small_side


def normalise_edges(raw: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Both directions of each pair, without loops and repeats."""
    both = F.explode(F.array(F.struct(F.col(u).alias("src"), F.col(v).alias("dst")), F.struct(F.col(v).alias("src"), F.col(u).alias("dst"))))  # raw pairs are made once
    return raw.where(F.col(u) != F.col(v)).select("graph_id", both.alias("_e")).select("graph_id", "_e.src", "_e.dst").distinct()


def two_hop_pairs(edges: DataFrame) -> DataFrame:
    """Pairs joined by a path of two edges, without the start itself."""
    onward = edges.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("far"))
    return edges.join(onward, ["graph_id", "dst"]).where("src <> far").select("graph_id", "src", F.col("far").alias("dst")).distinct()


def add_two_hop_edges(edges: DataFrame, keep_one_hop: bool = True, include_self_loops: bool = False) -> DataFrame:
    """E and E o E, distinct, without loops unless asked for (inferred semantics)."""
    onward = edges.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("far"))
    two = edges.join(onward, ["graph_id", "dst"]).select("graph_id", "src", F.col("far").alias("dst"))
    out = two.unionByName(edges.select("graph_id", "src", "dst")) if keep_one_hop else two
    return (out if include_self_loops else out.where("src <> dst")).distinct()


def connect_by_time(nodes: DataFrame, ts: str = "ts", hours: int = 6, order: str = "node_id") -> DataFrame:
    """Undirected pairs (u < v) of a graph's nodes with ts_u <= ts_v <= ts_u + ``hours``.

    Times are cut into buckets of that length, and a row meets its own and the next bucket only:
    an equi-join whose work follows the number of true pairs.
    """
    span = hours * 3600
    # Microseconds keep the comparison exact.
    t = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")
    rows = nodes.select("graph_id", F.col(order).alias("id"), t.alias("t"), F.floor(t / (span * 1_000_000)).alias("bucket"))
    left = rows.select("graph_id", F.col("id").alias("u"), F.col("t").alias("tu"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    right = rows.select("graph_id", F.col("id").alias("v"), F.col("t").alias("tv"), "bucket")
    near = (F.col("u") < F.col("v")) & (F.col("tv") >= F.col("tu")) & (F.col("tv") <= F.col("tu") + span * 1_000_000)
    return left.join(right, ["graph_id", "bucket"]).where(near).select("graph_id", "u", "v")


def ego_nodes(nodes: DataFrame, edges: DataFrame, num_hops: int = 2, max_centers: int | None = None, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``graph_id``, ``center``, ``node_id``, ``hop`` and ``local_id`` (0.. in the order of node_id): nodes within ``num_hops``.

    A hop starts from the nodes that the last one reached first, and drops those that any hop has reached: an edge is followed once an ego.
    At most ``max_centers`` centres a graph, the first in the order of md5(node_id:seed).  Egos of more than ``group_rows`` nodes are numbered in
    chunks, so that no task holds a hub's.
    """
    centers = nodes.where("graph_id is not null").select("graph_id", F.col("node_id").alias("center")).distinct()
    if max_centers is not None:
        order = Window.partitionBy("graph_id").orderBy(F.md5(F.concat_ws(":", F.col("center").cast("string"), F.lit(str(seed)))), "center")
        centers = centers.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_centers).drop("_r")
    reached = frontier = checkpointed(centers.select("graph_id", "center", F.col("center").alias("node_id"), F.lit(0).alias("hop")))
    onward = edges.select("graph_id", F.col("src").alias("node_id"), "dst")
    for hop in range(1, num_hops + 1):
        step = frontier.join(onward, ["graph_id", "node_id"]).select("graph_id", "center", F.col("dst").alias("node_id")).distinct()
        frontier = checkpointed(step.join(reached.select("graph_id", "center", "node_id"), ["graph_id", "center", "node_id"], "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
    large = checkpointed(reached.groupBy("graph_id", "center").agg(F.count("*").alias("_n")).where(F.col("_n") > group_rows).select("graph_id", "center"))
    inside = F.row_number().over(Window.partitionBy("graph_id", "center").orderBy("node_id")) - 1
    if large.isEmpty():
        return reached.withColumn("local_id", inside)
    side, ego = small_side(large), F.struct("graph_id", "center")
    few = reached.join(side, ["graph_id", "center"], "left_anti").withColumn("local_id", inside)
    many = row_ranks(reached.join(side, ["graph_id", "center"], "left_semi").withColumn("_ego", ego), "_ego", F.col("node_id"), ["node_id"], "local_id")
    return few.unionByName(many.drop("_ego").withColumn("local_id", (F.col("local_id") - 1).cast("int")))


def ego_edges(egos: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges induced by each ego's nodes, with local ids."""
    src = egos.select("graph_id", "center", F.col("node_id").alias("src"), F.col("local_id").alias("src_local"))
    dst = egos.select("graph_id", "center", F.col("node_id").alias("dst"), F.col("local_id").alias("dst_local"))
    return edges.join(src, ["graph_id", "src"]).join(dst, ["graph_id", "center", "dst"]).select("graph_id", "center", "src", "dst", "src_local", "dst_local")


def ego_dataset(nodes: DataFrame, edges: DataFrame, num_hops: int = 2, max_centers: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes (with x, y and ``orig_center``) and edges of all ego graphs."""
    egos = ego_nodes(nodes, edges, num_hops, max_centers, seed)
    return egos.join(nodes, ["graph_id", "node_id"]), ego_edges(egos, edges)
