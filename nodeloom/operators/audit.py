"""Structural audit of all graphs at once; each operator returns one row per graph.

``graphs`` has ``graph_id`` and ``n_nodes``; ``edges`` are directed rows (graph_id, src, dst) of ids
0.. or of any ids where no range is checked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.columns import is_positive
from nodeloom.operators import losses
from nodeloom.operators.components import connected_components, contracted
from nodeloom.operators.quantiles import exact_quantiles, row_ranks
from nodeloom.operators.reach import two_hop_reach
from nodeloom.storage import checkpointed


def edge_integrity(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of bad edges; ``duplicate_directed`` is the sum of c(c - 1) over undirected pairs (equal to the number of
    edges on a clean symmetric graph), ``repeated_edges`` the true number of repeats; an edge is symmetric if its reverse exists.

    One count per distinct directed edge feeds everything: a multigraph's repeats are combined before the shuffle.
    """
    n = graphs.select("graph_id", "n_nodes")
    counted = edges.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("c"))
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = counted.groupBy("graph_id", lo.alias("lo"), hi.alias("hi")).agg(
        F.sum("c").alias("c"),
        F.sum(F.col("c") - 1).alias("repeated"),
        # Both directions stand (a loop is its own reverse): all of the pair's edges have a reverse.
        ((F.count("*") == 2) | F.max(F.col("src") == F.col("dst"))).alias("both"),
    )
    met = pairs.join(n, "graph_id")
    outside = (F.col("lo") < 0) | (F.col("hi") >= F.col("n_nodes"))
    c = F.col("c")
    sums = met.groupBy("graph_id").agg(
        F.sum(c).alias("num_edges"),
        F.sum(F.when(outside, c).otherwise(0)).alias("out_of_range"),
        F.sum(F.when(F.col("lo") == F.col("hi"), c).otherwise(0)).alias("self_loops"),
        F.sum(c * (c - 1)).alias("duplicate_directed"),
        F.sum("repeated").alias("repeated_edges"),
        F.sum(F.when(F.col("both"), c).otherwise(0)).alias("_sym"),
    )
    names = ["num_edges", "out_of_range", "self_loops", "duplicate_directed", "repeated_edges"]
    out = n.join(sums, "graph_id", "left").fillna(0, subset=[*names, "_sym"])
    return out.select("graph_id", F.col("n_nodes").alias("num_nodes"), *names, (F.col("_sym") / F.greatest("num_edges", F.lit(1))).alias("undirected_symmetry_ratio"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id``, ``node_id``, ``deg`` (in-degree, 0 included)."""
    into = edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("deg"))
    return nodes.select("graph_id", "node_id").join(into, ["graph_id", "node_id"], "left").fillna(0, subset=["deg"])


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of isolated nodes, mean, median, 90th percentile and maximum of in-degrees."""
    deg = checkpointed(degrees(nodes, edges))
    sums = deg.groupBy("graph_id").agg(F.avg((F.col("deg") == 0).cast("double")).alias("deg0_frac"), F.avg("deg").alias("deg_mean"), F.max("deg").alias("deg_max"))
    q = exact_quantiles(deg, "deg", [0.5, 0.9], ["graph_id"])
    return sums.join(q, "graph_id").select("graph_id", "deg0_frac", "deg_mean", F.get("q", F.lit(0)).alias("deg_p50"), F.get("q", F.lit(1)).alias("deg_p90"), "deg_max")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id``, ``node_id``, ``root`` (least node of its component)."""
    links = contracted(edges).select(F.struct("graph_id", F.col("src").alias("id")).alias("a"), F.struct("graph_id", F.col("dst").alias("id")).alias("b"))
    found = connected_components(links).select(F.col("node.graph_id").alias("graph_id"), F.col("node.id").alias("node_id"), F.col("component.id").alias("root"))
    return nodes.select("graph_id", "node_id").join(found, ["graph_id", "node_id"], "left").withColumn("root", F.coalesce("root", "node_id"))


def component_ids(labelled: DataFrame) -> DataFrame:
    """``component_id`` 0.. in the order of the components' least nodes."""
    roots = labelled.select("graph_id", "root").distinct()
    ids = row_ranks(roots, "graph_id", F.col("root"), ["root"]).select("graph_id", "root", (F.col("rank") - 1).cast("int").alias("component_id"))
    return labelled.join(ids, ["graph_id", "root"])


def component_stats(labelled: DataFrame, small: int = 5) -> DataFrame:
    """Number of components, of those with at most ``small`` nodes, and the largest size."""
    sizes = labelled.groupBy("graph_id", "root").agg(F.count("*").alias("n"))
    return sizes.groupBy("graph_id").agg(F.count("*").alias("num_components"), F.count_if(F.col("n") <= small).alias("num_small"), F.max("n").alias("largest"))


def homophily_by_marker(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph and marker: share of directed edges whose ends agree (NULL without edges), and the mean over nodes
    with an in-neighbour of the mean value among them.

    Nodes meet edges once with whole arrays; markers are exploded after the per-node means.
    """
    x = nodes.select("graph_id", F.col("node_id").alias("src"), F.transform("x", lambda v: v.cast("double")).alias("xs"))
    xd = x.select("graph_id", F.col("src").alias("dst"), F.col("xs").alias("xd"))
    ends = edges.join(x, ["graph_id", "src"]).join(xd, ["graph_id", "dst"])
    both = ends.select("graph_id", "dst", F.posexplode(F.arrays_zip("xs", "xd")).alias("marker_id", "v"))
    agree = (F.col("v.xs") == F.col("v.xd")).cast("double")
    per_node = both.groupBy("graph_id", "dst", "marker_id").agg(F.sum(agree).alias("same"), F.count("*").alias("n"), F.avg("v.xs").alias("near"))
    stats = per_node.groupBy("graph_id", "marker_id").agg((F.sum("same") / F.sum("n")).alias("edge_agreement"), F.avg("near").alias("neighbor_positive_rate"))
    every = nodes.groupBy("graph_id").agg(F.max(F.size("x")).alias("m")).select("graph_id", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("marker_id"))
    return every.join(stats, ["graph_id", "marker_id"], "left")


def moran_like_i(nodes: DataFrame, edges: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Sum over directed edges of z_u z_v, times N, over (sum z^2 + eps) * max(W, 1); z = y - graph mean."""
    mean = nodes.groupBy("graph_id").agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    z = nodes.join(mean, "graph_id").select("graph_id", "node_id", (F.col("y") - F.col("m")).alias("z"), "n")
    own = z.groupBy("graph_id").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.first("n").alias("n"))
    zu, zv = z.select("graph_id", F.col("node_id").alias("src"), F.col("z").alias("zu")), z.select("graph_id", F.col("node_id").alias("dst"), F.col("z").alias("zv"))
    cross = edges.join(zu, ["graph_id", "src"]).join(zv, ["graph_id", "dst"]).groupBy("graph_id").agg(F.sum(F.col("zu") * F.col("zv")).alias("zz2"), F.count("*").alias("w"))
    met = own.join(cross, "graph_id", "left").fillna(0, subset=["zz2", "w"])
    return met.select("graph_id", (F.col("zz2") * F.col("n") / ((F.col("zz") + eps) * F.greatest("w", F.lit(1)))).alias("moran_i"))


def audit_graphs(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, sample_k: int | None = None, seed: int = 0, marker_names: Sequence[str] | None = None) -> DataFrame:
    """All of the above in one row per graph, as structs; optionally for ``sample_k`` graphs (md5 order of graph_id:seed).

    ``marker_alignment_error`` says how the number of ``marker_names`` differs from the width of x (null if it doesn't, or without names).
    """
    if sample_k is not None:
        chosen = graphs.orderBy(F.md5(F.concat_ws(":", "graph_id", F.lit(str(seed)))), "graph_id").limit(sample_k).select("graph_id")
        graphs, nodes, edges = (t.join(chosen, "graph_id", "left_semi") for t in (graphs, nodes, edges))
    hom = homophily_by_marker(nodes, edges).groupBy("graph_id").agg(F.avg("edge_agreement").alias("edge_agreement_mean"), F.avg("neighbor_positive_rate").alias("neighbor_positive_mean"))
    parts = {
        "integrity": edge_integrity(graphs, edges),
        "degree": degree_stats(nodes, edges),
        "components": component_stats(components(nodes, edges)),
        "homophily": hom,
        "reach": two_hop_reach(nodes, edges),
        "moran": moran_like_i(nodes, edges),
    }
    out = graphs.select("graph_id")
    for name, part in parts.items():
        out = out.join(part.select("graph_id", F.struct(*[c for c in part.columns if c != "graph_id"]).alias(name)), "graph_id", "left")
    if marker_names is None:
        return out.withColumn("marker_alignment_error", F.lit(None).cast("string"))
    width = nodes.groupBy("graph_id").agg(F.max(F.size("x")).alias("_m"))
    said = F.when(F.col("_m") != len(marker_names), F.concat(F.lit(f"{len(marker_names)} names for "), F.col("_m").cast("string"), F.lit(" markers")))
    return out.join(width, "graph_id", "left").withColumn("marker_alignment_error", said).drop("_m")


def ablation(model, nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """``case``, ``mae``, ``mse`` over all nodes of all graphs: as they are ('normal'), without edges ('no_edges') and with x shuffled within each graph ('shuffled_x').

    ``model`` is anything whose ``transform(nodes, edges)`` adds ``yhat``.  Without nodes there are no rows.
    """
    cases = {"normal": (nodes, edges), "no_edges": (nodes, edges.where(F.lit(False))), "shuffled_x": (permuted_features(nodes, seed), edges)}
    scored = [model.transform(n, e).select(F.lit(case).alias("case"), "y", "yhat") for case, (n, e) in cases.items()]
    return losses.error_stats(reduce(DataFrame.unionByName, scored), ["case"]).select("case", "mae", "mse")


def permuted_features(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """x shuffled among the nodes of each graph (ranks by id meet ranks by md5 of id and seed)."""
    digest = F.md5(F.concat_ws(":", F.col("node_id").cast("string"), F.lit(str(seed))))
    to = row_ranks(nodes.drop("x"), "graph_id", F.col("node_id"), ["node_id"], "_rank")
    of = row_ranks(nodes.select("graph_id", "node_id", "x", digest.alias("_h")), "graph_id", F.conv(F.substring("_h", 1, 12), 16, 10), ["_h", "node_id"], "_rank")
    return to.join(of.select("graph_id", "x", "_rank"), ["graph_id", "_rank"]).drop("_rank")


def positive_share(nodes: DataFrame) -> DataFrame:
    """Share of positive nodes of each graph and marker."""
    rows = nodes.select("graph_id", F.posexplode("x").alias("marker_id", "v"))
    return rows.groupBy("graph_id", "marker_id").agg(F.avg(is_positive(F.col("v").cast("double")).cast("double")).alias("share"))
