"""Connected components over a links table: alternating large-star and small-star joins.

Each round is a handful of shuffles over the links; hubs are met with partial
aggregation and Spark's skew-join handling, and every round's links are
checkpointed to the shared folder.  The loop ends when a round changes nothing.

``contracted`` takes most links away before the first round: in each task, a union-find over the links at hand leaves one link from each node
to the least node of its part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.storage import checkpointed, small_side


#: Nodes whose parts a task keeps at a time, and links of a graph that are dealt to one task.
PART_NODES = 1_000_000
GRAPH_LINKS = 1_000_000


def contracted(edges: DataFrame, graph_links: int = GRAPH_LINKS, part_nodes: int = PART_NODES) -> DataFrame:
    """(graph_id, src, dst) with the components of ``edges`` and at most a link a node and task: from each node to the least of its part.

    A graph's edges meet in one task; those of a graph with more than ``graph_links`` are dealt to as many as they need by their smaller end,
    so what is left of it is settled by the star rounds.  A task hands on what it has whenever it holds ``part_nodes`` nodes, which
    loses no connection.
    """
    rows = edges.where("graph_id is not null and src <> dst").select("graph_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    sizes = checkpointed(rows.groupBy("graph_id").agg(F.count("*").alias("_n")).where(F.col("_n") > graph_links))
    share = F.lit(0)
    if not sizes.isEmpty():
        rows = rows.join(small_side(sizes), "graph_id", "left")
        share = F.coalesce(F.pmod(F.xxhash64(F.least("src", "dst")), F.ceil(F.col("_n") / graph_links)), F.lit(0))
    dealt = rows.withColumn("_share", share).repartition("graph_id", "_share").select("graph_id", "src", "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[tuple, int] = {}  # (graph, node) -> a smaller node of its part, or itself

        def least(graph: str, node: int) -> int:
            while (up := parent.setdefault((graph, node), node)) != node:
                parent[graph, node] = node = parent[graph, up]
            return node

        def out() -> pa.RecordBatch:
            links = [(graph, node, root) for graph, node in parent if (root := least(graph, node)) != node]
            graphs, nodes, roots = zip(*links) if links else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(graphs, pa.string()), pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["graph_id", "src", "dst"])

        for batch in batches:
            for graph, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = least(graph, a), least(graph, b)
                if x != y:
                    parent[graph, max(x, y)] = min(x, y)
            if len(parent) >= part_nodes:
                yield out()
                parent.clear()
        yield out()

    return dealt.mapInArrow(run, "graph_id string, src bigint, dst bigint")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star operation on links (a > b), hanging neighbours on each node's least neighbour."""
    sided = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sided.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = sided.join(least, "a")
    if small:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``node``, ``component`` (least node reachable) for every node that has a link.

    Nodes may be of any type with an order, structs included.  Links are undirected;
    loops, repeats and links with a null end are ignored.  An empty table gives an empty result.
    """
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = checkpointed(whole.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        now = checkpointed(_star(_star(now, small=False), small=True))
        previous, state = state, _state(now)
        if state == previous:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    both = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return both.groupBy("node").agg(F.min("component").alias("component"))
