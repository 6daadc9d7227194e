"""Degrees and components of graphs whose edges arrive as files, kept as state of each graph.

A graph's state is in the state store (RocksDB): a row for each node (parent in a union-find, degree), one for each edge
seen, and the counts.  A batch touches the rows of its own edges only, so a worker's memory follows the batch, not the graph.
Edges are undirected; repeats and loops change nothing, so files that are read twice, or a batch that runs again after
a stop, give the same.  A graph's edges of a batch are worked through by one task; a hot graph is split only by batches (``max_files``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EDGES = "graph_id string, src bigint, dst bigint"
STATS = "graph_id string, n_nodes bigint, n_edges bigint, n_components bigint, deg_max bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def edge_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder: graph_id, src, dst."""
    return spark.readStream.schema(EDGES).option("maxFilesPerTrigger", max_files).parquet(path)


class GraphState(StatefulProcessor):
    """Union-find and degrees of one graph at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "node bigint", "parent bigint, degree bigint")
        self.seen = handle.getMapState("edges", "lo bigint, hi bigint", "is_there boolean")
        self.counts = handle.getValueState("counts", "n_nodes bigint, n_edges bigint, n_components bigint, deg_max bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n_nodes, n_edges, n_components, deg_max = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        touched: dict[int, list[int]] = {}  # node -> [parent, degree], of the batch's nodes and those on their ways

        def row(node: int) -> list[int]:
            nonlocal n_nodes, n_components
            if node not in touched:
                if self.nodes.containsKey((node,)):
                    touched[node] = list(self.nodes.getValue((node,)))
                else:
                    touched[node] = [node, 0]
                    n_nodes, n_components = n_nodes + 1, n_components + 1
            return touched[node]

        def root(node: int) -> int:
            while (up := row(node)[0]) != node:
                row(node)[0] = node = row(up)[0]
            return node

        pairs = {(min(a, b), max(a, b)) for frame in rows for a, b in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True) if a != b}
        for lo, hi in sorted(pairs):
            if self.seen.containsKey((lo, hi)):
                continue
            self.seen.updateValue((lo, hi), (True,))
            n_edges += 1
            for node in (lo, hi):
                row(node)[1] += 1
                deg_max = max(deg_max, row(node)[1])
            a, b = sorted((root(lo), root(hi)))
            if a != b:
                row(b)[0] = a
                n_components -= 1
        for node, (parent, degree) in touched.items():
            self.nodes.updateValue((node,), (parent, degree))
        self.counts.update((n_nodes, n_edges, n_components, deg_max))
        yield pd.DataFrame({"graph_id": [key[0]], "n_nodes": [n_nodes], "n_edges": [n_edges], "n_components": [n_components], "deg_max": [deg_max]})

    def close(self) -> None:
        pass


def running_graph_stats(edges: DataFrame) -> DataFrame:
    """A row for each graph that a batch has edges of: what is known of it after the batch.  Rows with a null in any column are left out."""
    return edges.dropna().groupBy("graph_id").transformWithStateInPandas(GraphState(), STATS, "Update", "None")


def write_graph_stats(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's rows replace its own folder under ``path``; what is available is processed and the query stops.  A later call with the same ``checkpoint`` goes on."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    conf, name = edges.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        stream = running_graph_stats(edges).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return stream.trigger(availableNow=True).foreachBatch(put).start()
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def latest_graph_stats(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each graph."""
    names = [c.split()[0] for c in STATS.split(", ")]
    last = spark.read.parquet(path).groupBy("graph_id").agg(F.max_by(F.struct(*names[1:]), "batch").alias("s"))
    return last.select("graph_id", "s.*")
