"""A stream of edges with state, against the batch operators, stopped in the middle and gone on with."""

import random

from pyspark.sql import functions as F

from nodeloom.operators import audit
from nodeloom.operators.graphs import normalise_edges
from nodeloom.streaming.graph_stream import EDGES, edge_stream, latest_graph_stats, write_graph_stats


def test_replay_equals_the_batch_result(spark, tmp_path):
    rng = random.Random(6)
    edges = [(f"g{rng.randrange(3)}", a := rng.randrange(25), (a + rng.choice([0, 1, 7])) % 25) for _ in range(90)] + [(None, 1, 2), ("g0", None, 1)]
    folder, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    write = lambda rows: spark.createDataFrame(rows, EDGES).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: write_graph_stats(edge_stream(spark, folder, 1), out, at).awaitTermination(120)
    write(edges[:30])
    write(edges[20:50])  # some come twice
    assert run()
    write(edges[50:])
    assert run()
    both = normalise_edges(spark.createDataFrame(edges, EDGES).dropna(), "src", "dst")
    nodes = both.select("graph_id", F.col("src").alias("node_id")).distinct()
    parts = audit.component_stats(audit.components(nodes, both)).select("graph_id", F.col("num_components").alias("n_components"))
    degrees = audit.degree_stats(nodes, both).select("graph_id", "deg_max")
    sizes = both.groupBy("graph_id").agg(F.count_distinct("src").alias("n_nodes"), (F.count("*") / 2).cast("long").alias("n_edges"))
    want = sizes.join(parts, "graph_id").join(degrees, "graph_id")
    key = lambda df: sorted(tuple(r[c] for c in ("graph_id", "n_nodes", "n_edges", "n_components", "deg_max")) for r in df.collect())
    assert key(latest_graph_stats(spark, out)) == key(want) and len(key(want)) == 3
