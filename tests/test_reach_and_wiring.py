"""Two-hop sets as bitmaps, and message passing over edges that are laid out once."""

import random

import pytest
from pyspark.sql import functions as F

from nodeloom.models.message_passing import Gin, Sage, neighbor_aggregate
from nodeloom.models.wiring import Wiring
from nodeloom.operators import reach
from nodeloom.plans import fixtures as fx
from nodeloom.storage import checkpointed
from tests.conftest import SF

NODES, EDGES = "graph_id string, node_id bigint", "graph_id string, src bigint, dst bigint"


@pytest.fixture(scope="module")
def random_graphs(spark):
    """(nodes, edges, {(graph, node): size of its two-hop set}); sparse and dense graphs, loops, repeats, a lone node."""
    rng = random.Random(0)
    nodes, edges, want = [], [], {}
    for g, (n, p) in enumerate([(30, 0.05), (40, 0.2), (25, 0.9), (1, 0)]):
        near = {i: {i} for i in range(n)}
        for i in range(n):
            nodes.append((str(g), i * 10**9))
            for j in range(n):
                if rng.random() < p:
                    edges += [(str(g), i * 10**9, j * 10**9)] * rng.randint(1, 2)
                    near[i].add(j)
                    near[j].add(i)
        want |= {(str(g), i * 10**9): len(set().union(*(near[j] for j in near[i]))) for i in range(n)}
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), want


@pytest.mark.parametrize("heavy_from", [1, 6, 128])
def test_two_hop_sets_equal_plain_sets(random_graphs, heavy_from):
    nodes, edges, want = random_graphs
    assert {(r.graph_id, r.node_id): r.reached for r in reach.two_hop_sizes(nodes, edges, heavy_from).collect()} == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_two_hop_sets_in_shares_and_lanes(random_graphs, monkeypatch, broadcast):
    """So few rows and sets to a task that every key is dealt in shares, bitmaps hold some 7 nodes, and a class's hubs are merged in lanes."""
    nodes, edges, want = random_graphs
    for name, value in {"TASK_ROWS": 40, "TASK_SETS": 64, "SET_NODES": 7, "MOST_PARTITIONS": 5}.items():
        monkeypatch.setattr(reach, name, value)
    if not broadcast:
        monkeypatch.setattr(reach, "small_side", lambda df: df)
    assert {(r.graph_id, r.node_id): r.reached for r in reach.two_hop_sizes(nodes, edges, 6).collect()} == want


def test_a_task_takes_no_more_rows_of_a_larger_table(spark, monkeypatch):
    """Three hubs with 10,000 leaves: links were dealt in as many parts as Spark found fit, and all of a class's pairs to one of them."""
    most = {}

    def seen(f):
        def made(df, *more):
            out = f(df, *more)
            key = tuple(sorted(out.columns))
            most[key] = max(most.get(key, 0), out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0)
            return out

        return made

    monkeypatch.setattr(reach, "TASK_ROWS", 1000, raising=False)
    for name in ("checkpointed", "laid_out"):
        monkeypatch.setattr(reach, name, seen(getattr(reach, name, None)), raising=False)
    edges = spark.range(3 * 10_000).selectExpr("'g' AS graph_id", "-1 - id % 3 AS src", "id div 3 AS dst")
    nodes = edges.selectExpr("graph_id", "explode(array(src, dst)) AS node_id").distinct()
    got = reach.two_hop_sizes(nodes, edges).groupBy("reached").count().collect()
    assert [tuple(r) for r in got] == [(10_003, 10_003)]
    assert most["graph_id", "hub", "node_id"] < 2000


def test_a_hub_of_100_000_neighbours(spark):
    """The squares of such a hub are 10^10 pairs; a chain through its leaves and a tail beside it are light."""
    d = 100_000
    link = lambda a, b: (F.lit("h").alias("graph_id"), a.cast("long").alias("src"), b.cast("long").alias("dst"))
    star = spark.range(1, d + 1).select(*link(F.lit(0), F.col("id")))
    chain = spark.range(1, d + 2).select(*link(F.col("id"), F.col("id") + 1))
    nodes = spark.range(0, d + 4).select(F.lit("h").alias("graph_id"), F.col("id").alias("node_id"))
    sizes = checkpointed(reach.two_hop_sizes(nodes, star.unionByName(chain)))
    got = {r.node_id: r.reached for r in sizes.where(f"node_id in (0, 1, 500, {d}, {d + 1}, {d + 2}, {d + 3})").collect()}
    assert got == {0: d + 2, 1: d + 1, 500: d + 1, d: d + 3, d + 1: 5, d + 2: 3, d + 3: 1}
    total = (d + 2) + (d - 2) * (d + 1) + (d + 2) + (d + 3) + 5 + 3 + 1
    assert sizes.agg(F.sum("reached")).first()[0] == total
    share = reach.two_hop_reach(nodes, star.unionByName(chain)).first().two_hop_frac
    assert share == pytest.approx(total / (d + 4) ** 2)


def test_reach_of_odd_tables(spark):
    nodes, edges = spark.createDataFrame([("a", 1), (None, 2)], NODES), spark.createDataFrame([], EDGES)
    assert [tuple(r) for r in reach.two_hop_sizes(nodes, edges).collect()] == [("a", 1, 1)]
    assert reach.two_hop_sizes(nodes.where("false"), edges).count() == 0 and reach.two_hop_reach(nodes.where("false"), edges).count() == 0


@pytest.fixture(scope="module")
def events(spark):
    nodes = checkpointed(fx.event_nodes(spark, SF))
    return nodes, checkpointed(fx.event_edges(nodes))


def by_joins(model, nodes, edges, how):
    """Scores layer by layer, the edges joined anew each time."""
    import numpy as np

    rows = {(r.graph_id, r.node_id): np.array(r.x, float) for r in nodes.collect()}
    into = {}
    for e in edges.collect():
        into.setdefault((e.graph_id, e.dst), []).append((e.graph_id, e.src))
    for k in range(model.layers):
        keys = list(rows)
        h = np.stack([rows[i] for i in keys])
        near = np.stack([sum((rows[j] for j in into.get(i, ())), np.zeros(h.shape[1])) / (max(len(into.get(i, ())), 1) if how == "mean" else 1) for i in keys])
        rows = dict(zip(keys, model.layer(k, h, near), strict=True))
    return {i: float(v @ model.weights["head"][:, 0] + model.weights["head.bias"][0]) for i, v in rows.items()}


@pytest.mark.parametrize(("model", "how"), [(Sage(6, 8, 3).init(1), "mean"), (Gin(6, 8, 3).init(1), "sum")])
@pytest.mark.parametrize("heavy_from", [100_000, 3])
def test_scores_over_a_wiring(events, model, how, heavy_from):
    nodes, edges = events
    wiring = Wiring.of(nodes, edges, heavy_from=heavy_from)
    assert (wiring.shares is None) == (heavy_from > 3)
    got = {(r.graph_id, r.node_id): r.yhat for r in model.transform(nodes, edges, wiring).collect()}
    want = by_joins(model, nodes, edges, how)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_edges_are_dealt_once_for_four_layers(spark, events):
    nodes, edges = events
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wiring = Wiring.of(nodes, edges)
        scored = Sage(6, 8, 4).init(1).transform(nodes, edges, wiring)
        scored.collect()
        plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scans = [i for i, line in enumerate(lines) if "Scan ExistingRDD" in line and "own#" in line]
    assert len(scans) == 4
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for i in scans:  # nothing is moved between the edges and the join that reads them
        up = [line for j, line in enumerate(lines[:i]) if all(depth(line) < depth(x) for x in lines[j + 1 : i + 1])]
        below = up[max(j for j, line in enumerate(up) if "SortMergeJoin" in line) :]
        assert not any("Exchange" in line or "Sort [" in line for line in below)
    # The first states, the messages of each layer, the states behind each dense step, both sides of the last join.
    assert plan.count("Exchange hashpartitioning") <= 10


def test_a_hub_is_dealt_in_shares(spark):
    d = 5000
    edges = spark.range(1, d + 1).selectExpr("'g' AS graph_id", "0L AS src", "id AS dst")
    nodes = spark.range(0, d + 1).selectExpr("'g' AS graph_id", "id AS node_id", "array(cast(id AS float)) AS x")
    wiring = Wiring.of(nodes, edges, partitions=8, heavy_from=500)
    assert [tuple(r) for r in wiring.shares.collect()] == [("g", 0, 11)]
    assert wiring.edges.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < d / 2
    back = wiring.passed(neighbor_aggregate(nodes, edges, "x", 1, "sum", "n").select("graph_id", "node_id", F.array(F.col("node_id") + 1.0).alias("v")), "v", 1, "sum")
    got = {r.node_id: (r.own[0], r.near[0]) for r in back.collect()}
    assert got == {i: (i + 1.0, 0.0 if i == 0 else 1.0) for i in range(d + 1)}


def test_wiring_of_odd_rows(spark):
    nodes = spark.createDataFrame([("a", 1, [1.0]), (None, 2, [1.0])], "graph_id string, node_id bigint, x array<float>")
    edges = spark.createDataFrame([("a", 1, 1), (None, 2, 2)], EDGES)
    got = {r.graph_id: r.yhat for r in Sage(1, 4, 1).init(0).transform(nodes, edges).collect()}
    assert got["a"] is not None and got[None] is None
    assert Sage(1, 4, 1).init(0).transform(nodes.where("false"), edges).count() == 0
