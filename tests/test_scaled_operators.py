"""Contraction before the star rounds, chunks that grow with rows, and egos that visit a node once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import audit, components, graphs, prep, quantiles
from nodeloom.operators.components import contracted

EDGES = "graph_id string, src bigint, dst bigint"


def plain_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, a, b in edges:
        x, y = sorted((root((g, a)), root((g, b))))
        parent[y] = x
    return {x: root(x) for x in parent}


@pytest.mark.parametrize(("graph_links", "part_nodes"), [(10**6, 10**6), (20, 10**6), (20, 5), (10**6, 3)])
def test_contraction_keeps_components(spark, graph_links, part_nodes):
    rng = random.Random(1)
    edges = [(f"g{rng.randrange(3)}", a := rng.randrange(80), a + rng.choice([1, 2, 40, -1])) for _ in range(150)] + [("g0", 5, 5), (None, 1, 2)]
    left = contracted(spark.createDataFrame(edges, EDGES), graph_links, part_nodes)
    rows = [tuple(r) for r in left.collect()]
    real = [e for e in edges if e[0] and e[1] != e[2]]
    assert plain_components(rows) == plain_components(real)
    if graph_links == part_nodes == 10**6:  # settled: a link from each node to its root
        assert {(g, a): (g, b) for g, a, b in rows} == {x: r for x, r in plain_components(real).items() if x != r}


def test_a_contracted_chain_takes_one_round(spark, monkeypatch):
    """A path of 2,000 nodes, which star rounds alone halve again and again."""
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda links, small: rounds.append(small) or star(links, small))
    nodes = spark.range(2000).selectExpr("'g' AS graph_id", "id AS node_id")
    edges = spark.range(1999).selectExpr("'g' AS graph_id", "id AS src", "id + 1 AS dst")
    got = audit.components(nodes, edges)
    assert got.where("root = 0").count() == 2000 and len(rounds) == 2
    rounds.clear()
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    assert components.connected_components(links).where("component = 0").count() == 2000 and len(rounds) > 6


@pytest.mark.parametrize("n", [500, 20_000])
def test_chunks_grow_with_rows(spark, n):
    """At most about 50 rows a chunk, whatever their number; ranks and quantiles stay exact."""
    df = spark.range(n).select(F.lit("g").alias("g"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    splits, chunks = quantiles.chunk_splits(df, ["g"], "v", chunk_rows=50)
    assert chunks == (64 if n == 500 else 441) and len(splits.first()._s) == chunks - 1
    placed = df.join(splits, "g").withColumn("chunk", quantiles.chunk_of("v", chunks)).withColumn("plain", F.size(F.filter("_s", lambda s: s <= F.col("v"))))
    assert placed.where("chunk <> plain").count() == 0 and placed.groupBy("chunk").count().agg(F.max("count")).first()[0] <= max(100, 3 * n / chunks)
    ranked = quantiles.row_ranks(df, "g", F.col("v"), ["v"], chunk_rows=50)
    assert ranked.where(F.col("rank") != F.col("v") + 1).count() == 0
    got = quantiles.exact_quantiles(df, "v", [0.1, 0.5, 0.77], ["g"], group_rows=10, chunk_rows=50).first().q
    assert got == pytest.approx(np.quantile(np.arange(n), [0.1, 0.5, 0.77]).tolist())


def test_hash_ranks_of_many_chunks(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    got = sorted((r["rank"], r["k"]) for r in prep.hash_rank(df, "k", 5).collect())
    import hashlib

    want = sorted(map(str, range(3000)), key=lambda k: (hashlib.md5(f"{k}:5".encode()).hexdigest(), k))
    assert [r for r, _ in got] == list(range(1, 3001)) and [k for _, k in got] == want


def plain_egos(n, edges, hops):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = {}
    for c in range(n):
        seen, rim = {c: 0}, {c}
        for h in range(1, hops + 1):
            rim = {b for a in rim for b in near.get(a, ()) if b not in seen}
            seen |= dict.fromkeys(rim, h)
        out |= {(c, v): (h, i) for i, (v, h) in enumerate(sorted(seen.items()))}
    return out


@pytest.mark.parametrize("group_rows", [100_000, 8])
def test_three_hops_around_a_hub(spark, group_rows):
    rng = random.Random(3)
    pairs = {(0, i) for i in range(1, 12)} | {(rng.randrange(1, 30), rng.randrange(1, 30)) for _ in range(25)}
    arcs = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}
    nodes = spark.range(30).selectExpr("'g' AS graph_id", "id AS node_id")
    edges = spark.createDataFrame([("g", a, b) for a, b in arcs], EDGES)
    for hops in (1, 3):
        got = graphs.ego_nodes(nodes, edges, hops, group_rows=group_rows)
        assert {(r.center, r.node_id): (r.hop, r.local_id) for r in got.collect()} == plain_egos(30, arcs, hops)
    assert dict(got.dtypes)["local_id"] == "int"


def test_chosen_centres_are_limited_before_the_shuffle(spark):
    nodes = spark.range(1000).selectExpr("'g' AS graph_id", "id AS node_id")
    edges = spark.createDataFrame([], EDGES)
    assert graphs.ego_nodes(nodes, edges, 1, 3).count() == 3
    order = F.md5(F.concat_ws(":", F.col("node_id").cast("string"), F.lit("0")))
    first = [r.node_id for r in nodes.orderBy(order, "node_id").limit(3).collect()]
    assert sorted(first) == sorted(r.center for r in graphs.ego_nodes(nodes, edges, 1, 3).collect())
    assert graphs.ego_nodes(nodes.where("false"), edges, 2).count() == 0


def test_small_groups_are_ranked_without_chunks(spark, monkeypatch):
    """only groups beyond ``group_rows`` are cut into chunks; both kinds get the same ranks."""
    df = spark.range(300).select(F.when(F.col("id") < 250, "large").when(F.col("id") < 299, "small").alias("g"), F.pmod(F.col("id") * 7919, F.lit(300)).alias("v"))
    seen, made = [], quantiles.chunk_splits
    monkeypatch.setattr(quantiles, "chunk_splits", lambda rows, *a: seen.append({r.g for r in rows.select("g").distinct().collect()}) or made(rows, *a))
    got = [sorted(map(tuple, quantiles.row_ranks(df, "g", F.col("v"), ["v"], group_rows=n).collect())) for n in (1000, 100, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 299 and seen == [{"large"}, {"large", "small"}]


def test_raw_pairs_are_made_once(spark):
    """F11 to F17: both directions come from one pass over the pairs."""
    raw = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("a", 3, 3), (None, 1, 4), ("b", 5, None)], "g string, u bigint, v bigint").selectExpr("g as graph_id", "u", "v")
    out = graphs.normalise_edges(raw)
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([("a", 1, 2), ("a", 2, 1), (None, 1, 4), (None, 4, 1)], "graph_id string, src bigint, dst bigint").collect()))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
