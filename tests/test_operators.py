"""Hand-checkable graphs, NumPy formulas and properties."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nodeloom.operators import audit, bins, graphs, losses, markers, prep
from nodeloom.operators.components import connected_components
from nodeloom.operators.quantiles import exact_quantiles, row_ranks
from nodeloom.sources.builders import build_graph, with_minibatch


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def triangle(spark):
    """A triangle 0-1-2 and an isolated node 3; a repeated pair, a reversed pair and a loop among the raw edges."""
    nodes, raw = build_graph(spark, "t", [[1, 0], [1, 1], [0, 1], [0, 0]], [1.0, 2.0, 3.0, 10.0], [(0, 1), (1, 0), (0, 1), (1, 2), (0, 2), (2, 2)])
    return nodes, graphs.normalise_edges(raw), raw


def test_normalised_edges(triangle):
    assert rows(triangle[1], "src", "dst") == [("t", 0, 1), ("t", 0, 2), ("t", 1, 0), ("t", 1, 2), ("t", 2, 0), ("t", 2, 1)]


def test_integrity(spark, triangle):
    nodes, edges, raw = triangle
    g = nodes.groupBy("graph_id").count().withColumnRenamed("count", "n_nodes")
    clean = audit.edge_integrity(g, edges).first()
    assert (clean.num_nodes, clean.num_edges, clean.self_loops, clean.out_of_range, clean.duplicate_directed, clean.repeated_edges, clean.undirected_symmetry_ratio) == (4, 6, 0, 0, 6, 0, 1.0)
    dirty = audit.edge_integrity(g, raw.selectExpr("graph_id", "u as src", "v + 2 as dst")).first()
    assert dirty.out_of_range == 3 and dirty.num_edges == 6 and dirty.repeated_edges == 1
    none = audit.edge_integrity(g, edges.where("false")).first()
    assert none.num_edges == 0 and none.undirected_symmetry_ratio == 0.0


def test_ablation_and_marker_alignment(triangle):
    from pyspark.sql import functions as F

    nodes, edges, _ = triangle

    class Counted:
        """yhat = number of in-edges and the first marker."""

        def transform(self, nodes, edges):
            return audit.degrees(nodes, edges).join(nodes, ["graph_id", "node_id"]).withColumn("yhat", F.col("deg") + F.get("x", F.lit(0)))

    got = {r["case"]: (r.mae, r.mse) for r in audit.ablation(Counted(), nodes, edges).collect()}
    y, x0, deg = np.array([1.0, 2, 3, 10]), np.array([1.0, 1, 0, 0]), np.array([2, 2, 2, 0])
    moved = np.array([r.x[0] for r in audit.permuted_features(nodes).orderBy("node_id").collect()])
    for case, p in (("normal", deg + x0), ("no_edges", x0), ("shuffled_x", deg + moved)):
        assert got[case] == (pytest.approx(np.abs(p - y).mean()), pytest.approx(((p - y) ** 2).mean()))
    assert sorted(moved) == sorted(x0) and audit.ablation(Counted(), nodes.where("false"), edges).count() == 0
    g = nodes.groupBy("graph_id").count().withColumnRenamed("count", "n_nodes")
    said = [audit.audit_graphs(g, nodes, edges, marker_names=names).first().marker_alignment_error for names in (None, ["a", "b"], ["a"])]
    assert said[:2] == [None, None] and "1" in said[2] and "2" in said[2]


def test_degrees_components_reach(triangle):
    nodes, edges, _ = triangle
    d = audit.degree_stats(nodes, edges).first()
    assert (d.deg0_frac, d.deg_mean, d.deg_p50, d.deg_max) == (0.25, 1.5, 2.0, 2) and d.deg_p90 == pytest.approx(2.0)
    c = audit.component_ids(audit.components(nodes, edges))
    assert [(r.node_id, r.component_id) for r in c.orderBy("node_id").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1)]
    assert tuple(audit.component_stats(c).first()) == ("t", 2, 2, 3)
    assert audit.two_hop_reach(nodes, edges).first().two_hop_frac == pytest.approx((3 * 3 + 1) / 16)


def test_moran_and_constant_target(triangle):
    nodes, edges, _ = triangle
    y = np.array([1.0, 2, 3, 10])
    z = y - y.mean()
    pairs = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    want = sum(z[a] * z[b] for a, b in pairs) * 4 / ((z @ z + 1e-12) * 6)
    assert audit.moran_like_i(nodes, edges).first().moran_i == pytest.approx(want)
    shifted = audit.moran_like_i(nodes.withColumn("y", nodes.y + 100), edges).first().moran_i
    assert shifted == pytest.approx(want)
    assert audit.moran_like_i(nodes.selectExpr("graph_id", "node_id", "x", "5D as y"), edges).first().moran_i == 0.0


def test_homophily(triangle):
    nodes, edges, _ = triangle
    got = {r.marker_id: r for r in audit.homophily_by_marker(nodes, edges).collect()}
    assert got[0].edge_agreement == pytest.approx(2 / 6) and got[0].neighbor_positive_rate == pytest.approx((0.5 + 0.5 + 1) / 3)
    empty = audit.homophily_by_marker(nodes, edges.where("false")).collect()
    assert len(empty) == 2 and all(r.edge_agreement is None for r in empty)


def test_path_two_hops_and_egos(spark):
    nodes, raw = build_graph(spark, "p", [[0]] * 4, [0.0] * 4, [(0, 1), (1, 2), (2, 3)])
    edges = graphs.normalise_edges(raw)
    assert {(r.src, r.dst) for r in graphs.two_hop_pairs(edges).collect()} == {(0, 2), (2, 0), (1, 3), (3, 1)}
    assert graphs.add_two_hop_edges(edges, keep_one_hop=False).count() == 4
    assert graphs.add_two_hop_edges(edges, include_self_loops=True).where("src = dst").count() == 4
    egos = graphs.ego_nodes(nodes, edges, 1)
    assert [(r.node_id, r.hop, r.local_id) for r in egos.where("center = 1").orderBy("node_id").collect()] == [(0, 1, 0), (1, 0, 1), (2, 1, 2)]
    assert graphs.ego_edges(egos, edges).where("center = 1").count() == 4
    n, e = graphs.ego_dataset(nodes, edges, 1, max_centers=2)
    assert n.select("center").distinct().count() == 2 and e.count() > 0


def test_components_random(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 620)] + [(700, i) for i in range(701, 760)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    parent = list(range(800))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for p in pairs for i in p if p[0] != p[1]}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_marker_without_positives_and_full_marker(spark):
    nodes, _ = build_graph(spark, "m", [[0, 1, 0.5], [0, 1, float("nan")], [0, 1, 0]], [1.0, 2.0, 6.0])
    dim = markers.marker_dimension(spark, ["none", "all", "edge"])
    base = {r.name: r for r in markers.marker_baseline(nodes, dim).collect()}
    assert base["none"].n_pos == 0 and base["none"].mu_pos == 3.0 and base["all"].mu_pos == 3.0 and base["edge"].n_pos == 0
    assert base["all"].mu_none == 3.0 and base["all"].count_none == 0
    assert markers.marker_baseline(nodes, dim, empty="null").where("name = 'none'").first().mu_pos is None
    assert markers.marker_baseline(nodes, dim, empty="zero").where("name = 'none'").first().mu_pos == 0.0
    stats = {r.name: r for r in markers.marker_mean_std(nodes.withColumn("yhat", nodes.y), dim).collect()}
    assert stats["none"].y_mean is None and stats["none"].n_pos == 0 and stats["all"].y_std == pytest.approx(np.std([1, 2, 6]))


def test_marker_names(spark):
    name = lambda **k: [r.name for r in markers.marker_dimension(spark, **k).orderBy("marker_id").collect()]
    assert name(names=["a"], width=3) == ["a", "m1", "m2"] and name(names=list("abc"), width=2, policy="fit") == ["a", "b"]
    assert name(names=["a"], width=2, policy="replace") == ["m0", "m1"]
    with pytest.raises(ValueError):
        markers.marker_dimension(spark, ["a"], 2, "strict")
    found = markers.wanted_markers(markers.marker_dimension(spark, ["a", "b"]), ["b", "z"]).orderBy("ordinal").collect()
    assert [r.marker_id for r in found] == [1, None]


def test_residualised_adds_up(spark):
    nodes, _ = build_graph(spark, "m", [[1, 0], [1, 1], [0, 0]], [1.0, 3.0, 7.0])
    dim = markers.marker_dimension(spark, ["a", "b"])
    res = markers.residualize(nodes, markers.marker_baseline(nodes, dim)).orderBy("node_id").collect()
    assert [r.y_base for r in res] == [2.0, 2.5, 7.0] and all(r.y + r.y_base == pytest.approx(r.y_orig) for r in res)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, -0.0, 1.0, 2.0])), min_size=1, max_size=60), st.integers(2, 9))
def test_quantiles_equal_numpy(spark, values, n):
    probs = [i / n for i in range(n + 1)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = exact_quantiles(df, "v", probs, ["g"], chunks=4, group_rows=20).first()
    assert got.n == len(values)
    np.testing.assert_allclose(got.q, np.quantile(values, probs), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(exact_quantiles(df, "v", probs).first().q, got.q)


def test_quantiles_of_large_and_small_groups(spark):
    """Both ways in one table, a null key in each."""
    rng = np.random.default_rng(1)
    data = {None: rng.normal(size=300), "a": rng.integers(0, 5, 200).astype(float), "b": rng.normal(size=7), "c": np.array([2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "g string, v double")
    for rows in (0, 10, 250, 1000):
        got = {r.g: (r.n, r.q) for r in exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0], ["g"], chunks=8, group_rows=rows).collect()}
        assert set(got) == set(data)
        for k, v in data.items():
            assert got[k][0] == len(v)
            np.testing.assert_allclose(got[k][1], np.quantile(v, [0.0, 0.1, 0.5, 0.99, 1.0]), rtol=1e-12)


def test_small_side_counts_bytes(spark):
    from nodeloom.storage import small_side

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    rows = spark.range(50).selectExpr("id", "array_repeat(1D, 100) AS a", "repeat('x', 10) AS s")
    assert hinted(small_side(rows)) and not hinted(small_side(rows, 30_000)) and hinted(small_side(rows.where("false"), 1))


def test_quantiles_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 5.0)], "g string, v double")
    got = {r.g: r.q for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {None: [2.0], "b": [5.0]}
    assert exact_quantiles(df.where("false"), "v", [0.5], ["g"]).count() == 0


def test_bins_drop_the_top_edge_and_histogram_keeps_it(spark):
    df = spark.createDataFrame([(float(i), float(i) + 1) for i in range(13)], "y double, yhat double")
    e = bins.edges_of(df, nbins=4)
    got = bins.binned_metrics(df, e).orderBy("bin").collect()
    assert sum(r["count"] for r in got) == 12 and all(r.MAE == 1.0 and r.bias == 1.0 for r in got)
    assert bins.uniform_weighted_mse(df, e).first().uw_mse == 1.0
    h = bins.histogram(df, "y", 0.0, 12.0, 4).orderBy("bin").collect()
    want, _ = np.histogram(np.arange(13.0), bins=np.linspace(0, 12, 5))
    assert [r["count"] for r in h] == want.tolist() and sum(r.density * 3 for r in h) == pytest.approx(1)


def test_empty_bin_and_constant_series(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (9.0, 9.0), (10.0, 9.0)], "y double, yhat double")
    got = bins.binned_metrics(df, bins.edges_of(df, nbins=4, strategy="uniform", fallback="range")).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 0, 0, 1] and got[1].MAE is None
    same = spark.createDataFrame([(1.0, 2.0)] * 3, "y double, yhat double")
    assert bins.uniform_weighted_mse(same, bins.edges_of(same, nbins=4)).first().n_bins == 0
    with pytest.raises(ValueError):
        bins.edges_of(df, strategy="other")


def test_edges_by_time_meet_over_bucket_borders(spark):
    df = spark.sql("select 'g' as graph_id, id as node_id, timestamp_ntz'2024-01-01 05:59:00' + make_interval(0,0,0,0,0, int(id) * 90) as ts from range(6)")
    got = {(r.u, r.v) for r in graphs.connect_by_time(df, hours=6).collect()}
    assert got == {(a, b) for a in range(6) for b in range(a + 1, 6) if (b - a) * 90 <= 360}


def test_split_sample_scaling(spark):
    g = spark.createDataFrame([(f"g{i}",) for i in range(11)], "graph_id string")
    split = prep.split_graphs(g, 0.2)
    assert split.where("split = 'val'").count() == 2 and split.count() == 11
    assert prep.split_graphs(g.limit(1)).first().split == "val"
    assert sorted(r["rank"] for r in prep.hash_rank(g, "graph_id", 1).collect()) == list(range(1, 12))
    assert prep.sample_graphs(g, 4).count() == 4
    t = spark.createDataFrame([(2.0,)] * 3, "y double")
    assert tuple(prep.target_scaling(t).first()) == (2.0, 1.0) and tuple(prep.target_scaling(t, robust=True).first()) == (2.0, 1.0)
    kept, limits = prep.filter_outliers(spark.createDataFrame([(f"g{i}", i, float(i)) for i in range(10)], "graph_id string, node_id int, y double"), None, 80)
    assert kept.count() == 8 and math.isinf(limits.first().low)
    with pytest.raises(ValueError):
        prep.graph_stat(kept, "mode")


def test_top_by_puts_null_last(spark):
    df = spark.createDataFrame([(0, None), (1, -5.0), (2, 5.0), (3, 1.0)], "marker_id int, m double")
    assert [r.marker_id for r in prep.top_by(df, "m", 3).collect()] == [1, 2, 3]


def test_calibration_equals_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, yhat double")
    r = p - y
    got = losses.calibration(df).first()
    assert got.penalty == pytest.approx(np.corrcoef(r, y)[0, 1] ** 2) and got.residual_slope == pytest.approx(np.polyfit(y, r, 1)[0])
    assert losses.calibration(df, mode="cov").first().penalty == pytest.approx(np.cov(r, y, bias=True)[0, 1] ** 2)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, yhat double")
    assert losses.calibration(flat).first().penalty == 0.0
    with pytest.raises(ValueError):
        losses.calibration(df, mode="x")


def test_minibatches_deal_every_graph(spark):
    g = spark.createDataFrame([(f"g{i}",) for i in range(40)], "graph_id string")
    a, b = with_minibatch(g, 4, 0), with_minibatch(g, 4, 1)
    assert a.select("batch").distinct().count() == 4 and a.exceptAll(b).count() > 0


def test_stream_of_node_files(spark, tmp_path):
    from nodeloom.streaming.marker_stream import node_stream, write_marker_stats

    one, _ = build_graph(spark, "a", [[1, 0], [1, 1]], [1.0, 3.0])
    two, _ = build_graph(spark, "b", [[0, 1], [0, 0]], [5.0, 9.0])
    one.write.parquet(str(tmp_path / "in"))
    write_marker_stats(node_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    two.write.mode("append").parquet(str(tmp_path / "in"))
    write_marker_stats(node_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r.marker_id: (r.n_pos, r.y_mean) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (2, 2.0), 1: (2, 4.0)}


def test_top_coefficients(spark):
    df = spark.createDataFrame([("self", "a", -3.0), ("self", "b", 2.0), ("self", "c", None), ("cross", "a:b", 1.0)], "kind string, name string, weight double")
    assert {(r.kind, r.name, r["rank"]) for r in prep.top_coefficients(df, 2).collect()} == {("self", "a", 1), ("self", "b", 2), ("cross", "a:b", 1)}


def test_row_ranks_of_a_hot_group(spark):
    df = spark.createDataFrame([("hot", (i * 7919) % 1000) for i in range(1000)] + [("a", 5), ("a", 2), (None, 1)], "g string, v int")
    got = row_ranks(df, "g", df.v, ["v"], chunks=8)
    assert all(r["rank"] == r.v + 1 for r in got.where("g = 'hot'").collect())
    assert {(r.v, r["rank"]) for r in got.where("g = 'a'").collect()} == {(2, 1), (5, 2)} and got.count() == 1002
