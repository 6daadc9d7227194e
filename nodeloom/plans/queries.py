"""Named queries of the library's operators over the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom import schema
from nodeloom.functions.columns import inverse_transform
from nodeloom.models.message_passing import Gin, Sage, neighbor_aggregate
from nodeloom.models.training import Joined, TrainConfig, depth_scan, epoch_sweep, joined_sums, lbfgs, packed_graphs, train
from nodeloom.operators import audit, bins, graphs, losses, markers, prep, reach, sketches
from nodeloom.operators.quantiles import exact_quantiles, row_ranks
from nodeloom.plans import fixtures as fx
from nodeloom.sources import npz, npz_source, sidecars
from nodeloom.sources.builders import minibatch_of_size
from nodeloom.sources.files import write_files
from nodeloom.storage import checkpointed, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Common table expressions that mirror plans/fixtures.py.
NODES = """nodes AS (SELECT CAST(user_id AS VARCHAR) AS graph_id, event_id AS node_id, value AS y, ts, [CAST(event_type = 'click' AS DOUBLE),
  CAST(event_type = 'purchase' AS DOUBLE), CAST(event_type = 'signup' AS DOUBLE), CAST(event_type = 'view' AS DOUBLE),
  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS DOUBLE), CAST(hour(ts) < 6 AS DOUBLE)] AS x FROM events)"""
NAMES = "markers(marker_id, name) AS (VALUES (0,'click'),(1,'purchase'),(2,'signup'),(3,'view'),(4,'k50'),(5,'night'))"
PAIRS = """pairs AS (SELECT a.graph_id, a.node_id AS u, b.node_id AS v FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id
  AND a.node_id < b.node_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR)"""
EDGES = f"{PAIRS}, edges AS (SELECT graph_id, u AS src, v AS dst FROM pairs UNION SELECT graph_id, v, u FROM pairs)"
LONG = "long AS (SELECT graph_id, node_id, y, i - 1 AS marker_id, x[i] AS v FROM nodes, range(1, 7) r(i)), pos AS (SELECT * FROM long WHERE v > 0.5)"
MU = """overall AS (SELECT avg(y) AS mu_global, avg(y) FILTER (WHERE list_sum(x) = 0) AS mu_none, count(*) FILTER (WHERE list_sum(x) = 0) AS count_none FROM nodes),
mu AS (SELECT m.marker_id, m.name, avg(p.y) AS mu_pos, count(p.y) AS n_pos FROM markers m LEFT JOIN pos p USING (marker_id) GROUP BY ALL)"""
PRED = """b AS (SELECT n.graph_id, n.node_id, CASE WHEN list_sum(any_value(n.x)) > 0 THEN sum(l.v * coalesce(mu.mu_pos, overall.mu_global)) / sum(l.v) ELSE any_value(overall.mu_none) END AS b
  FROM nodes n JOIN long l USING (graph_id, node_id) JOIN mu ON mu.marker_id = l.marker_id, overall GROUP BY n.graph_id, n.node_id),
near AS (SELECT e.graph_id, e.dst AS node_id, avg(n.y) AS near FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.node_id = e.src GROUP BY ALL),
pred AS (SELECT n.graph_id, n.node_id, n.y, n.x, b.b, coalesce(0.5 * b.b + 0.5 * near.near, b.b) AS yhat FROM nodes n JOIN b USING (graph_id, node_id) LEFT JOIN near USING (graph_id, node_id)),
ppos AS (SELECT pred.*, pos.marker_id FROM pred JOIN pos USING (graph_id, node_id))"""
ALL = f"WITH RECURSIVE {NODES}, {NAMES}, {EDGES}, {LONG}, {MU}, {PRED}"
SMALL = f"WITH {NODES}, {NAMES}, {LONG}, {MU}"
EDGED = f"WITH RECURSIVE {NODES}, {NAMES}, {EDGES}, {LONG}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 turned to 0.0), so that the order of additions doesn't show."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def edges_sql(source: str, nbins: int, y: str = "y", by: str = "", strategy: str = "quantile", fallback: str = "clipped") -> str:
    """CTEs q, edges_of(by, edges) and bin_rows(by, bin, edge_lo, edge_hi) of ``source``."""
    probs = ", ".join(repr(i / nbins) for i in range(nbins + 1))
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    lo, hi = ("c[1]", "c[2]") if fallback == "clipped" else ("q[1]", f"q[{nbins + 1}]")
    equal = f"list_transform(range(0, {nbins + 1}), lambda i: CASE WHEN i = {nbins} THEN {hi} ELSE {lo} + ({hi} - {lo}) * i / {float(nbins)} END)"
    distinct = "list_sort(list_distinct(list_transform(q, lambda e: e + 0.0)))"
    enough = nbins + 1 if fallback == "clipped" else 3
    edges = equal if strategy == "uniform" else f"CASE WHEN len({distinct}) < {enough} THEN {equal} ELSE {distinct} END"
    return f"""q AS (SELECT {keys}quantile_cont({y}, [{probs}]) AS q, quantile_cont({y}, [0.01, 0.99]) AS c FROM {source} {group}),
edges_of AS (SELECT {keys}{edges} AS edges FROM q),
bin_rows AS (SELECT {keys}i - 1 AS bin, edges[i] AS edge_lo, edges[i + 1] AS edge_hi, edges FROM edges_of, range(1, {nbins + 5}) r(i) WHERE i < len(edges))"""


def binned_sql(source: str, y: str, by: str, aggs: str) -> str:
    """Bins left-joined with the rows of ``source`` (alias p) that fall in them."""
    on = f"p.{by} = br.{by} AND " if by else ""
    keys = f"br.{by}, " if by else ""
    return f"SELECT {keys}CAST(br.bin AS INTEGER) AS bin, br.edge_lo, br.edge_hi, count(p.{y}) AS count{', ' if aggs else ''}{aggs} FROM bin_rows br LEFT JOIN {source} p ON {on}p.{y} >= br.edge_lo AND p.{y} < br.edge_hi GROUP BY {keys}br.bin, br.edge_lo, br.edge_hi"


def out(sql: str, columns: str) -> str:
    """Outer SELECT with doubles rounded: 'a b|c d' rounds c and d and keeps a and b."""
    plain, _, real = columns.partition("|")
    return f"SELECT {', '.join([*plain.split(), *(f'round({c}, 6) + 0.0 AS {c}' for c in real.split())])} FROM ({sql})"


# --- markers ---------------------------------------------------------------------------------------


@query(f"{SMALL} SELECT CAST(marker_id AS INTEGER) AS marker_id, name, n_pos FROM mu")
def marker_positive_counts(spark, d):
    return markers.positive_counts(fx.event_nodes(spark, d), fx.event_markers(spark))


def _baseline_sql(fallback: str) -> str:
    return f"{SMALL} " + out(f"SELECT CAST(marker_id AS INTEGER) AS marker_id, name, coalesce(mu_pos, {fallback}) AS mu_pos, n_pos, coalesce(mu_none, mu_global) AS mu_none, count_none, mu_global FROM mu, overall", "marker_id name n_pos count_none|mu_pos mu_none mu_global")


@query(_baseline_sql("mu_global"))
def marker_baseline(spark, d):
    return markers.marker_baseline(fx.event_nodes(spark, d), fx.event_markers(spark))


@query(_baseline_sql("0.0"))
def marker_baseline_zero(spark, d):
    return markers.marker_baseline(fx.event_nodes(spark, d), fx.event_markers(spark), empty="zero")


@query(f"{ALL} " + out("SELECT avg(y) AS y_mean, stddev_pop(y) AS y_std, avg(yhat) AS yhat_mean, stddev_pop(yhat) AS yhat_std FROM pred", "|y_mean y_std yhat_mean yhat_std"))
def overall_mean_std(spark, d):
    return markers.overall_mean_std(fx.event_predictions(spark, d))


@query(f"{ALL} " + out("SELECT CAST(marker_id AS INTEGER) AS marker_id, name, avg(y) AS y_mean, stddev_pop(y) AS y_std, avg(yhat) AS yhat_mean, stddev_pop(yhat) AS yhat_std, count(y) AS n_pos FROM markers LEFT JOIN ppos USING (marker_id) GROUP BY marker_id, name", "marker_id name n_pos|y_mean y_std yhat_mean yhat_std"))
def marker_mean_std(spark, d):
    return markers.marker_mean_std(fx.event_predictions(spark, d), fx.event_markers(spark))


MSE = "se AS (SELECT marker_id, pow(yhat - mu_pos, 2) AS se, mu_pos FROM ppos JOIN mu USING (marker_id))"


@query(f"{ALL}, {MSE} " + out("SELECT CAST(marker_id AS INTEGER) AS marker_id, name, avg(se) AS mse_mean, stddev_pop(se) / sqrt(count(se)) AS mse_sem, count(se) AS n_pos, any_value(se.mu_pos) AS mu FROM markers LEFT JOIN se USING (marker_id) GROUP BY marker_id, name", "marker_id name n_pos|mse_mean mse_sem mu"))
def marker_baseline_mse(spark, d):
    return markers.marker_baseline_mse(fx.event_predictions(spark, d), fx.event_markers(spark), fx.event_baseline(spark, d))


def _event_residuals(spark, d):
    """Residuals against the nodes' own marker means: these need the nodes only, so predictions are made once."""
    return markers.marker_residuals(fx.event_predictions(spark, d), fx.event_baseline(spark, d))


RES = "res AS (SELECT graph_id, node_id, marker_id, y - mu_pos AS r_base, y - yhat AS r_model FROM ppos JOIN mu USING (marker_id))"


@query(f"{ALL}, {RES} " + out("SELECT graph_id, node_id, CAST(marker_id AS INTEGER) AS marker_id, r_base, r_model FROM res", "graph_id node_id marker_id|r_base r_model"))
def marker_residuals(spark, d):
    return _event_residuals(spark, d)


def _residual_mse_sql(std: str) -> str:
    return f"{ALL}, {RES} " + out(
        f"""SELECT CAST(marker_id AS INTEGER) AS marker_id, name, avg(r_base * r_base) AS mse_baseline, avg(r_model * r_model) AS mse_model, {std}(r_base * r_base) / sqrt(count(r_base)) AS sem_baseline,
{std}(r_model * r_model) / sqrt(count(r_base)) AS sem_model, count(r_base) AS n_pos, avg(r_model * r_model) - avg(r_base * r_base) AS delta_model_minus_base FROM markers LEFT JOIN res USING (marker_id) GROUP BY marker_id, name""",
        "marker_id name n_pos|mse_baseline mse_model sem_baseline sem_model delta_model_minus_base",
    )


@query(_residual_mse_sql("stddev_pop"))
def marker_residual_mse(spark, d):
    return markers.residual_mse(_event_residuals(spark, d), fx.event_markers(spark))


@query(_residual_mse_sql("stddev_samp"))
def marker_residual_mse_sample(spark, d):
    return markers.residual_mse(_event_residuals(spark, d), fx.event_markers(spark), ddof=1)


@query(f"{ALL} " + out("SELECT graph_id, node_id, b AS y_base, y AS y_orig, y - b AS y FROM pred", "graph_id node_id|y y_orig y_base"))
def residualized_nodes(spark, d):
    nodes = fx.event_nodes(spark, d)
    return markers.residualize(nodes, markers.marker_baseline(nodes, fx.event_markers(spark))).select("graph_id", "node_id", "y", "y_orig", "y_base")


@query(f"{ALL} " + out("SELECT graph_id, node_id, b FROM pred", "graph_id node_id|b"))
def node_baseline_thresholded(spark, d):
    nodes = fx.event_nodes(spark, d)
    return markers.with_baseline(nodes, markers.marker_baseline(nodes, fx.event_markers(spark)), "b", thresholded=True).select("graph_id", "node_id", "b")


def _relative_sql(pred: str) -> str:
    return f"""{ALL}, each AS (SELECT graph_id, marker_id, avg(pow(y - {pred}, 2)) / (pow(any_value(mu_pos), 2) + 1e-8) AS rel FROM ppos JOIN mu USING (marker_id) GROUP BY graph_id, marker_id HAVING count(*) >= 10)
""" + out("SELECT CAST(marker_id AS INTEGER) AS marker_id, avg(rel) AS rel_mean, coalesce(stddev_samp(rel), 0) / sqrt(count(*)) AS rel_sem, count(*) AS n_graphs FROM each GROUP BY marker_id", "marker_id n_graphs|rel_mean rel_sem")


@query(_relative_sql("yhat"))
def relative_mse_model(spark, d):
    return markers.relative_mse_across_graphs(fx.event_predictions(spark, d), markers.marker_baseline(fx.event_nodes(spark, d), fx.event_markers(spark)))


@query(_relative_sql("mu_pos"))
def relative_mse_baseline(spark, d):
    return markers.relative_mse_across_graphs(fx.event_predictions(spark, d), markers.marker_baseline(fx.event_nodes(spark, d), fx.event_markers(spark)), against="baseline")


@query(f"""{SMALL} SELECT CAST(marker_id AS INTEGER) AS marker_id, name, round(p, 6) AS p, round(least((1 - p) / greatest(p, 1e-6), 100.0), 6) AS pos_weight
FROM (SELECT marker_id, avg(CAST(v > 0.5 AS DOUBLE)) AS p FROM long GROUP BY marker_id) JOIN markers USING (marker_id)""")
def marker_pos_weights(spark, d):
    return markers.pos_weights(fx.event_nodes(spark, d), fx.event_markers(spark))


@query(f"{SMALL} SELECT graph_id, node_id, round(y, 6) AS x0, x[5] AS t0, x[2] AS t1 FROM nodes")
def inverse_targets(spark, d):
    ids = [r.marker_id for r in markers.wanted_markers(fx.event_markers(spark), ["k50", "purchase"]).orderBy("ordinal").collect()]  # two rows
    chosen = markers.select_targets(fx.event_nodes(spark, d), ids)
    return chosen.select("graph_id", "node_id", F.get("x", F.lit(0)).alias("x0"), F.get("y", F.lit(0)).alias("t0"), F.get("y", F.lit(1)).alias("t1"))


def _label_scores(spark, d):
    """Truth from labels; the score is the document's length over the longest."""
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    longest = docs.agg(F.max("n_chars").alias("_m"))
    scored = docs.crossJoin(F.broadcast(longest)).select("doc_id", (F.col("n_chars") / F.col("_m")).alias("prob"))  # one row
    rows = fx.table(spark, d, "labels").join(scored, "doc_id")
    return rows.select("doc_id", "prob", F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("name", "truth"))


LABELLED = """WITH s AS (SELECT doc_id, n_chars / max(n_chars) OVER () AS prob FROM documents),
r AS (SELECT name, truth, prob FROM labels JOIN s USING (doc_id), LATERAL (VALUES ('quality', quality), ('toxic', toxic)) t(name, truth)),
c AS (SELECT name, count(*) FILTER (WHERE truth = 1 AND prob >= 0.05)::DOUBLE AS tp, count(*) FILTER (WHERE truth = 0 AND prob >= 0.05)::DOUBLE AS fp,
  count(*) FILTER (WHERE truth = 1 AND prob < 0.05)::DOUBLE AS fn, count(*) FILTER (WHERE truth = 0 AND prob < 0.05)::DOUBLE AS tn FROM r GROUP BY name),
m AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS acc, tp / (tp + fp + 1e-12) AS prec, tp / (tp + fn + 1e-12) AS rec, (tp + fn) / (tp + fp + fn + tn) AS positivity_rate FROM c)
"""


@query(LABELLED + out("SELECT *, 2 * prec * rec / (prec + rec + 1e-12) AS f1 FROM m", "name|tp fp fn tn acc prec rec f1 positivity_rate"))
def classification_metrics(spark, d):
    return markers.classification_metrics(_label_scores(spark, d), ["name"], "truth", "prob", 0.05)


@query(f"{SMALL} SELECT name_i, name_j, i, j FROM (SELECT a.name AS name_i, b.name AS name_j, CAST(a.marker_id AS INTEGER) AS i, CAST(b.marker_id AS INTEGER) AS j FROM markers a JOIN markers b ON a.marker_id < b.marker_id) ORDER BY i, j LIMIT 7")
def marker_cross_pairs(spark, d):
    return prep.marker_pairs(fx.event_markers(spark), 7)


@query(f"{ALL}, {RES} " + out("SELECT CAST(marker_id AS INTEGER) AS marker_id, avg(r_model * r_model) - avg(r_base * r_base) AS delta FROM res GROUP BY marker_id ORDER BY abs(delta) DESC, marker_id LIMIT 3", "marker_id|delta"))
def top_markers_by_delta(spark, d):
    mse = markers.residual_mse(_event_residuals(spark, d), fx.event_markers(spark))
    return prep.top_by(mse.select("marker_id", F.col("delta_model_minus_base").alias("delta")), "delta", 3)


@query(f"{ALL}, {RES}, d AS (SELECT marker_id, avg(r_model * r_model) - avg(r_base * r_base) AS delta FROM res GROUP BY marker_id ORDER BY abs(delta) DESC, marker_id LIMIT 3) SELECT CAST(d.marker_id AS INTEGER) AS marker_id, mu.name, round(delta, 6) + 0.0 AS delta, n_pos AS n_pos_other FROM d JOIN mu USING (marker_id)")
def aligned_by_name(spark, d):
    """The top markers of one table with the counts of another, whose ids differ, by name."""
    mse = markers.residual_mse(_event_residuals(spark, d), fx.event_markers(spark))
    chosen = prep.top_by(mse.select("marker_id", "name", F.col("delta_model_minus_base").alias("delta")), "delta", 3)
    counts = markers.positive_counts(fx.event_nodes(spark, d), fx.event_markers(spark)).select((F.col("marker_id") + 100).alias("marker_id"), "name", "n_pos")
    return prep.align_by_name(chosen, counts)


@query(f"{ALL} SELECT graph_id, node_id, round(CASE WHEN node_id % 2 = 0 THEN y ELSE y - b END, 6) + 0.0 AS y_true FROM pred")
def true_targets(spark, d):
    """``y_orig`` where there is one (here: of even nodes), else ``y``."""
    nodes = markers.residualize(fx.event_nodes(spark, d), fx.event_baseline(spark, d)).withColumn("y_orig", F.when(F.col("node_id") % 2 == 0, F.col("y_orig")))
    return nodes.select("graph_id", "node_id", markers.true_target(nodes).alias("y_true"))


@query("""SELECT * FROM (VALUES ('pad', 0, 'a'), ('pad', 1, 'b'), ('pad', 2, 'm2'), ('pad', 3, 'm3'), ('fit', 0, 'a'), ('replace', 0, 'm0'), ('replace', 1, 'm1'), ('replace', 2, 'm2'), ('strict', 0, 'a'), ('strict', 1, 'b')) t(policy, marker_id, name)""")
def marker_name_policies(spark, d):
    """Two names for four markers (pad), one (fit), three (replace) and two (strict)."""
    rows = [markers.marker_dimension(spark, ["a", "b"], width, policy).select(F.lit(policy).alias("policy"), "marker_id", "name") for policy, width in (("pad", 4), ("fit", 1), ("replace", 3), ("strict", 2))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# --- preparation -----------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT graph_id, round(median(y), 6) AS stat FROM nodes GROUP BY graph_id")
def graph_median(spark, d):
    return prep.graph_stat(fx.event_nodes(spark, d))


@query(f"WITH {NODES} SELECT graph_id, round(avg(y), 6) AS stat FROM nodes GROUP BY graph_id")
def graph_mean(spark, d):
    return prep.graph_stat(fx.event_nodes(spark, d), "mean")


@query(f"""WITH {NODES}, s AS (SELECT graph_id, median(y) AS stat FROM nodes GROUP BY graph_id), t AS (SELECT quantile_cont(stat, 0.05) AS lo, quantile_cont(stat, 0.9) AS hi FROM s)
SELECT graph_id, count(*) AS n_nodes FROM nodes WHERE graph_id IN (SELECT graph_id FROM s, t WHERE stat BETWEEN lo AND hi) GROUP BY graph_id""")
def filter_outliers(spark, d):
    return fx.event_graphs(prep.filter_outliers(fx.event_nodes(spark, d), 5, 90)[0])


def _meta_graphs(spark, d):
    """Graphs with metadata made of their counts; graphs of odd size have no complexity."""
    g = fx.event_graphs(fx.event_nodes(spark, d))
    n = F.col("n_nodes").cast("double")
    meta = g.where("n_nodes > 60").select("graph_id", F.map_filter(F.create_map(F.lit("complexity"), F.when(F.col("n_nodes") % 2 == 0, n / 50 - 2.3), F.lit("total_volume"), n * 2), lambda k, v: v.isNotNull()).alias("meta"), F.concat(F.lit("u"), "graph_id").alias("organoid_id"))
    return prep.attach_metadata(g, meta)


META = f"""WITH {NODES}, g AS (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY graph_id),
m AS (SELECT graph_id, n_nodes, n_nodes > 60 AS matched, CASE WHEN n_nodes > 60 AND n_nodes % 2 = 0 THEN n_nodes::DOUBLE / 50 - 2.3 END AS complexity, CASE WHEN n_nodes > 60 THEN n_nodes * 2.0::DOUBLE END AS total_volume FROM g)
"""


@query(META + "SELECT graph_id AS organoid, NULL::DOUBLE AS total_surface_area, round(total_volume, 6) AS total_volume, round(complexity, 6) AS complexity, n_nodes AS num_nodes FROM m")
def metadata_frame(spark, d):
    return prep.metadata_frame(_meta_graphs(spark, d), score="complexity")


@query(META + "SELECT graph_id, n_nodes FROM m WHERE complexity >= -1.0")
def filter_by_complexity(spark, d):
    return prep.filter_by_metadata(_meta_graphs(spark, d)).select("graph_id", "n_nodes")


SPLIT = f"""WITH {NODES}, g AS (SELECT DISTINCT graph_id FROM nodes), r AS (SELECT graph_id, row_number() OVER (ORDER BY md5(graph_id || ':42'), graph_id) AS rk, count(*) OVER () AS n FROM g),
split AS (SELECT graph_id, CASE WHEN rk <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM r)
"""


@query(SPLIT + "SELECT * FROM split")
def split_graphs(spark, d):
    return prep.split_graphs(fx.event_nodes(spark, d).select("graph_id"))


@query(f"WITH {NODES} SELECT graph_id, n_nodes FROM (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY graph_id) ORDER BY md5(graph_id || ':7'), graph_id LIMIT 5")
def sample_graphs(spark, d):
    return prep.sample_graphs(fx.event_graphs(fx.event_nodes(spark, d)), 5, 7)


def _standard(spark, d, robust):
    nodes = fx.event_nodes(spark, d).join(prep.split_graphs(fx.event_nodes(spark, d).select("graph_id")), "graph_id")
    return prep.standardize(nodes, prep.target_scaling(nodes.where("split = 'train'"), robust)).select("graph_id", "node_id", "split", "y")


@query(SPLIT + ", t AS (SELECT avg(y) AS c, stddev_pop(y) AS s FROM nodes JOIN split USING (graph_id) WHERE split = 'train') SELECT graph_id, node_id, split, round((y - c) / s, 6) + 0.0 AS y FROM nodes JOIN split USING (graph_id), t")
def standardized_targets(spark, d):
    return _standard(spark, d, False)


@query(SPLIT + ", t AS (SELECT median(y) AS c, (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.349 AS s FROM nodes JOIN split USING (graph_id) WHERE split = 'train') SELECT graph_id, node_id, split, round((y - c) / s, 6) + 0.0 AS y FROM nodes JOIN split USING (graph_id), t")
def standardized_targets_robust(spark, d):
    return _standard(spark, d, True)


@query(SPLIT + ", t AS (SELECT avg(y) AS c, stddev_pop(y) AS s FROM nodes JOIN split USING (graph_id) WHERE split = 'train') SELECT count(*) AS n, round(max(abs(((y - c) / s) * s + c - y)), 6) + 0.0 AS worst FROM nodes, t")
def inverse_transformed(spark, d):
    nodes = fx.event_nodes(spark, d).join(prep.split_graphs(fx.event_nodes(spark, d).select("graph_id")), "graph_id")
    scaling = prep.target_scaling(nodes.where("split = 'train'"))
    both = nodes.withColumn("y0", F.col("y")).crossJoin(F.broadcast(scaling)).withColumn("z", (F.col("y") - F.col("center")) / F.col("scale"))  # one row
    return both.agg(F.count("*").alias("n"), F.max(F.abs(inverse_transform(F.col("z"), F.col("scale"), F.col("center")) - F.col("y0"))).alias("worst"))


# --- bins ------------------------------------------------------------------------------------------


def _edge_rows(e: DataFrame) -> DataFrame:
    return bins.bin_rows(e)


def _edge_query(name: str, table: str, column: str, nbins: int, strategy: str = "quantile", fallback: str = "clipped") -> None:
    sql = f"WITH {edges_sql(table, nbins, column, '', strategy, fallback)} " + out("SELECT CAST(bin AS INTEGER) AS bin, edge_lo, edge_hi FROM bin_rows", "bin|edge_lo edge_hi")

    def run(spark, d):
        return _edge_rows(bins.edges_of(fx.table(spark, d, table), column, nbins, strategy, fallback=fallback))

    query(sql, name)(run)


_edge_query("quantile_edges", "events", "value", 12)
_edge_query("quantile_edges_ties", "lineitem", "l_quantity", 12)
_edge_query("quantile_edges_fallback", "lineitem", "l_discount", 12)
_edge_query("quantile_edges_no_fallback", "lineitem", "l_discount", 8)
_edge_query("quantile_edges_fewer", "lineitem", "l_discount", 12, fallback="range")
_edge_query("uniform_edges", "events", "value", 12, "uniform")
_edge_query("uniform_edges_range", "events", "value", 12, "uniform", "range")

METRICS = "avg(p.y) AS y_true_mean, stddev_pop(p.y) AS y_true_std, avg(p.yhat) AS y_pred_mean, avg(abs(p.yhat - p.y)) AS MAE, sqrt(avg(pow(p.yhat - p.y, 2))) AS RMSE, avg(p.yhat - p.y) AS bias"
METRIC_NAMES = "edge_lo edge_hi y_true_mean y_true_std y_pred_mean MAE RMSE bias"


@query(f"{ALL}, {edges_sql('pred', 12)} " + out(binned_sql("pred", "y", "", METRICS), f"bin count|{METRIC_NAMES}"))
def binned_metrics(spark, d):
    pred = checkpointed(fx.event_predictions(spark, d).select("y", "yhat"))
    return bins.binned_metrics(pred, bins.edges_of(pred))


@query(f"{ALL}, {edges_sql('pred', 8, strategy='uniform')} " + out(binned_sql("pred", "y", "", METRICS), f"bin count|{METRIC_NAMES}"))
def binned_metrics_uniform(spark, d):
    pred = checkpointed(fx.event_predictions(spark, d).select("y", "yhat"))
    return bins.binned_metrics(pred, bins.edges_of(pred, nbins=8, strategy="uniform"))


TOP = "top AS (SELECT marker_id, count(*) AS n FROM ppos GROUP BY marker_id HAVING count(*) >= 36 ORDER BY n DESC, marker_id LIMIT 4), tpos AS (SELECT * FROM ppos WHERE marker_id IN (SELECT marker_id FROM top))"


@query(f"{ALL}, {TOP}, {edges_sql('tpos', 12, by='marker_id')} " + out(binned_sql("tpos", "y", "marker_id", METRICS).replace("br.marker_id, CAST", "CAST(br.marker_id AS INTEGER) AS marker_id, CAST", 1), f"marker_id bin count|{METRIC_NAMES}"))
def binned_metrics_by_marker(spark, d):
    pred = fx.event_predictions(spark, d).select("x", "y", "yhat")
    rows = checkpointed(bins.marker_series(pred, max(30, 3 * 12), top=4))
    return bins.binned_metrics(rows, bins.edges_of(rows, by=["marker_id"]), ["marker_id"])


@query(f"{ALL}, {edges_sql('pred', 10)} " + out(binned_sql("pred", "y", "", "avg(abs(p.yhat - p.y)) AS value_mean"), "bin count|edge_lo edge_hi value_mean"))
def bin_by_target(spark, d):
    pred = checkpointed(fx.event_predictions(spark, d).select("y", F.abs(F.col("yhat") - F.col("y")).alias("e")))
    return bins.bin_means(pred, bins.edges_of(pred, nbins=10), "e")


@query(f"WITH {edges_sql('events', 12, 'value')} " + out("SELECT bin, edge_lo, edge_hi, coalesce(center, (edge_lo + edge_hi) / 2) AS center FROM (" + binned_sql("events", "value", "", "avg(p.value) AS center") + ")", "bin|edge_lo edge_hi center"))
def bin_centers(spark, d):
    rows = fx.table(spark, d, "events").select(F.col("value").alias("y"))
    return bins.with_centers(rows, bins.edges_of(rows))


UW = "avg(pow(p.yhat - p.y, 2)) AS mse, avg(p.y) AS y_mean"


@query(f"{ALL}, {edges_sql('pred', 8, strategy='uniform', fallback='range')} " + out(binned_sql("pred", "y", "", UW), "bin count|edge_lo edge_hi mse y_mean"))
def uniform_mse_bins(spark, d):
    pred = checkpointed(fx.event_predictions(spark, d).select("y", "yhat"))
    return bins.uniform_bins(pred, bins.edges_of(pred, nbins=8, strategy="uniform", fallback="range"))


def _uw(inner: str, by: str = "marker_id") -> str:
    return f"SELECT CAST({by} AS INTEGER) AS {by}, avg(mse) AS uw_mse, coalesce(stddev_samp(mse), 0) / sqrt(count(mse)) AS uw_sem, count(mse) AS n_bins FROM ({inner}) GROUP BY {by}"


@query(f"{ALL}, {edges_sql('ppos', 8, by='marker_id')} " + out(_uw(binned_sql("ppos", "y", "marker_id", UW)), "marker_id n_bins|uw_mse uw_sem"))
def uniform_weighted_mse(spark, d):
    rows = checkpointed(markers.positive_rows(fx.event_predictions(spark, d), "y", "yhat"))
    return bins.uniform_weighted_mse(rows, bins.edges_of(rows, nbins=8, by=["marker_id"]), ["marker_id"])


@query(f"{ALL}, {edges_sql('ppos', 8)}, shared AS (SELECT m.marker_id, br.* FROM bin_rows br, markers m) " + out(_uw(binned_sql("ppos", "y", "marker_id", UW).replace("bin_rows br", "shared br")), "marker_id n_bins|uw_mse uw_sem"))
def uniform_weighted_mse_shared(spark, d):
    rows = checkpointed(markers.positive_rows(fx.event_predictions(spark, d), "y", "yhat"))
    shared = bins.edges_of(rows, nbins=8).crossJoin(fx.event_markers(spark).select("marker_id"))  # one row of edges
    return bins.uniform_weighted_mse(rows, shared, ["marker_id"])


BOTH = "avg(pow(p.yhat - p.y, 2)) AS mse, avg(pow(p.b - p.y, 2)) AS mse_b"


@query(
    f"{ALL}, {edges_sql('ppos', 8, by='marker_id', fallback='range')} "
    + out(
        f"""SELECT CAST(marker_id AS INTEGER) AS marker_id, avg(mse) AS uw_model, coalesce(stddev_samp(mse), 0) / sqrt(count(mse)) AS sem_model, avg(mse_b) AS uw_baseline, coalesce(stddev_samp(mse_b), 0) / sqrt(count(mse_b)) AS sem_baseline,
avg(mse_b) - avg(mse) AS delta_base_minus_model FROM ({binned_sql("ppos", "y", "marker_id", BOTH)}) GROUP BY marker_id""",
        "marker_id|uw_model sem_model uw_baseline sem_baseline delta_base_minus_model",
    )
)
def uniform_residual_mse_by_marker(spark, d):
    rows = checkpointed(bins.marker_series(fx.event_predictions(spark, d).select("x", "y", "yhat", "b"), 30))
    e = checkpointed(bins.edges_of(rows, nbins=8, by=["marker_id"], fallback="range"))
    model = bins.uniform_weighted_mse(rows, e, ["marker_id"]).select("marker_id", F.col("uw_mse").alias("uw_model"), F.col("uw_sem").alias("sem_model"))
    base = bins.uniform_weighted_mse(rows, e, ["marker_id"], yhat="b").select("marker_id", F.col("uw_mse").alias("uw_baseline"), F.col("uw_sem").alias("sem_baseline"))
    return model.join(base, "marker_id").withColumn("delta_base_minus_model", F.col("uw_baseline") - F.col("uw_model"))


@query(
    f"""{ALL}, {RES}, h AS (SELECT marker_id, least(floor((r_model + 200) / 10.0), 39)::INTEGER AS bin FROM res WHERE r_model BETWEEN -200 AND 200), c AS (SELECT marker_id, bin, count(*) AS count FROM h GROUP BY ALL)
"""
    + out("SELECT CAST(marker_id AS INTEGER) AS marker_id, bin, (-200 + bin * 10)::DOUBLE AS edge_lo, (-200 + (bin + 1) * 10)::DOUBLE AS edge_hi, count, count / (sum(count) OVER (PARTITION BY marker_id) * 10.0) AS density FROM c", "marker_id bin count|edge_lo edge_hi density")
)
def residual_histogram(spark, d):
    return bins.histogram(_event_residuals(spark, d), "r_model", -200.0, 200.0, 40, ["marker_id"])


@query("SELECT round(q[1], 6) AS p01, round(q[2], 6) AS p99 FROM (SELECT quantile_cont(value, [0.01, 0.99]) AS q FROM events)")
def color_limits(spark, d):
    return exact_quantiles(fx.table(spark, d, "events"), "value", [0.01, 0.99]).select(F.get("q", F.lit(0)).alias("p01"), F.get("q", F.lit(1)).alias("p99"))


# --- graphs ----------------------------------------------------------------------------------------


def _graph(spark, d):
    nodes = fx.event_nodes(spark, d)
    return nodes, fx.event_edges(nodes)


@query(f"{EDGED} SELECT * FROM edges")
def normalised_edges(spark, d):
    return _graph(spark, d)[1]


@query(f"{EDGED}, two AS (SELECT a.graph_id, a.src, b.dst FROM edges a JOIN edges b ON a.graph_id = b.graph_id AND a.dst = b.src WHERE a.src <> b.dst) SELECT * FROM edges UNION SELECT * FROM two")
def two_hop_edges(spark, d):
    return graphs.add_two_hop_edges(_graph(spark, d)[1])


INTEGRITY = """, k AS (SELECT graph_id, least(src, dst) AS lo, greatest(src, dst) AS hi, count(*) AS c FROM edges GROUP BY ALL), rep AS (SELECT graph_id, src, dst, count(*) AS c FROM edges GROUP BY ALL)
SELECT g.graph_id, g.n_nodes AS num_nodes, coalesce(e.n, 0) AS num_edges, coalesce(e.oor, 0) AS out_of_range, coalesce(e.loops, 0) AS self_loops, coalesce(d.dup, 0)::BIGINT AS duplicate_directed, coalesce(r.rep, 0)::BIGINT AS repeated_edges,
  round(coalesce(s.sym, 0) / greatest(coalesce(e.n, 0), 1)::DOUBLE, 6) AS undirected_symmetry_ratio
FROM g LEFT JOIN (SELECT e.graph_id, count(*) AS n, count(*) FILTER (WHERE src < 0 OR dst < 0 OR src >= n_nodes OR dst >= n_nodes) AS oor, count(*) FILTER (WHERE src = dst) AS loops FROM edges e JOIN g USING (graph_id) GROUP BY e.graph_id) e USING (graph_id)
LEFT JOIN (SELECT graph_id, sum(c * (c - 1)) AS dup FROM k GROUP BY graph_id) d USING (graph_id) LEFT JOIN (SELECT graph_id, sum(c - 1) AS rep FROM rep GROUP BY graph_id) r USING (graph_id)
LEFT JOIN (SELECT a.graph_id, count(*) AS sym FROM edges a WHERE EXISTS (SELECT 1 FROM rep b WHERE b.graph_id = a.graph_id AND b.src = a.dst AND b.dst = a.src) GROUP BY a.graph_id) s USING (graph_id)"""


@query("WITH edges AS (SELECT l_linestatus AS graph_id, l_suppkey % 100 AS src, l_partkey % 100 AS dst FROM lineitem), g AS (SELECT DISTINCT graph_id, 95::BIGINT AS n_nodes FROM edges)" + INTEGRITY)
def edge_integrity_dirty(spark, d):
    return audit.edge_integrity(*fx.lineitem_multigraph(spark, d))


@query("WITH e AS (SELECT l_linestatus AS graph_id, l_suppkey % 100 AS u, l_partkey % 100 AS v FROM lineitem) SELECT * FROM (SELECT graph_id, u AS src, v AS dst FROM e UNION SELECT graph_id, v, u FROM e) WHERE src <> dst")
def normalised_edges_dirty(spark, d):
    return graphs.normalise_edges(fx.lineitem_multigraph(spark, d)[1], "src", "dst")


DEG = "deg AS (SELECT n.graph_id, n.node_id, count(e.dst) AS deg FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY n.graph_id, n.node_id)"


@query(f"{EDGED}, {DEG} SELECT graph_id, round(avg((deg = 0)::DOUBLE), 6) AS deg0_frac, round(avg(deg), 6) AS deg_mean, round(quantile_cont(deg, 0.5), 6) AS deg_p50, round(quantile_cont(deg, 0.9), 6) AS deg_p90, max(deg) AS deg_max FROM deg GROUP BY graph_id")
def degree_stats(spark, d):
    return audit.degree_stats(*_graph(spark, d))


ROOTS = "reach(graph_id, a, b) AS (SELECT graph_id, node_id, node_id FROM nodes UNION SELECT r.graph_id, r.a, e.dst FROM reach r JOIN edges e ON e.graph_id = r.graph_id AND e.src = r.b), roots AS (SELECT graph_id, a AS node_id, min(b) AS root FROM reach GROUP BY ALL)"


@query(f"{EDGED}, {ROOTS} SELECT graph_id, node_id, root, CAST(dense_rank() OVER (PARTITION BY graph_id ORDER BY root) - 1 AS INTEGER) AS component_id FROM roots")
def component_labels(spark, d):
    return audit.component_ids(audit.components(*_graph(spark, d)))


@query(f"{EDGED}, {ROOTS}, s AS (SELECT graph_id, root, count(*) AS n FROM roots GROUP BY ALL) SELECT graph_id, count(*) AS num_components, count(*) FILTER (WHERE n <= 5) AS num_small, max(n) AS largest FROM s GROUP BY graph_id")
def component_stats(spark, d):
    return audit.component_stats(audit.components(*_graph(spark, d)))


@query(f"""{EDGED}, ends AS (SELECT e.graph_id, e.dst, u.marker_id, u.v AS xu, w.v AS xv FROM edges e JOIN long u ON u.graph_id = e.graph_id AND u.node_id = e.src JOIN long w ON w.graph_id = e.graph_id AND w.node_id = e.dst AND w.marker_id = u.marker_id),
a AS (SELECT graph_id, marker_id, avg((xu = xv)::DOUBLE) AS edge_agreement FROM ends GROUP BY ALL), n1 AS (SELECT graph_id, dst, marker_id, avg(xu) AS near FROM ends GROUP BY ALL), n2 AS (SELECT graph_id, marker_id, avg(near) AS neighbor_positive_rate FROM n1 GROUP BY ALL)
SELECT g.graph_id, CAST(m.marker_id AS INTEGER) AS marker_id, round(edge_agreement, 6) AS edge_agreement, round(neighbor_positive_rate, 6) AS neighbor_positive_rate FROM (SELECT DISTINCT graph_id FROM nodes) g CROSS JOIN markers m LEFT JOIN a USING (graph_id, marker_id) LEFT JOIN n2 USING (graph_id, marker_id)""")
def homophily_by_marker(spark, d):
    return audit.homophily_by_marker(*_graph(spark, d))


@query(f"""{EDGED}, reach AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, node_id, node_id FROM nodes UNION SELECT a.graph_id, a.src, b.dst FROM edges a JOIN edges b ON a.graph_id = b.graph_id AND a.dst = b.src),
n AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY graph_id) SELECT graph_id, round(count(*) / (any_value(n)::DOUBLE * any_value(n)), 6) AS two_hop_frac FROM reach JOIN n USING (graph_id) GROUP BY graph_id""")
def two_hop_reach(spark, d):
    return audit.two_hop_reach(*_graph(spark, d))


@query(f"""{EDGED}, reach AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, node_id, node_id FROM nodes UNION SELECT a.graph_id, a.src, b.dst FROM edges a JOIN edges b ON a.graph_id = b.graph_id AND a.dst = b.src)
SELECT graph_id, src AS node_id, count(*) AS reached FROM reach GROUP BY ALL""")
def two_hop_sizes(spark, d):
    return reach.two_hop_sizes(*_graph(spark, d))


@query("""WITH e AS (SELECT DISTINCT l_returnflag AS graph_id, -l_linenumber::BIGINT AS src, l_partkey::BIGINT AS dst FROM lineitem),
b AS (SELECT * FROM e UNION SELECT graph_id, dst, src FROM e UNION SELECT graph_id, src, src FROM e UNION SELECT graph_id, dst, dst FROM e)
SELECT a.graph_id, a.src AS node_id, count(DISTINCT b.dst) AS reached FROM b a JOIN b ON b.graph_id = a.graph_id AND b.src = a.dst GROUP BY ALL""")
def two_hop_sizes_hubs(spark, d):
    """Parts around the line numbers that they are ordered under: seven hubs a graph, each next to most of its nodes."""
    return reach.two_hop_sizes(*fx.part_hubs(spark, d))


@query(f"""{EDGED}, z AS (SELECT graph_id, node_id, y - avg(y) OVER (PARTITION BY graph_id) AS z FROM nodes), o AS (SELECT graph_id, sum(z * z) AS zz, count(*) AS n FROM z GROUP BY graph_id),
c AS (SELECT e.graph_id, sum(u.z * w.z) AS zz2, count(*) AS w FROM edges e JOIN z u ON u.graph_id = e.graph_id AND u.node_id = e.src JOIN z w ON w.graph_id = e.graph_id AND w.node_id = e.dst GROUP BY e.graph_id)
SELECT graph_id, round(coalesce(zz2, 0) * n / ((zz + 1e-12) * greatest(coalesce(w, 0), 1)), 6) + 0.0 AS moran_i FROM o LEFT JOIN c USING (graph_id)""")
def moran_like_i(spark, d):
    return audit.moran_like_i(*_graph(spark, d))


@query(f"""{EDGED}, c AS (SELECT graph_id, node_id AS center FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5(node_id || ':0'), node_id) AS r FROM nodes) WHERE r <= 3),
h AS (SELECT graph_id, center, center AS node_id, 0 AS hop FROM c UNION ALL SELECT c.graph_id, c.center, e.dst, 1 FROM c JOIN edges e ON e.graph_id = c.graph_id AND e.src = c.center
  UNION ALL SELECT c.graph_id, c.center, f.dst, 2 FROM c JOIN edges e ON e.graph_id = c.graph_id AND e.src = c.center JOIN edges f ON f.graph_id = e.graph_id AND f.src = e.dst),
ego AS (SELECT graph_id, center, node_id, min(hop) AS hop, CAST(row_number() OVER (PARTITION BY graph_id, center ORDER BY node_id) - 1 AS INTEGER) AS local_id FROM h GROUP BY graph_id, center, node_id) SELECT * FROM ego""")
def ego_nodes(spark, d):
    return graphs.ego_nodes(*_graph(spark, d), 2, 3)


@query(ORACLE_SQL["ego_nodes"].rsplit("SELECT * FROM ego", 1)[0] + "SELECT e.graph_id, a.center, e.src, e.dst, a.local_id AS src_local, b.local_id AS dst_local FROM edges e JOIN ego a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN ego b ON b.graph_id = e.graph_id AND b.center = a.center AND b.node_id = e.dst")
def ego_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return graphs.ego_edges(checkpointed(graphs.ego_nodes(nodes, edges, 2, 3)), edges)


@query(f"""{EDGED}, i AS (SELECT e.graph_id, e.dst AS node_id, l.marker_id, avg(l.v) AS m, sum(l.v) AS s FROM edges e JOIN long l ON l.graph_id = e.graph_id AND l.node_id = e.src GROUP BY ALL)
SELECT graph_id, node_id, CAST(marker_id AS INTEGER) AS marker_id, round(coalesce(m, 0), 6) AS mean_in, round(coalesce(s, 0), 6) AS sum_in FROM long LEFT JOIN i USING (graph_id, node_id, marker_id)""")
def neighbor_aggregates(spark, d):
    nodes, edges = _graph(spark, d)
    both = neighbor_aggregate(nodes, edges, "x", 6, "mean", "mean_in").join(neighbor_aggregate(nodes, edges, "x", 6, "sum", "sum_in").select("graph_id", "node_id", "sum_in"), ["graph_id", "node_id"])
    return both.select("graph_id", "node_id", F.posexplode(F.arrays_zip("mean_in", "sum_in")).alias("marker_id", "v")).select("graph_id", "node_id", "marker_id", "v.mean_in", "v.sum_in")


def _nested(name: str, prefix: str = EDGED) -> str:
    """An earlier query's SQL as a subquery over the same nodes and edges."""
    return "WITH RECURSIVE " + ORACLE_SQL[name].removeprefix(prefix).lstrip(", ")


AUDIT = f"""{EDGED}, g AS (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY graph_id), i AS ({"WITH" + INTEGRITY.lstrip(",")}), dg AS ({_nested("degree_stats")}), cs AS ({_nested("component_stats")}),
hm AS (SELECT graph_id, avg(edge_agreement) AS edge_agreement_mean, avg(neighbor_positive_rate) AS neighbor_positive_mean FROM ({_nested("homophily_by_marker").replace("round(edge_agreement, 6)", "edge_agreement").replace("round(neighbor_positive_rate, 6)", "neighbor_positive_rate")}) GROUP BY graph_id),
th AS ({_nested("two_hop_reach")}), mo AS ({_nested("moran_like_i")}),
audited AS (SELECT graph_id, i.* EXCLUDE (graph_id), dg.* EXCLUDE (graph_id), cs.* EXCLUDE (graph_id), round(edge_agreement_mean, 6) AS edge_agreement_mean, round(neighbor_positive_mean, 6) AS neighbor_positive_mean,
  th.two_hop_frac, mo.moran_i, '5 names for 6 markers' AS marker_alignment_error FROM i JOIN dg USING (graph_id) JOIN cs USING (graph_id) JOIN hm USING (graph_id) JOIN th USING (graph_id) JOIN mo USING (graph_id))
"""


def _audited(spark, d, **options):
    """Audit rows with one column a figure."""
    nodes, edges = _graph(spark, d)
    rows = audit.audit_graphs(fx.event_graphs(nodes), nodes, checkpointed(edges), marker_names=fx.MARKER_NAMES[:5], **options)
    return rows.select("graph_id", *[f"{part}.*" for part in ("integrity", "degree", "components", "homophily", "reach", "moran")], "marker_alignment_error")


@query(AUDIT + "SELECT * FROM audited")
def audit_graphs(spark, d):
    return _audited(spark, d)


# --- losses ----------------------------------------------------------------------------------------


def _loss_sql(delta: float) -> str:
    e = "abs(yhat - y)"
    loss = f"0.5 * pow(least({e}, {delta}), 2) + {delta} * ({e} - least({e}, {delta}))" if delta else f"0.5 * pow({e}, 2)"
    return f"{ALL} " + out(f"SELECT graph_id, avg({loss}) AS huber, avg(pow({e}, 2)) AS mse, avg({e}) AS mae, count(*) AS n FROM pred GROUP BY graph_id", "graph_id n|huber mse mae")


@query(_loss_sql(1.0))
def error_stats_by_graph(spark, d):
    return losses.error_stats(fx.event_predictions(spark, d), ["graph_id"])


@query(_loss_sql(0.0))
def error_stats_half_squared(spark, d):
    return losses.error_stats(fx.event_predictions(spark, d), ["graph_id"], 0.0)


@query(f"{ALL}, bt AS (SELECT graph_id, avg(abs(yhat - y)) AS loss, count(*) AS n FROM pred GROUP BY graph_id) SELECT round(sum(loss * n) / greatest(sum(n), 1), 6) AS loss FROM bt")
def batch_weighted_loss(spark, d):
    stats = losses.error_stats(fx.event_predictions(spark, d), ["graph_id"])
    return losses.batch_weighted(stats, "mae", "n")


CALIB = """, r AS (SELECT graph_id, yhat - y AS r, y, avg(yhat - y) OVER w AS rm, avg(y) OVER w AS ym FROM pred WINDOW w AS (PARTITION BY graph_id)),
s AS (SELECT graph_id, count(*) AS n, sum((r - rm) * (y - ym)) AS c, sum(pow(r - rm, 2)) AS vr, sum(pow(y - ym, 2)) AS vy FROM r GROUP BY graph_id) """


@query(f"{ALL}{CALIB} " + out("SELECT graph_id, pow(c / sqrt(greatest(vr * vy, 1e-12)), 2) AS penalty, c / greatest(vy, 1e-12) AS residual_slope FROM s", "graph_id|penalty residual_slope"))
def calibration_corr(spark, d):
    return losses.calibration(fx.event_predictions(spark, d), ["graph_id"])


@query(f"{ALL}{CALIB} SELECT graph_id, round(pow(c / n, 2), 4) AS penalty, round(c / greatest(vy, 1e-12), 4) + 0.0 AS residual_slope FROM s")
def calibration_cov(spark, d):
    return rounded(losses.calibration(fx.event_predictions(spark, d), ["graph_id"], "cov"), 4)


@query(
    f"""{ALL}, cases AS (SELECT 'normal' AS kind, y, yhat FROM pred UNION ALL SELECT 'no_edges', y, b FROM pred)
"""
    + out('SELECT kind AS "case", avg(abs(yhat - y)) AS mae, avg(pow(yhat - y, 2)) AS mse FROM cases GROUP BY kind', '"case"|mae mse')
)
def ablation_of_edges(spark, d):
    nodes, edges = _graph(spark, d)
    base = markers.marker_baseline(nodes, fx.event_markers(spark))
    both = fx.one_hop_predictions(nodes, edges, base).select(F.lit("normal").alias("case"), "y", "yhat").unionByName(fx.one_hop_predictions(nodes, edges.where(F.lit(False)), base).select(F.lit("no_edges").alias("case"), "y", "yhat"))
    return losses.error_stats(both, ["case"]).select("case", "mae", "mse")


PERMUTED = """perm AS (SELECT a.graph_id, a.node_id, a.y, p.x FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS r FROM nodes) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5(node_id || ':0'), node_id) AS r FROM nodes) p ON p.graph_id = a.graph_id AND p.r = a.r),
pb AS (SELECT n.graph_id, n.node_id, any_value(n.y) AS y, CASE WHEN sum(n.x[i]) > 0 THEN sum(n.x[i] * coalesce(mu.mu_pos, overall.mu_global)) / sum(n.x[i]) ELSE any_value(overall.mu_none) END AS b
  FROM perm n, range(1, 7) r(i) JOIN mu ON mu.marker_id = i - 1, overall GROUP BY n.graph_id, n.node_id)"""


@query(
    f"""{ALL}, {PERMUTED}, cases AS (SELECT 'normal' AS kind, y, yhat FROM pred UNION ALL SELECT 'no_edges', y, b FROM pred
  UNION ALL SELECT 'shuffled_x', pb.y, coalesce(0.5 * pb.b + 0.5 * near.near, pb.b) FROM pb LEFT JOIN near USING (graph_id, node_id))
"""
    + out('SELECT kind AS "case", avg(abs(yhat - y)) AS mae, avg(pow(yhat - y, 2)) AS mse FROM cases GROUP BY kind', '"case"|mae mse')
)
def ablation(spark, d):
    nodes, edges = _graph(spark, d)
    return audit.ablation(fx.OneHop(fx.event_baseline(spark, d)), nodes, checkpointed(edges))


@query(
    f"""WITH {NODES}, a AS (SELECT graph_id, node_id, y, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS r FROM nodes), p AS (SELECT graph_id, x, row_number() OVER (PARTITION BY graph_id ORDER BY md5(node_id || ':0'), node_id) AS r FROM nodes)
SELECT graph_id, node_id, round(y, 6) AS y, CAST(list_sum(x) AS BIGINT) AS n_positive FROM a JOIN p USING (graph_id, r)"""
)
def permuted_features(spark, d):
    return audit.permuted_features(fx.event_nodes(spark, d)).select("graph_id", "node_id", "y", F.size(F.filter("x", lambda v: v > 0.5)).cast("long").alias("n_positive"))


@query(META + "SELECT matched, count(*) AS n FROM m GROUP BY matched")
def metadata_matches(spark, d):
    return _meta_graphs(spark, d).groupBy("matched").agg(F.count("*").alias("n"))


@query(f"{SMALL} SELECT graph_id, CAST(marker_id AS INTEGER) AS marker_id, round(avg(CAST(v > 0.5 AS DOUBLE)), 6) AS share FROM long GROUP BY ALL")
def graph_positive_share(spark, d):
    return audit.positive_share(fx.event_nodes(spark, d))


@query(f"{EDGED} SELECT DISTINCT a.graph_id, a.src, b.dst FROM edges a JOIN edges b ON a.graph_id = b.graph_id AND a.dst = b.src WHERE a.src <> b.dst")
def two_hop_pairs(spark, d):
    return graphs.two_hop_pairs(_graph(spark, d)[1])


@query(f"{SMALL} SELECT CAST(marker_id AS INTEGER) AS marker_id, name, n_pos FROM mu ORDER BY n_pos DESC, marker_id LIMIT 3")
def top_markers_by_count(spark, d):
    return prep.top_by(markers.positive_counts(fx.event_nodes(spark, d), fx.event_markers(spark)), "n_pos", 3)


@query(ORACLE_SQL["ego_nodes"].rsplit("SELECT * FROM ego", 1)[0] + "SELECT ego.*, round(n.y, 6) AS y, CAST(list_sum(n.x) AS BIGINT) AS n_positive FROM ego JOIN nodes n USING (graph_id, node_id)")
def ego_dataset(spark, d):
    nodes, edges = _graph(spark, d)
    return graphs.ego_dataset(nodes, edges, 2, 3)[0].select("graph_id", "center", "node_id", "hop", "local_id", "y", F.size(F.filter("x", lambda v: v > 0.5)).cast("long").alias("n_positive"))


# The reference's default: every node is a centre. The three ego queries above use its sampling option (3 centres a graph).


@query(ORACLE_SQL["ego_nodes"].replace(" WHERE r <= 3", ""))
def ego_nodes_all(spark, d):
    return graphs.ego_nodes(*_graph(spark, d), 2)


_EGOS = ORACLE_SQL["ego_nodes_all"].removesuffix("SELECT * FROM ego").replace("ego AS (", "ego AS MATERIALIZED (").replace("edges AS (", "edges AS MATERIALIZED (").replace("pairs AS (", "pairs AS MATERIALIZED (")


@query(f"""{_EGOS}, a AS MATERIALIZED (SELECT a.graph_id, a.center, a.local_id AS src_local, e.src, e.dst FROM ego a JOIN edges e ON e.graph_id = a.graph_id AND e.src = a.node_id)
SELECT a.graph_id, a.center, a.src, a.dst, a.src_local, b.local_id AS dst_local FROM a JOIN ego b ON b.graph_id = a.graph_id AND b.center = a.center AND b.node_id = a.dst""")
def ego_edges_all(spark, d):
    nodes, edges = _graph(spark, d)
    return graphs.ego_edges(checkpointed(graphs.ego_nodes(nodes, edges, 2)), edges)


@query(ORACLE_SQL["ego_dataset"].replace(" WHERE r <= 3", ""))
def ego_dataset_all(spark, d):
    nodes, edges = _graph(spark, d)
    return graphs.ego_dataset(nodes, edges, 2)[0].select("graph_id", "center", "node_id", "hop", "local_id", "y", F.size(F.filter("x", lambda v: v > 0.5)).cast("long").alias("n_positive"))


THREE_HOPS = ORACLE_SQL["ego_nodes_all"].replace("ego AS (SELECT", """h3 AS (SELECT * FROM h UNION ALL SELECT h.graph_id, h.center, e.dst, 3 FROM (SELECT DISTINCT graph_id, center, node_id FROM h) h JOIN edges e ON e.graph_id = h.graph_id AND e.src = h.node_id),
ego AS (SELECT""").replace("FROM h GROUP BY", "FROM h3 GROUP BY")


@query(THREE_HOPS)
def ego_nodes_three_hops(spark, d):
    return graphs.ego_nodes(*_graph(spark, d), 3)


@query(f"{SMALL} SELECT w.ordinal, w.name, CAST(m.marker_id AS INTEGER) AS marker_id FROM (VALUES (0, 'night'), (1, 'absent'), (2, 'click')) w(ordinal, name) LEFT JOIN markers m USING (name)")
def wanted_markers(spark, d):
    return markers.wanted_markers(fx.event_markers(spark), ["night", "absent", "click"])


@query(f"{ALL} SELECT count(*) AS n, round(avg(y), 6) AS y_mean, round(avg(yhat), 6) AS yhat_mean, count(DISTINCT graph_id) AS graphs FROM pred")
def pooled_predictions(spark, d):
    return fx.event_predictions(spark, d).agg(F.count("*").alias("n"), F.avg("y").alias("y_mean"), F.avg("yhat").alias("yhat_mean"), F.count_distinct("graph_id").alias("graphs"))


@query(f"WITH {NODES}, lo AS (SELECT graph_id, median(y) AS m FROM nodes GROUP BY graph_id), t AS (SELECT quantile_cont(m, 0.25) AS q FROM lo) SELECT graph_id, count(*) AS n_nodes FROM nodes WHERE graph_id IN (SELECT graph_id FROM lo, t WHERE m >= q) GROUP BY graph_id")
def filter_outliers_one_sided(spark, d):
    return fx.event_graphs(prep.filter_outliers(fx.event_nodes(spark, d), 25, None)[0])


@query(AUDIT + "SELECT * FROM audited ORDER BY md5(graph_id || ':0'), graph_id LIMIT 5")
def audit_sampled_graphs(spark, d):
    return _audited(spark, d, sample_k=5)


COPURCHASE = """WITH bought AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS graph_id, l_orderkey AS o, l_partkey AS node_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), nodes AS (SELECT DISTINCT graph_id, node_id FROM bought),
edges AS (SELECT DISTINCT a.graph_id, a.node_id AS src, b.node_id AS dst FROM bought a JOIN bought b ON a.graph_id = b.graph_id AND a.o = b.o AND a.node_id <> b.node_id)"""


@query(f"{COPURCHASE}, {DEG} SELECT graph_id, round(avg((deg = 0)::DOUBLE), 6) AS deg0_frac, round(avg(deg), 6) AS deg_mean, round(quantile_cont(deg, 0.5), 6) AS deg_p50, round(quantile_cont(deg, 0.9), 6) AS deg_p90, max(deg) AS deg_max FROM deg GROUP BY graph_id")
def copurchase_degree_stats(spark, d):
    return audit.degree_stats(*fx.copurchase_graph(spark, d))


@query(f"{COPURCHASE}, g AS (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY graph_id) SELECT graph_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM g LEFT JOIN (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY graph_id) USING (graph_id)")
def copurchase_sizes(spark, d):
    nodes, edges = fx.copurchase_graph(spark, d)
    return fx.event_graphs(nodes).join(edges.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id", "left").fillna(0, subset=["n_edges"])


@query(f"WITH {NODES} SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS node_id, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 6) AS y, CAST(list_sum(x) AS BIGINT) AS n_positive FROM nodes")
def npz_nodes(spark, d):
    """Graphs packed as NPZ bytes and decoded again; node ids become positions."""
    decoded = npz.decode_contents(npz.pack(packed_graphs(*_graph(spark, d))))
    nodes = npz.tables_of(decoded)[1]
    return nodes.select("graph_id", "node_id", F.col("y").cast("double").alias("y"), F.size(F.filter("x", lambda v: v > 0.5)).cast("long").alias("n_positive"))


@query(f"""{EDGED}, place AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS i FROM nodes)
SELECT p.graph_id, a.i AS u, b.i AS v FROM pairs p JOIN place a ON a.graph_id = p.graph_id AND a.node_id = p.u JOIN place b ON b.graph_id = p.graph_id AND b.node_id = p.v""")
def npz_edges(spark, d):
    return npz.tables_of(npz.decode_contents(npz.pack(packed_graphs(*_graph(spark, d)))))[2]


@query(f"WITH {NODES} SELECT CAST(graph_id AS INTEGER) % 3 AS series, count(*) AS n, round(min(y), 6) AS lowest, round(max(y), 6) AS highest, 13 AS n_edges, 0::BIGINT AS n_beyond FROM nodes GROUP BY 1")
def sketched_edges_error(spark, d):
    """Quantile edges of three series from sketches of two halves, added one after the other: how many are beyond the stated rank error."""
    nodes, path = fx.event_nodes(spark, d).withColumn("series", F.col("graph_id").cast("int") % 3), _folder(spark, "sketches")
    for half in (0, 1):
        merged = sketches.add_sketches(nodes.where(F.pmod("node_id", F.lit(2)) == half), path, by=["series"])
    edges = checkpointed(sketches.sketched_edges(merged, by=["series"]))
    each = edges.select("series", "n", F.size("edges").alias("n_edges"), F.posexplode("edges").alias("i", "edge"))
    below = nodes.select("series", "y").join(F.broadcast(each), "series").groupBy("series", "n", "n_edges", "i", "edge").agg(F.count_if(F.col("y") < F.col("edge")).alias("below"), F.count_if(F.col("y") <= F.col("edge")).alias("upto"))  # 39 edges
    error, rank = F.lit(sketches.rank_error()), F.col("i") / 12
    beyond = (F.col("below") / F.col("n") > rank + error) | (F.col("upto") / F.col("n") < rank - error)
    return below.groupBy("series", "n", "n_edges").agg(F.min("edge").alias("lowest"), F.max("edge").alias("highest"), F.count_if(beyond).alias("n_beyond"))


# --- files ----------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"{EDGED} SELECT graph_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY graph_id HAVING count(*) > 1) LEFT JOIN (SELECT graph_id, count(*) AS n_edges FROM pairs GROUP BY graph_id) USING (graph_id)")
def npz_folder(spark, d):
    """A folder of NPZ files, one a graph, beside a file that is none."""
    path = _folder(spark, "npz")
    packed = npz.pack(packed_graphs(*_graph(spark, d))).select(F.concat("graph_id", F.lit(".npz")).alias("name"), "content")
    write_files(packed.unionByName(spark.sql("SELECT 'broken.npz' AS name, binary('no archive') AS content")), path)
    found = npz.read_npz(spark, path)
    sizes, _, edges, skipped = npz.tables_of(found)
    assert skipped.count() == 1
    return sizes.select("graph_id", "n_nodes").join(edges.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id", "left").fillna(0, subset=["n_edges"])


def _npz_source(spark, d, table):
    """A folder of one NPZ file a graph, read by the data source, files beyond 8 KB in chunks."""
    path = _folder(spark, "npz")
    write_files(npz.pack(packed_graphs(*_graph(spark, d))).select(F.concat("graph_id", F.lit(".npz")).alias("name"), "content"), path)
    npz_source.register(spark)
    return spark.read.format("npz").option("path", path).option("table", table).option("partBytes", 8 << 10).load()


@query(ORACLE_SQL["npz_nodes"] + " WHERE graph_id IN (SELECT graph_id FROM nodes GROUP BY graph_id HAVING count(*) > 1)")
def npz_source_nodes(spark, d):
    return _npz_source(spark, d, "nodes").select("graph_id", "node_id", "y", F.size(F.filter("x", lambda v: v > 0.5)).cast("long").alias("n_positive"))


@query(ORACLE_SQL["npz_edges"])
def npz_source_edges(spark, d):
    return _npz_source(spark, d, "edges")


@query(f"WITH {NODES}, g AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY graph_id) SELECT 'organoid_' || graph_id AS graph_id, CASE WHEN n % 2 = 0 THEN 'u' || graph_id ELSE graph_id END AS organoid_id, round(n / 50.0::DOUBLE - 2.3, 6) + 0.0 AS complexity, n * 2.0::DOUBLE AS total_volume, 2::BIGINT AS n_keys FROM g")
def sidecar_metadata(spark, d):
    """Metadata files, one a graph: numbers, lists of one number, and text that isn't kept."""
    path, g, n = _folder(spark, "meta"), fx.event_graphs(fx.event_nodes(spark, d)), F.col("n_nodes")
    raw = F.to_json(F.struct((n / 50 - 2.3).alias("complexity"), F.array(n * 2).alias("total_volume"), F.lit("text").alias("note"), F.when(n % 2 == 0, F.concat(F.lit("u"), "graph_id")).alias("organoid_id")))
    write_files(g.select(F.concat(F.lit("organoid_"), "graph_id", F.lit("_aux.json")).alias("name"), raw.alias("content")), path)
    get = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    return sidecars.read_metadata(spark, path).select("graph_id", "organoid_id", get("complexity"), get("total_volume"), F.size("meta").cast("long").alias("n_keys"))


@query("SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS marker_id, event_type AS name FROM (SELECT DISTINCT event_type FROM events)")
def sidecar_marker_names(spark, d):
    """The first of two files of marker names: the types of the events, and another list."""
    path, events = _folder(spark, "names"), fx.table(spark, d, "events")
    names = events.agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("content"))
    write_files(names.select(F.lit("a_markers.json").alias("name"), "content").unionByName(spark.sql("SELECT 'b_markers.json' AS name, '[\"other\"]' AS content")), path)
    return sidecars.read_marker_names(spark, path)


@query(f"""WITH {NODES}, g AS (SELECT CAST(user_id AS VARCHAR) AS graph_id, count(*) AS n, arg_min(props, event_id) AS props FROM events GROUP BY ALL)
SELECT 'organoid_' || graph_id AS graph_id, CASE WHEN n % 2 = 0 THEN 'u' || graph_id ELSE graph_id END AS organoid_id, round(n / 50.0::DOUBLE - 2.3, 6) + 0.0 AS complexity, n * 2.0::DOUBLE AS total_volume,
  'from ' || graph_id AS note, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM g""")
def metadata_values(spark, d):
    """Metadata files kept whole: numbers, lists of one number, text, and the nested properties of each user's first event."""
    path, events, n = _folder(spark, "meta"), fx.table(spark, d, "events"), F.col("n")
    g = events.groupBy(F.col("user_id").cast("string").alias("graph_id")).agg(F.count("*").alias("n"), F.min_by("props", "event_id").alias("props"))
    raw = F.to_json(F.struct((n / 50 - 2.3).alias("complexity"), F.array(n * 2).alias("total_volume"), F.concat(F.lit("from "), "graph_id").alias("note"), F.from_json("props", "map<string,bigint>").alias("props"), F.when(n % 2 == 0, F.concat(F.lit("u"), "graph_id")).alias("organoid_id")))
    write_files(g.select(F.concat(F.lit("organoid_"), "graph_id", F.lit("_aux.json")).alias("name"), raw.alias("content")), path)
    values = sidecars.promoted(sidecars.read_metadata_values(spark, path), complexity="double", total_volume="double", note="string", k="bigint $.props.k")
    return values.drop("meta")


_MODES = "modes AS (SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS i, m FROM (SELECT DISTINCT event_type AS m FROM events))"


@query(f"WITH {_MODES} SELECT a.m AS name_i, b.m AS name_j, a.i, b.i AS j FROM modes a JOIN modes b ON a.i < b.i ORDER BY 3, 4 LIMIT 5")
def marker_pairs_of_types(spark, d):
    """The first pairs of the event types, taken as markers."""
    types = [r[0] for r in fx.table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    return prep.marker_pairs(markers.marker_dimension(spark, types), 5)


@query(f"""WITH {_MODES}, w(policy, width) AS (VALUES ('pad', 6), ('fit', 2), ('replace', 7), ('strict', (SELECT count(*) FROM modes))), r AS (SELECT policy, width, unnest(range(width::BIGINT)) AS k FROM w)
SELECT policy, CAST(k AS INTEGER) AS marker_id, CASE WHEN policy = 'replace' THEN 'm' || k ELSE coalesce(m, 'm' || k) END AS name FROM r LEFT JOIN modes ON i = k""")
def marker_name_policies_of_types(spark, d):
    """The event types as names of more markers (pad), fewer (fit), another number (replace) and as many (strict)."""
    types = [r[0] for r in fx.table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    rows = [markers.marker_dimension(spark, types, width, policy).select(F.lit(policy).alias("policy"), "marker_id", "name") for policy, width in (("pad", 6), ("fit", 2), ("replace", 7), ("strict", len(types)))]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS epoch, n_nationkey::DOUBLE AS train_loss, n_nationkey / 4.0::DOUBLE AS train_mae, n_regionkey::DOUBLE AS val_loss, n_regionkey / 8.0::DOUBLE AS val_mae FROM nation")
def history_file(spark, d):
    """Training curves from a JSON object of four arrays, through the Parquet history and back."""
    path, of = _folder(spark, "history"), lambda c, by: F.transform("r", lambda e: e[c] / by)
    one = fx.table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))).alias("r"))
    curves = {"train_loss": of("n_nationkey", 1), "train_mae": of("n_nationkey", 4), "val_loss": of("n_regionkey", 1), "val_mae": of("n_regionkey", 8)}
    write_files(one.select(F.lit("history.json").alias("name"), F.to_json(F.struct(*[v.alias(k) for k, v in curves.items()])).alias("content")), path)
    sidecars.write_history(sidecars.read_history(spark, f"{path}/history.json"), f"{path}-rows")
    return spark.read.parquet(f"{path}-rows")


@query(f"WITH {NODES}, n AS (SELECT count(DISTINCT graph_id) AS n FROM nodes) SELECT i AS batch, least(8, n - 8 * i) AS n_graphs FROM n, range(0, (n + 7) // 8) r(i)")
def minibatch_sizes(spark, d):
    """Graphs dealt into minibatches of eight by a keyed permutation."""
    ranked = prep.hash_rank(fx.event_graphs(fx.event_nodes(spark, d)), "graph_id", 1)
    n = ranked.count()
    dealt = ranked.select(minibatch_of_size(F.col("rank") - 1, n, 8, 3).cast("long").alias("batch"))
    return dealt.groupBy("batch").agg(F.count("*").alias("n_graphs"))


# --- models (scores by SQL with the weights in it; tests hold gradients against finite differences) --

RING = """WITH n0 AS (SELECT CAST(label AS VARCHAR) AS graph_id, vec_id AS node_id, list_transform(embedding, lambda v: CAST(v > 0 AS DOUBLE)) AS h FROM embeddings),
u AS (SELECT graph_id, node_id AS src, lead(node_id) OVER (PARTITION BY graph_id ORDER BY node_id) AS dst FROM n0), edges AS (SELECT * FROM u WHERE dst IS NOT NULL UNION SELECT graph_id, dst, src FROM u WHERE dst IS NOT NULL)"""


def _numbers(w) -> str:
    return f"[{', '.join(map(repr, w.tolist()))}]::DOUBLE[]"


def _dot(terms: dict, bias: float) -> str:
    """Scalar products of SQL lists with weights, and a bias."""
    return " + ".join([*(f"list_dot_product({column}, {_numbers(w)})" for column, w in terms.items()), repr(float(bias))])


def _near_sql(k: int, width: int, how: str) -> str:
    """CTE m{k}: each node of n{k} with the mean or sum of its in-neighbours' h (zeros without any)."""
    return f"""a{k} AS (SELECT e.graph_id, e.dst AS node_id, i, {how}(n.h[i]) AS v FROM edges e JOIN n{k} n ON n.graph_id = e.graph_id AND n.node_id = e.src, range(1, {width + 1}) r(i) GROUP BY ALL),
m{k} AS (SELECT n.graph_id, n.node_id, n.h, coalesce(s.near, list_transform(range({width}), lambda i: 0.0::DOUBLE)) AS near FROM n{k} n LEFT JOIN (SELECT graph_id, node_id, list(v ORDER BY i) AS near FROM a{k} GROUP BY ALL) s ON s.graph_id = n.graph_id AND s.node_id = n.node_id)"""


def _head_sql(w: dict) -> str:
    return _dot({"h": w["head"][:, 0]}, w["head.bias"][0])


def _scored_sql(k: int, w: dict) -> str:
    return f" SELECT graph_id, node_id, round({_head_sql(w)}, 6) + 0.0 AS yhat FROM n{k}"


def _sage_layers(model, source: str) -> str:
    """CTEs up to n{layers}, the last layer's outputs h; ``source`` ends with n0 and edges."""
    w, sql, width = model.weights, source, model.n_markers
    for k in range(model.layers):
        each = range(model.hidden)
        z = ", ".join(_dot({"near": w[f"l{k}.near"][:, j], "h": w[f"l{k}.own"][:, j]}, w[f"l{k}.bias"][j]) for j in each)
        kept = [_dot({"h": w["project"][:, j]}, 0.0) if k == 0 and "project" in w else f"h[{j + 1}]" for j in each]
        out_of = ", ".join(f"greatest((z[{j + 1}] - list_avg(z)) / sqrt(list_var_pop(z) + 1e-5) * {w[f'l{k}.gain'][j]!r} + {w[f'l{k}.shift'][j]!r}, 0) + {kept[j]}".replace("np.float64", "") for j in each)
        sql += f", {_near_sql(k, width, 'avg')}, z{k} AS (SELECT *, [{z}] AS z FROM m{k}), n{k + 1} AS (SELECT graph_id, node_id, [{out_of}] AS h FROM z{k})"
        width = model.hidden
    return sql


def _sage_sql(model) -> str:
    return _sage_layers(model, RING) + _scored_sql(model.layers, model.weights)


def _gin_sql(model) -> str:
    w, sql, width = model.weights, RING, model.n_markers
    for k in range(model.layers):
        inner = ", ".join(f"greatest({_dot({'s': w[f'l{k}.a'][:, j]}, w[f'l{k}.a.bias'][j])}, 0)" for j in range(model.hidden))
        outer = ", ".join(f"greatest({_dot({'z': w[f'l{k}.b'][:, j]}, w[f'l{k}.b.bias'][j])}, 0)" for j in range(model.hidden))
        sql += f", {_near_sql(k, width, 'sum')}, s{k} AS (SELECT graph_id, node_id, list_transform(range(1, {width + 1}), lambda i: {1 + model.eps!r} * h[i] + near[i]) AS s FROM m{k}), z{k} AS (SELECT *, [{inner}] AS z FROM s{k}), n{k + 1} AS (SELECT graph_id, node_id, [{outer}] AS h FROM z{k})"
        width = model.hidden
    return sql + _scored_sql(model.layers, w)


SAGE, GIN = Sage(64, 16, 2).init(1), Gin(64, 16, 2).init(1)


@query(_sage_sql(SAGE))
def sage_scores(spark, d):
    """A seeded two-layer SAGE over wide features; a path through the ids of each label replaces a neighbour search."""
    return SAGE.transform(*_ring(spark, d)).select("graph_id", "node_id", "yhat")


@query(_gin_sql(GIN))
def gin_scores(spark, d):
    return GIN.transform(*_ring(spark, d)).select("graph_id", "node_id", "yhat")


def _ring(spark, d):
    """Nodes of the embeddings table, each joined to the next of its label in the order of ids."""
    nodes = fx.embedding_nodes(spark, d)
    ranked = checkpointed(row_ranks(nodes.select("graph_id", "node_id"), "graph_id", F.col("node_id"), ["node_id"]))
    after = ranked.select("graph_id", F.col("node_id").alias("v"), (F.col("rank") - 1).alias("rank"))
    return nodes, graphs.normalise_edges(ranked.join(after, ["graph_id", "rank"]).select("graph_id", F.col("node_id").alias("u"), "v"))


def _event_sets(spark, d):
    nodes, edges = _graph(spark, d)
    split = checkpointed(prep.split_graphs(nodes.select("graph_id")))
    scaled = prep.standardize(nodes, prep.target_scaling(nodes.join(split.where("split = 'train'"), "graph_id", "left_semi")))
    # Every layer and epoch reads them.
    part = lambda name: tuple(checkpointed(t.join(split.where(F.col("split") == name), "graph_id", "left_semi")) for t in (scaled, edges))
    return part("train"), part("val")


_FIRST, _AT_FIRST = Sage(6, 8, 2).init(0), TrainConfig()
_E = "abs(p.yhat - n.y)"


@query(f"""{_sage_layers(_FIRST, f"{EDGED}, n0 AS (SELECT graph_id, node_id, x AS h FROM nodes)")}, p AS (SELECT graph_id, node_id, {_head_sql(_FIRST.weights)} AS yhat FROM n2)
SELECT round(avg(0.5 * pow(least({_E}, 1), 2) + ({_E} - least({_E}, 1))), 6) AS loss, round(avg({_E}), 6) AS mae, count(*) AS n FROM p JOIN nodes n USING (graph_id, node_id)""")
def training_loss(spark, d):
    """Huber loss and error of a seeded model before its first step, by joins."""
    loss, mae, n = joined_sums(_FIRST, Joined.of(*_graph(spark, d), learn=False), _AT_FIRST, False, 0)[:3]
    return spark.createDataFrame([(float(loss), float(mae), n)], "loss double, mae double, n bigint")


@query()
def training_history(spark, d):
    """Loss and error of three full-batch epochs on standardised targets (layer norm), each a barrier job."""
    _, _, history = train(Sage(6, 8, 2).init(0), *_event_sets(spark, d), TrainConfig(epochs=3), by="barrier")
    return _history(spark, history)


@query()
def training_history_minibatches(spark, d):
    """Two epochs of minibatches of 32 graphs exactly, each a barrier job; stopped after the first and gone on with from the folder."""
    sets, cfg, path = _event_sets(spark, d), TrainConfig(epochs=2, batch_size=32), _folder(spark, "state")
    train(Sage(6, 8, 2).init(0), *sets, replace(cfg, epochs=1), by="barrier", state_path=path)
    _, _, history = train(Sage(6, 8, 2).init(0), *sets, cfg, by="barrier", state_path=path)
    return _history(spark, history)


@query()
def training_history_joins(spark, d):
    """One full-batch epoch, by joins in place of packed graphs."""
    _, _, history = train(Sage(6, 8, 2).init(0), *_event_sets(spark, d), TrainConfig(epochs=1), by="joins")
    return _history(spark, history)


@query()
def training_history_batch_norm(spark, d):
    _, _, history = train(Sage(6, 8, 2, norm="batch").init(0), *_event_sets(spark, d), TrainConfig(epochs=2, dropout=0.2, calibration_weight=0.1))
    return _history(spark, history)


@query()
def training_history_gin(spark, d):
    _, _, history = train(Gin(6, 8, 2).init(0), *_event_sets(spark, d), TrainConfig(epochs=2, dropout=0.2))
    return _history(spark, history)


@query()
def lbfgs_history(spark, d):
    """Quasi-Newton steps on the training graphs, by joins."""
    _, history = lbfgs(Sage(6, 8, 1, norm=None).init(0), _event_sets(spark, d)[0], steps=2, inner=2, by="joins")
    return spark.createDataFrame([(h["epoch"], float(h["train_loss"]), float(h["train_mae"])) for h in history], "epoch int, train_loss double, train_mae double")


def _history(spark, history):
    return spark.createDataFrame([tuple(float(v) if k != "epoch" else v for k, v in h.items()) for h in history], schema.HISTORY)


#: The reference's runs (``compare_loss_function``).
DEPTH_RUNS = TrainConfig(epochs=100, batch_size=8, lr=1e-3, patience=30, huber_delta=0.0, dropout=0.1)


@query()
def depth_comparison(spark, d):
    """Relative errors of the baseline and of models fitted to the raw and the residual target: width 128, dropout, up to 100 epochs of minibatches of 8 graphs."""
    return depth_scan([2, 3, 4, 5], *_event_sets(spark, d), fx.event_markers(spark), 128, DEPTH_RUNS, by="relay")


@query()
def epoch_budgets(spark, d):
    """Errors of one model per budget of quasi-Newton iterations on one training graph (the first by its id)."""
    nodes, edges = _event_sets(spark, d)[0]
    one = nodes.agg(F.min("graph_id")).first()[0]
    rows = epoch_sweep([2, 8], (nodes.where(F.col("graph_id") == one), edges.where(F.col("graph_id") == one)), 6, 8, 2, steps=2)
    return spark.createDataFrame([(r["epochs"], float(r["mse"]), float(r["mae"])) for r in rows], "epochs int, mse double, mae double")
