"""Ways to train that must agree, runs that are gone on with, and minibatches of exact size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.models import training
from nodeloom.models.message_passing import Gin, Sage
from nodeloom.models.training import AdamW, Joined, TrainConfig, barrier_epoch, epoch_sweep, joined_sums, lbfgs, load_state, packed_graphs, step_sums, train
from nodeloom.operators.graphs import normalise_edges
from nodeloom.operators.markers import marker_dimension
from nodeloom.plans import queries
from nodeloom.sources.builders import minibatch_of_size, permuted, with_minibatch
from nodeloom.storage import checkpointed


@pytest.fixture(scope="module")
def graphs(spark):
    """Five small graphs with random markers."""
    rng = np.random.default_rng(3)
    nodes, edges = [], []
    for g in range(5):
        n = int(rng.integers(3, 7))
        for i in range(n):
            x = (rng.random(3) > 0.5).astype(float)
            nodes.append((f"g{g}", i, x.tolist(), float(x @ [1, -2, 0.5] + g / 10)))
        edges += [(f"g{g}", i, i + 1) for i in range(n - 1)]
    n = spark.createDataFrame(nodes, "graph_id string, node_id bigint, x array<float>, y double")
    return checkpointed(n), checkpointed(normalise_edges(spark.createDataFrame(edges, "graph_id string, u bigint, v bigint")))




@pytest.mark.parametrize("model", [Sage(3, 4, 1, norm="batch"), Gin(3, 4, 1)], ids=["batch norm", "gin"])
def test_barrier_jobs_take_the_same_steps(graphs, model):
    histories, cfg = [], TrainConfig(epochs=1, batches=2, lr=0.05, calibration_weight=0.1)
    for by in ("graph", "barrier"):
        trained, told, history = train(model.init(0), graphs, graphs, cfg, by=by, tasks=3)
        histories.append((told, history, {k: v.copy() for k, v in trained.weights.items()}))
    (told_a, a, w), (told_b, b, v) = histories
    assert told_a == pytest.approx(told_b) and all(x[k] == pytest.approx(y[k]) for x, y in zip(a, b, strict=True) for k in x)
    for k in w:
        np.testing.assert_allclose(w[k], v[k], atol=1e-9)


def test_an_epoch_is_one_barrier_job(spark, graphs):
    packed, counted = checkpointed(packed_graphs(*graphs)), []
    for batches in (1, 3):
        model, cfg = Sage(3, 4, 1, norm="batch").init(0), TrainConfig(batches=batches)
        dealt = checkpointed(with_minibatch(packed, batches))
        spark.sparkContext.setJobGroup(f"epoch of {batches}", "")
        barrier_epoch(model, AdamW(cfg), dealt, cfg, 0, batches, tasks=2)
        counted.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"epoch of {batches}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counted[0] == counted[1] <= 2  # dealing the graphs out, and the epoch


@pytest.mark.parametrize("by", ["graph", "barrier", "joins"])
def test_a_run_that_is_gone_on_with(spark, graphs, tmp_path, by):
    cfg = TrainConfig(epochs=2, lr=0.05, batch_size=2 if by != "joins" else None, patience=2)
    _, told, whole = train(Sage(3, 4, 1).init(0), graphs, graphs, cfg, by=by, tasks=2)
    path = f"file://{tmp_path}/state"
    assert load_state(spark, path) is None
    train(Sage(3, 4, 1).init(0), graphs, graphs, TrainConfig(**{**cfg.__dict__, "epochs": 1}), by=by, state_path=path, tasks=2)
    state = load_state(spark, path)
    assert len(state.history) == 1 and state.steps == (3 if cfg.batch_size else 1)
    model, again, history = train(Sage(3, 4, 1).init(9), graphs, graphs, cfg, by=by, state_path=path, tasks=2)
    exact = (lambda v: v) if by == "barrier" else pytest.approx
    assert again == pytest.approx(told) and len(history) == len(whole) and all(a[k] == exact(b[k]) for a, b in zip(history, whole) for k in a)
    assert train(Sage(3, 4, 1).init(9), graphs, graphs, cfg, by=by, state_path=path)[2] == history  # nothing left to do


def test_patience_goes_on_too(graphs, tmp_path):
    path = f"file://{tmp_path}/state"
    cfg = TrainConfig(epochs=1, lr=0.0, weight_decay=0.0, patience=1)
    train(Sage(3, 4, 1).init(0), graphs, graphs, cfg, state_path=path)
    history = train(Sage(3, 4, 1).init(0), graphs, graphs, TrainConfig(epochs=9, lr=0.0, weight_decay=0.0, patience=1), state_path=path)[2]
    assert len(history) == 2  # the second doesn't improve


def test_squared_loss_and_lbfgs(graphs):
    """The history is the mean squared error; both ways take the same steps."""
    start = Sage(3, 4, 1, norm=None).init(0)
    e = F.col("yhat") - F.col("y")
    mse = start.transform(*graphs).agg(F.avg(e * e)).first()[0]
    a = lbfgs(Sage(3, 4, 1, norm=None).init(0), graphs, steps=2, inner=2)
    b = lbfgs(Sage(3, 4, 1, norm=None).init(0), graphs, steps=2, inner=2, by="joins")
    assert a[1][0]["train_loss"] == pytest.approx(mse) and all(x[k] == pytest.approx(y[k], rel=1e-6) for x, y in zip(a[1], b[1], strict=True) for k in x)
    fitted, mae = a[0].transform(*graphs).agg(F.avg(e * e), F.avg(F.abs(e))).first()
    assert any(h["train_loss"] == pytest.approx(fitted) and h["train_mae"] == pytest.approx(mae) for h in a[1])
    packed, eps = checkpointed(packed_graphs(*graphs)), 1e-6
    model, cfg = Sage(3, 4, 1).init(1), TrainConfig(loss="mse")
    loss, _, _, g, _ = step_sums(model, packed, cfg, True, 0)
    model.weights["head"][2, 0] += eps
    assert (step_sums(model, packed, cfg, False, 0)[0] - loss) / eps == pytest.approx(g["head"][2, 0], rel=1e-3)


def test_budgets_by_lbfgs_on_one_graph(graphs):
    one = tuple(t.where("graph_id = 'g1'") for t in graphs)
    rows = epoch_sweep([1, 15], one, 3, 6, 1, steps=3)
    assert [r["epochs"] for r in rows] == [1, 15] and rows[1]["mse"] < 0.2 * rows[0]["mse"]
    with pytest.raises(ValueError):
        epoch_sweep([1], one, 3, 6, 1, optimizer="none")


def test_one_graph_without_validation(graphs):
    """The kept state is the one after the epoch of least training error; nothing is clipped."""
    one = tuple(t.where("graph_id = 'g1'") for t in graphs)
    cfg = TrainConfig(epochs=3, lr=0.3, loss="mse", clip_norm=None, weight_decay=0.0)
    _, told, history = train(Sage(3, 4, 1).init(0), one, None, cfg)
    assert told["val_mae"] == min(h["train_mae"] for h in history) and all(h["val_mae"] is None for h in history)


def test_dropout_by_joins(graphs):
    """The same masks forward and back: slopes are those of differences."""
    nodes, edges = graphs
    data, cfg, eps = Joined.of(nodes, edges), TrainConfig(dropout=0.4, seed=5), 1e-5
    model = Sage(3, 4, 2).init(1)
    loss, _, _, g, _ = joined_sums(model, data, cfg, True, 3)
    for k, at in (("l0.own", (1, 2)), ("l1.near", (0, 3))):
        model.weights[k][at] += eps
        assert (joined_sums(model, data, cfg, True, 3)[0] - loss) / eps == pytest.approx(g[k][at], rel=1e-2, abs=1e-6)
        model.weights[k][at] -= eps
    assert joined_sums(model, data, cfg, True, 4)[0] != pytest.approx(loss)  # another epoch, other masks


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutations(spark, n):
    ids = spark.range(n)
    got = [[r[0] for r in ids.select(permuted(F.col("id"), n, 7, epoch)).collect()] for epoch in (0, 1)]
    assert all(sorted(p) == list(range(n)) for p in got)
    if n > 60:
        moved = np.array(got[0])
        assert got[0] != got[1] and abs(np.corrcoef(np.arange(n), moved)[0, 1]) < 0.5 and (moved == np.arange(n)).mean() < 0.1


def test_minibatches_of_exact_size(spark):
    dealt = spark.range(103).withColumn("batch", minibatch_of_size(F.col("id"), 103, 4, 2, 1))
    sizes = {r["batch"]: r["count"] for r in dealt.groupBy("batch").count().collect()}
    assert sizes == {b: 4 if b < 25 else 3 for b in range(26)}
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_odd_training_sets(graphs):
    with pytest.raises(ValueError):
        train(Sage(3, 4, 1).init(0), tuple(t.where("false") for t in graphs), graphs)
    with pytest.raises(ValueError):
        train(Sage(3, 4, 1).init(0), graphs, graphs, by="magic")


@pytest.mark.parametrize("model", [Sage(3, 4, 1, norm="batch"), Gin(3, 4, 1)], ids=["batch norm", "gin"])
def test_a_relay_takes_the_same_steps(graphs, model):
    """each task takes the steps of whole minibatches, with a hand-over a task in place of one a minibatch."""
    packed, cfg, found = checkpointed(packed_graphs(*graphs)), TrainConfig(batches=5, lr=0.05, calibration_weight=0.1), []
    for relay in (False, True):
        trained = model.init(0)
        sums = barrier_epoch(trained, AdamW(cfg), checkpointed(with_minibatch(packed, 5)), cfg, 0, 5, tasks=2, relay=relay)
        found.append((sums, {k: v.copy() for k, v in trained.weights.items()}))
    np.testing.assert_allclose(found[0][0], found[1][0])
    for k, w in found[0][1].items():
        np.testing.assert_allclose(w, found[1][1][k], atol=1e-9)


def test_packed_graphs_pass_in_pieces(graphs, monkeypatch):
    """a piece has few nodes and edges however many graphs an Arrow batch has, and may be read again."""
    rows = with_minibatch(packed_graphs(*graphs), 2).orderBy("batch", "graph_id").toArrow().combine_chunks().to_batches()
    found = list(training.pieces(rows, 20))
    assert sum(p.rows.num_rows for p in found) == 5 and all(len(p.union[0]) + len(p.union[2]) <= 20 or p.rows.num_rows == 1 for p in found) and len(found) >= 3
    monkeypatch.setattr(training, "SPOOL", 10)  # beyond it, a file
    stream, ahead, sizes = training.pieces(rows, 20), [], []
    for b in (0, 1):
        part = training.Minibatch(stream, ahead, b, True)
        once, twice = (part.summed(lambda p: np.array([len(p.union[0]), p.union[1].sum()]), 2) for _ in range(2))
        np.testing.assert_array_equal(once, twice)
        sizes.append(once[0])
        part.close()
    assert sum(sizes) == graphs[0].count() and ahead == []


def test_depths_share_what_they_read(graphs, monkeypatch):
    """F1: each set is packed once for all models, and scores need no layout of the edges; both ways give the same figures."""
    dim, calls, packing, cfg = marker_dimension(graphs[0].sparkSession, ["a", "b", "c"]), [], training.packed_graphs, TrainConfig(epochs=1)
    monkeypatch.setattr(training, "packed_graphs", lambda *a: calls.append(1) or packing(*a))
    monkeypatch.setattr(training.Wiring, "of", None)
    found = training.depth_scan([1, 2], graphs, graphs, dim, 4, cfg, min_pos=1).collect()
    assert len(calls) == 2 and len(found) == 2 * 3 * (1 + 2 * 2)
    monkeypatch.undo()
    joined = training.depth_scan([2], graphs, graphs, dim, 4, cfg, min_pos=1, by="joins").collect()
    figures = {(r.kind, r.split, r.depth, r.marker_id): r.rel_mean for r in found}
    assert all(figures[r.kind, r.split, r.depth, r.marker_id] == pytest.approx(r.rel_mean, abs=1e-6) for r in joined)


@pytest.mark.parametrize("norm", ["layer", "batch"])
def test_models_side_by_side_take_the_steps_of_train(graphs, monkeypatch, norm):
    """each goes from turn to turn over the same minibatches, stops on its own and keeps its best weights."""
    monkeypatch.setattr(training, "TURN", 1)
    packed = checkpointed(packed_graphs(*graphs))
    both = checkpointed(packed.withColumn("y", F.transform("y", lambda y: F.array(y[0], 1 - 2 * y[0]))))
    cfg = TrainConfig(epochs=6, batch_size=2, lr=0.3, patience=1, calibration_weight=0.1)
    models = [Sage(3, 4, depth, norm=norm).init(depth) for depth in (1, 2)]
    histories = training.train_together(models, [0, 1], both, both, cfg)
    for i, model in enumerate(models):
        of_one = packed if i == 0 else packed.withColumn("y", F.transform("y", lambda y: F.array(1 - 2 * y[0])))
        alone, metrics, history = train(Sage(3, 4, i + 1, norm=norm).init(i + 1), of_one, of_one, cfg)
        assert len(history) == len(histories[i])
        for a, b in zip(history, histories[i], strict=True):
            assert a == pytest.approx(b, abs=1e-9)
        for k, w in alone.weights.items():
            # Biases before batch norm have no slope but rounding, which AdamW scales up.
            np.testing.assert_allclose(model.weights[k], w, atol=1e-6)


def test_the_registered_depth_scan_trains_in_full(graphs, monkeypatch):
    """the reference's width, epochs, patience and minibatches; one step of narrow models before."""
    asked = []
    monkeypatch.setattr(queries, "_event_sets", lambda spark, d: ("train", "val"))
    monkeypatch.setattr(queries, "depth_scan", lambda depths, learn, val, dim, hidden, cfg, by: asked.append((depths, learn, val, hidden, cfg, by)) or graphs[0])
    queries.QUERIES["depth_comparison"](graphs[0].sparkSession, "")
    ((depths, learn, val, hidden, cfg, by),) = asked
    assert (depths, learn, val, hidden, by) == ([2, 3, 4, 5], "train", "val", 128, "relay")
    assert (cfg.epochs, cfg.patience, cfg.batch_size, cfg.lr, cfg.dropout, cfg.loss, cfg.huber_delta) == (100, 30, 8, 1e-3, 0.1, "huber", 0.0)


def test_a_depth_scan_side_by_side_gives_the_figures_of_one_after_the_other(graphs):
    """on both targets, from graphs packed once."""
    dim, cfg = marker_dimension(graphs[0].sparkSession, ["a", "b", "c"]), TrainConfig(epochs=3, batch_size=2, lr=0.05)
    found = [{(r.kind, r.split, r.depth, r.marker_id): r.rel_mean for r in training.depth_scan([1, 2], graphs, graphs, dim, 4, cfg, min_pos=1, by=by).collect()} for by in ("graph", "relay")]
    assert len(found[0]) == 2 * 3 * (1 + 2 * 2) and found[0] == pytest.approx(found[1], abs=1e-9)


def test_whole_rows_are_added_in_the_edges_order():
    """in rounds where no end comes twice, as column by column; without rounds where an end has many edges."""
    rng = np.random.default_rng(0)
    start, end, h = rng.integers(0, 9, 40), rng.integers(0, 7, 40), rng.normal(size=(9, 4))
    np.testing.assert_array_equal(training.sums_at(h, start, end, training.rounds_of(start, end)), training.sums_at(h, start, end))
    none = np.empty(0, np.int64)
    np.testing.assert_array_equal(training.sums_at(h, none, none, training.rounds_of(none, none)), np.zeros((9, 4)))
    assert training.rounds_of(np.arange(70), np.zeros(70, np.int64)) is None
