"""Scoring against NumPy, gradients against finite differences, and training."""

import numpy as np
import pytest

from nodeloom.models.message_passing import Gin, Sage
from nodeloom.models.training import AdamW, GinTape, Joined, Tape, TrainConfig, depth_scan, strong_wolfe, epoch_sweep, joined_sums, lbfgs, loss_and_slope, packed_graphs, penalty_and_slope, predict_markers, step_sums, train
from nodeloom.operators.graphs import normalise_edges
from nodeloom.operators.markers import marker_dimension
from nodeloom.sources.builders import build_graph


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((7, 3)) > 0.5).astype(float)
    y = x @ [1.0, -2.0, 0.5] + 0.3
    nodes, raw = build_graph(spark, "g", x.tolist(), y.tolist(), [(0, 1), (1, 2), (2, 3), (4, 5)])
    return nodes, normalise_edges(raw), x, y


def arrays(edges):
    pairs = [(r.src, r.dst) for r in edges.collect()]
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def test_sage_scores_equal_numpy(small):
    nodes, edges, x, _ = small
    for norm in ("layer", "batch", None):
        model = Sage(3, 5, 2, norm=norm).init(4)
        src, dst = arrays(edges)
        if norm == "batch":
            for k in range(2):
                model.weights[f"l{k}.mean"], model.weights[f"l{k}.var"] = np.linspace(-0.2, 0.3, 5), np.linspace(0.5, 2, 5)
        h, w = x, model.weights
        for k in range(2):
            near = np.zeros_like(h)
            for s, d in zip(src, dst):
                near[d] += h[s]
            near /= np.maximum(np.bincount(dst, minlength=7), 1)[:, None]
            z = np.array([[sum(near[v, i] * w[f"l{k}.near"][i, j] + h[v, i] * w[f"l{k}.own"][i, j] for i in range(h.shape[1])) + w[f"l{k}.bias"][j] for j in range(5)] for v in range(7)])
            if norm == "layer":
                z = np.array([(row - row.sum() / 5) / np.sqrt(((row - row.sum() / 5) ** 2).sum() / 5 + 1e-5) for row in z]) * w[f"l{k}.gain"] + w[f"l{k}.shift"]
            if norm == "batch":
                z = (z - w[f"l{k}.mean"]) / np.sqrt(w[f"l{k}.var"] + 1e-5) * w[f"l{k}.gain"] + w[f"l{k}.shift"]
            h = np.where(z > 0, z, 0) + (h @ w["project"] if k == 0 else h)
        want = (h @ model.weights["head"] + model.weights["head.bias"])[:, 0]
        got = [r.yhat for r in model.transform(nodes, edges).orderBy("node_id").collect()]
        np.testing.assert_allclose(got, want, atol=1e-9)


def test_gin_scores_equal_numpy(small):
    nodes, edges, x, _ = small
    model, h = Gin(3, 4, 2).init(2), x
    src, dst = arrays(edges)
    for k in range(2):
        near = np.zeros_like(h)
        np.add.at(near, dst, h[src])
        w = model.weights
        inner = (h + near) @ w[f"l{k}.a"] + w[f"l{k}.a.bias"]
        outer = np.where(inner > 0, inner, 0) @ w[f"l{k}.b"] + w[f"l{k}.b.bias"]
        h = np.where(outer > 0, outer, 0)
    got = [r.yhat for r in model.transform(nodes, edges).orderBy("node_id").collect()]
    np.testing.assert_allclose(got, (h @ model.weights["head"] + model.weights["head.bias"])[:, 0], atol=1e-9)
    assert model.num_parameters() == (3 * 4 + 4 + 16 + 4) + (16 + 4 + 16 + 4) + 5


@pytest.mark.parametrize("norm,residual", [("layer", True), (None, True), ("layer", False)])
def test_gradient_equals_finite_differences(norm, residual):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 1))
    src, dst = np.array([0, 1, 2, 3, 1]), np.array([1, 0, 1, 2, 4])
    model, cfg = Sage(3, 4, 2, residual=residual, norm=norm).init(1), TrainConfig()
    tape = Tape(model, x, src, dst)
    g = tape.gradient(loss_and_slope(tape.output, y, cfg, None)[1])
    loss = lambda: loss_and_slope(Tape(model, x, src, dst).output, y, cfg, None)[0]
    for name, w in model.weights.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        keep = w[at]
        w[at] = keep + 1e-6
        up = loss()
        w[at] = keep - 1e-6
        down = loss()
        w[at] = keep
        assert g[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def assert_gradient(model, g, loss, rng):
    for name in g:
        w = model.weights[name]
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in w.shape)
            keep = w[at]
            w[at] = keep + 1e-6
            up = loss()
            w[at] = keep - 1e-6
            down = loss()
            w[at] = keep
            assert g[name][at] == pytest.approx((up - down) / 2e-6, abs=2e-5), name


def test_gin_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 1))
    src, dst = np.array([0, 1, 2, 3, 1]), np.array([1, 0, 1, 2, 4])
    model, cfg = Gin(3, 4, 2, eps=0.3).init(1), TrainConfig()
    tape = GinTape(model, x, src, dst)
    g = tape.gradient(loss_and_slope(tape.output, y, cfg, None)[1])
    assert set(g) == set(model.weights)
    assert_gradient(model, g, lambda: loss_and_slope(GinTape(model, x, src, dst).output, y, cfg, None)[0], rng)


@pytest.mark.parametrize("frozen", [False, True])
def test_batch_norm_gradient_equals_finite_differences(spark, small, frozen):
    """The whole minibatch's statistics (of two graphs over several partitions), or the stored ones."""
    nodes, edges, *_ = small
    both = edges.unionByName(edges.selectExpr("'h' as graph_id", "src", "dst"))
    packed = packed_graphs(nodes.unionByName(nodes.selectExpr("'h' as graph_id", "node_id", "transform(x, v -> 1 - v) as x", "2 * y as y")), both)
    model, cfg, rng = Sage(3, 4, 2, norm="batch").init(3), TrainConfig(calibration_weight=0.3), np.random.default_rng(2)
    loss, _, n, g, moments = step_sums(model, packed.repartition(2), cfg, True, 0, frozen=frozen)
    again = step_sums(model, packed.repartition(1), cfg, True, 0, frozen=frozen)
    assert n == 14 and again[0] == pytest.approx(loss) and (moments is None) == frozen
    for k in g:
        np.testing.assert_allclose(g[k], again[3][k], atol=1e-9)
    from nodeloom.models.training import union_of

    rows = packed.toPandas()

    def plain() -> float:
        """The same loss on all nodes at once."""
        x, y, src, dst = union_of(rows)
        m = None
        if not frozen:
            m = []
            for k in range(2):
                z = Tape(model, x, src, dst, moments=m, upto=k).z
                m.append((z.mean(0), z.var(0)))
        out = Tape(model, x, src, dst, moments=m).output
        r = out - y
        sums = np.array([r.size, r.sum(), y.sum(), (r * y).sum(), (r * r).sum(), (y * y).sum()])
        return loss_and_slope(out, y, cfg, None)[0] / len(y) + 0.3 * penalty_and_slope(sums, "corr")[0]

    assert plain() == pytest.approx(loss)
    assert_gradient(model, g, plain, rng)


@pytest.mark.parametrize("model", [Sage(3, 8, 1, norm="batch"), Gin(3, 8, 1)], ids=["batch", "gin"])
def test_batch_norm_and_gin_train(small, model):
    nodes, edges, *_ = small
    fitted, metrics, history = train(model.init(0), (nodes, edges), (nodes, edges), TrainConfig(epochs=12, lr=0.05, patience=12))
    assert metrics["val_mae"] < history[0]["val_mae"]
    scored = fitted.transform(nodes, edges).selectExpr("avg(abs(yhat - y)) as e").first().e
    assert scored == pytest.approx(metrics["val_mae"], abs=1e-6)
    if isinstance(model, Sage):
        assert not np.allclose(fitted.weights["l0.mean"], 0)


@pytest.mark.parametrize("f,slope", [(lambda t: (t - 3) ** 2, lambda t: 2 * (t - 3)), (lambda t: np.cos(t), lambda t: -np.sin(t)), (lambda t: (t - 0.01) ** 4 - t * 1e-3, lambda t: 4 * (t - 0.01) ** 3 - 1e-3)])
def test_strong_wolfe(f, slope):
    for start in (1e-3, 0.5, 2.0):
        at0 = 0.4 if f(0) == 1 else 0.0  # away from the top of the cosine
        t, (loss, s) = strong_wolfe(lambda t: (f(at0 + t), slope(at0 + t)), f(at0), slope(at0), start)
        assert loss <= f(at0) + 1e-4 * t * slope(at0) and abs(s) <= 0.9 * abs(slope(at0)) and t > 0


@pytest.mark.parametrize("mode", ["corr", "cov"])
def test_penalty_slope(mode):
    rng = np.random.default_rng(5)
    r, y = rng.normal(size=9), rng.normal(size=9)
    m = lambda r: np.array([9, r.sum(), y.sum(), (r * y).sum(), (r * r).sum(), (y * y).sum()])
    _, (a, b, c) = penalty_and_slope(m(r), mode)
    e = np.zeros(9)
    e[3] = 1e-6
    assert (a * r + b * y + c)[3] == pytest.approx((penalty_and_slope(m(r + e), mode)[0] - penalty_and_slope(m(r - e), mode)[0]) / 2e-6, abs=1e-6)


def test_training_lowers_the_error(spark, small):
    nodes, edges, *_ = small
    cfg = TrainConfig(epochs=25, lr=0.05, patience=25, calibration_weight=0.1)
    model, metrics, history = train(Sage(3, 8, 1).init(0), (nodes, edges), (nodes, edges), cfg)
    assert history[-1]["train_loss"] < history[0]["train_loss"] and metrics["val_mae"] < history[0]["val_mae"]
    scored = model.transform(nodes, edges).selectExpr("avg(abs(yhat - y)) as e").first().e
    assert scored == pytest.approx(metrics["val_mae"], abs=1e-6)
    with pytest.raises(ValueError):
        train(Sage(3, 8, 1).init(0), (nodes.where("false"), edges), (nodes, edges), cfg)


def test_minibatch_sums_do_not_depend_on_partitions(spark, small):
    nodes, edges, *_ = small
    more = nodes.unionByName(nodes.selectExpr("'h' as graph_id", "node_id", "x", "y + 1 as y"))
    both = edges.unionByName(edges.selectExpr("'h' as graph_id", "src", "dst"))
    packed, model, cfg = packed_graphs(more, both), Sage(3, 4, 2).init(0), TrainConfig(calibration_weight=0.5)
    a, b = step_sums(model, packed.repartition(1), cfg, True, 0), step_sums(model, packed.repartition(3), cfg, True, 0)
    assert a[0] == pytest.approx(b[0]) and a[2] == b[2] == 14
    for k in a[3]:
        np.testing.assert_allclose(a[3][k], b[3][k], atol=1e-9)


def test_multilabel(spark, small):
    nodes, edges, x, _ = small
    targets = nodes.selectExpr("graph_id", "node_id", "array(y) as x", "transform(slice(x, 1, 2), v -> double(v)) as y")
    model, metrics, history = train(Sage(1, 8, 1, outputs=2).init(0), (targets, edges), (targets, edges), TrainConfig(epochs=15, lr=0.1, patience=15, dropout=0.1), np.array([1.0, 2.0]))
    assert metrics["val_mae"] <= history[0]["val_mae"]
    row = predict_markers(model, targets, edges).first()
    assert len(row.prob) == 2 and all(0 <= p <= 1 for p in row.prob) and set(row.pred) <= {0, 1}


def test_depth_scan(spark, small):
    nodes, edges, *_ = small
    dim = marker_dimension(spark, ["a", "b", "c"])
    got = depth_scan([1, 2], (nodes, edges), (nodes, edges), dim, 4, TrainConfig(epochs=2), min_pos=1).collect()
    assert {(r.kind, r.split, r.depth) for r in got} == {("baseline", s, 0) for s in ("train", "val")} | {(k, s, d) for k in ("raw", "residual") for s in ("train", "val") for d in (1, 2)}
    assert all(r.rel_mean >= 0 and r.rel_sem == 0 and r.n_graphs == 1 for r in got)


def test_depth_scan_pools_the_denominator(spark, small):
    """Errors are relative to the marker means over training and validation nodes together."""
    nodes, edges, x, y = small
    val = nodes.selectExpr("'h' as graph_id", "node_id", "x", "y + 5 as y"), edges.selectExpr("'h' as graph_id", "src", "dst")
    got = {(r.split, r.marker_id): r.rel_mean for r in depth_scan([], (nodes, edges), val, marker_dimension(spark, ["a", "b", "c"]), 4, TrainConfig(epochs=1), min_pos=1).collect()}
    for m in range(3):
        on = x[:, m] > 0.5
        mu = np.concatenate([y[on], y[on] + 5]).mean()
        for split, target in (("train", y[on]), ("val", y[on] + 5)):
            assert got[split, m] == pytest.approx(np.mean((target - mu) ** 2) / (mu * mu + 1e-8))


def test_lbfgs_and_sweep(small):
    nodes, edges, *_ = small
    model, history = lbfgs(Sage(3, 6, 1, norm=None).init(0), (nodes, edges), steps=5, inner=3)
    assert history[-1]["train_loss"] < 0.2 * history[0]["train_loss"] and len(history) <= 6 and all(b["train_loss"] <= a["train_loss"] for a, b in zip(history, history[1:]))
    rows = epoch_sweep([1, 12], (nodes, edges), 3, 6, 1, "adamw", cfg=TrainConfig(lr=0.05))
    assert [r["epochs"] for r in rows] == [1, 12] and rows[1]["mae"] < rows[0]["mae"]


def test_clipping():
    w = {"a": np.zeros(2)}
    AdamW(TrainConfig(lr=0.1)).step(w, {"a": np.array([300.0, 400.0])})
    np.testing.assert_allclose(w["a"], [-0.1, -0.1], atol=1e-6)


@pytest.mark.parametrize("model", [Sage(3, 4, 2), Sage(3, 4, 2, norm=None, residual=False), Sage(3, 3, 2, norm="batch"), Gin(3, 4, 2, eps=0.2)], ids=["layer", "plain", "batch", "gin"])
def test_joined_steps_equal_packed_steps(small, model):
    """Loss, error and gradients by joins over nodes and edges are those of packed graphs; a directed edge goes one way."""
    nodes, edges, *_ = small
    both = nodes.unionByName(nodes.selectExpr("'h' as graph_id", "node_id", "x", "y + 1 as y"))
    arcs = edges.where("not (src = 1 and dst = 0)").unionByName(edges.selectExpr("'h' as graph_id", "src", "dst"))
    cfg = TrainConfig(calibration_weight=0.2)
    model = model.init(5)
    for learn in (True, False):
        want, got = step_sums(model, packed_graphs(both, arcs), cfg, learn, 0), joined_sums(model, Joined.of(both, arcs), cfg, learn, 0)
        assert got[:3] == (pytest.approx(want[0]), pytest.approx(want[1]), want[2])
    want, got = step_sums(model, packed_graphs(both, arcs), cfg, True, 0), joined_sums(model, Joined.of(both, arcs), cfg, True, 0)
    assert set(got[3]) == set(want[3])
    for k in want[3]:
        np.testing.assert_allclose(got[3][k], want[3][k], atol=1e-9)


def test_training_by_joins(small):
    nodes, edges, *_ = small
    histories = [train(Sage(3, 4, 1).init(0), (nodes, edges), (nodes, edges), TrainConfig(epochs=2, lr=0.05), by=by)[2] for by in ("graph", "joins")]
    for a, b in zip(*histories, strict=True):
        assert all(a[k] == pytest.approx(b[k]) for k in a)
