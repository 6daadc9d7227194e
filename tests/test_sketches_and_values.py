"""Edges from sketches against exact ones, and metadata kept as whole values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import bins, sketches
from nodeloom.sources import sidecars


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    rows = [(s, float(v)) for s, n in (("a", 20_000), ("b", 300)) for v in rng.lognormal(size=n)] + [("a", None), ("a", float("nan")), ("b", float("inf")), ("c", None)]
    return spark.createDataFrame(rows, "s string, y double").repartition(4)


@pytest.mark.parametrize(("strategy", "fallback"), [("quantile", "clipped"), ("uniform", "clipped"), ("uniform", "range")])
def test_sketched_edges_within_their_error(values, tmp_path, strategy, fallback):
    """Two halves added one after the other."""
    path, clean = f"file://{tmp_path}/sketches", values.where("y is not null and not isnan(y) and y < double('inf')")
    sketches.add_sketches(values.where("y < 1"), path, by=["s"])
    merged = sketches.add_sketches(values.where("not y < 1 or isnan(y)"), path, by=["s"])
    got = {r.s: r for r in sketches.sketched_edges(merged, 10, strategy, ["s"], fallback=fallback).collect()}
    exact = {r.s: r for r in bins.edges_of(clean, nbins=10, strategy=strategy, by=["s"], fallback=fallback).collect()}
    assert got.keys() == exact.keys() == {"a", "b"}
    for s in got:
        y = np.sort([r.y for r in clean.where(F.col("s") == s).collect()])
        assert got[s].n == len(y) and len(got[s].edges) == len(exact[s].edges) == 11
        if strategy == "quantile":
            assert got[s].edges[0] == y[0] and got[s].edges[-1] == y[-1]
            at = np.searchsorted(y, got[s].edges) / len(y)
            assert np.abs(at - np.linspace(0, 1, 11)).max() <= sketches.rank_error() + 1 / len(y)
        else:
            assert np.diff(got[s].edges) == pytest.approx(np.diff(got[s].edges)[0])


def test_sketches_are_small_and_odd_series(spark, values):
    made = sketches.sketch_values(spark.range(300_000).select(F.rand(1).alias("y"))).first()
    assert made.n == 300_000 and len(made.sketch) < 100_000
    few = sketches.sketched_edges(sketches.sketch_values(spark.createDataFrame([(1.0,), (1.0,)], "y double")), 4)
    assert few.first().edges == [1.0] * 5  # too few: equal widths of nothing
    assert sketches.sketch_values(values.where("false")).count() == 0 and sketches.merge_sketches(sketches.sketch_values(values.where("s = 'c'"), by=["s"]), ["s"]).count() == 0
    with pytest.raises(ValueError):
        sketches.sketched_edges(sketches.sketch_values(values), strategy="none")


def test_metadata_as_values(spark, tmp_path):
    put = lambda stem, text: (tmp_path / f"organoid_{stem}_aux.json").write_text(text if isinstance(text, str) else json.dumps(text))
    put("a", {"organoid_id": "A", "complexity": [0.5], "note": "text", "pair": [1, 2], "deep": {"k": 3, "tags": ["x"]}, "ok": True})
    put("b", {"complexity": 2, "note": 7})
    put("c", "broken")
    put("d", "[1, 2]")
    got = sidecars.read_metadata_values(spark, str(tmp_path))
    rows = {r.graph_id: r for r in sidecars.promoted(got, complexity="double", note="string", pair="int", k="int $.deep.k", tag="string $.deep.tags", ok="boolean").collect()}
    assert {k: (r.organoid_id, r.complexity, r.note, r.pair, r.k, r.tag, r.ok) for k, r in rows.items()} == {
        "organoid_a": ("A", 0.5, "text", None, 3, "x", True), "organoid_b": ("b", 2.0, "7", None, None, None, None),
    }
    told = sidecars.metadata_schema(got)
    assert told.startswith("OBJECT<") and all(k in told for k in ("complexity", "deep", "tags", "note"))
