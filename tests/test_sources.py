"""NPZ graphs, one malformed file per rule, and JSON sidecars."""

import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from nodeloom.sources import npz, npz_source, sidecars


def put(folder, name, **arrays):
    np.savez(folder / f"{name}.npz", **arrays)


@pytest.fixture()
def folder(tmp_path):
    x, y = np.eye(3, 2, dtype=np.float32), np.array([1, 2, 3], np.float32)
    put(tmp_path, "organoid_a", x=x, y=y, edges=np.array([[0, 1], [1, 2]]), N=3, M=2)
    put(tmp_path, "organoid_b", x=x, y=y.reshape(3, 1))
    (tmp_path / "c_unreadable.npz").write_bytes(b"not a zip")
    put(tmp_path, "d_missing", x=x)
    put(tmp_path, "e_flat_x", x=np.zeros(3), y=y)
    put(tmp_path, "f_wide_y", x=x, y=np.zeros((3, 2)))
    put(tmp_path, "g_length", x=x, y=y[:2])
    put(tmp_path, "h_single", x=x[:1], y=y[:1])
    put(tmp_path, "i_nan", x=x, y=np.array([1, np.nan, 2]))
    put(tmp_path, "j_triples", x=x, y=y, edges=np.zeros((2, 3), int))
    put(tmp_path, "k_flat_edges", x=x, y=y, edges=np.zeros(0, int))
    return tmp_path


def test_rules(spark, folder):
    graphs, nodes, edges, skipped = npz.tables_of(npz.read_npz(spark, str(folder)))
    assert sorted((r.graph_id, r.n_nodes, r.n_markers) for r in graphs.collect()) == [("organoid_a", 3, 2), ("organoid_b", 3, 2)]
    assert nodes.where("graph_id = 'organoid_a'").orderBy("node_id").first().x == [1.0, 0.0]
    assert sorted((r.u, r.v) for r in edges.collect()) == [(0, 1), (1, 2)]
    reasons = {r.graph_id[0]: r.reason for r in skipped.collect()}
    assert reasons == {
        "c": "unreadable: ValueError", "d": "missing x or y", "e": "x is not 2-D", "f": "y is not 1-D", "g": "y and x differ in length",
        "h": "fewer than 2 nodes", "i": "y is not finite", "j": "edges are not (E, 2)", "k": "edges are not (E, 2)",
    }
    with pytest.raises(Exception, match="ValueError"):
        npz.read_npz(spark, str(folder), strict=True).collect()


def test_invalid_node_tables(spark):
    df = spark.createDataFrame([("a", 0, [1.0], 1.0), ("b", 0, [1.0], 1.0), ("b", 1, [1.0], float("inf")), ("c", 0, [1.0], 1.0), ("c", 1, [1.0, 2.0], 1.0), ("d", 0, [1.0], 1.0), ("d", 1, [0.0], 2.0)], "graph_id string, node_id int, x array<double>, y double")
    assert {r.graph_id: r.reason for r in npz.invalid_graphs(df).collect()} == {"a": "fewer than 2 nodes", "b": "y is not finite", "c": "x differs in width"}


def test_sidecars(spark, folder):
    assert sidecars.read_marker_names(spark, str(folder)).count() == 0
    (folder / "z_markers.json").write_text('["late"]')
    (folder / "a_markers.json").write_text('["alpha", "beta"]')
    assert [(r.marker_id, r.name) for r in sidecars.read_marker_names(spark, str(folder)).orderBy("marker_id").collect()] == [(0, "alpha"), (1, "beta")]
    (folder / "organoid_a_aux.json").write_text(json.dumps({"organoid_id": "A", "total_volume": 3, "complexity": [0.5], "ok": True, "note": "text", "pair": [1, 2]}))
    (folder / "organoid_b_aux.json").write_text('{"total_volume": 1.5}')
    (folder / "organoid_c_aux.json").write_text("broken")
    got = {r.graph_id: (r.organoid_id, r.meta) for r in sidecars.read_metadata(spark, str(folder)).collect()}
    assert got["organoid_a"] == ("A", {"total_volume": 3.0, "complexity": 0.5, "ok": 1.0}) and got["organoid_b"] == ("b", {"total_volume": 1.5})


def test_history(spark, tmp_path):
    (tmp_path / "history.json").write_text(json.dumps({"train_loss": [2, 1], "train_mae": [1, 0.5], "val_loss": [3, 2], "val_mae": [2, 1]}))
    back = sidecars.read_history(spark, str(tmp_path / "history.json"))
    assert [tuple(r) for r in back.orderBy("epoch").collect()] == [(0, 2.0, 1.0, 3.0, 2.0), (1, 1.0, 0.5, 2.0, 1.0)]
    sidecars.write_history(back, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def source(spark, path, table="nodes", **options):
    npz_source.register(spark)
    reader = spark.read.format("npz").option("path", str(path)).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_source_equals_decoding(spark, folder):
    """The same tables and reasons as whole-file decoding, one malformed file a rule."""
    put(folder, "l_strings", x=np.array([["a"], ["b"]]), y=np.zeros(2))
    put(folder, "m_fortran", x=np.asfortranarray(np.arange(6.0).reshape(3, 2)), y=np.arange(3), edges=np.zeros((0, 2), int))
    graphs, nodes, edges, skipped = npz.tables_of(npz.read_npz(spark, str(folder)))
    # Which error an unreadable file raises depends on the reader.
    key = lambda df: sorted(repr(tuple(r)).split("unreadable")[0] for r in df.collect())
    for table, want in (("graphs", graphs), ("nodes", nodes), ("edges", edges), ("skipped", skipped)):
        for part_bytes in (1, 32 << 20):
            assert key(source(spark, folder, table, partBytes=part_bytes)) == key(want.select(*source(spark, folder, table).columns))
    assert {r.graph_id: r.reason for r in skipped.collect()}["l_strings"] == "not numbers"
    assert source(spark, folder, x="false").where("x is not null").count() == 0
    with pytest.raises(Exception, match="ValueError"):
        source(spark, folder, strict="true").collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_a_large_graph_is_read_by_several_tasks(spark, tmp_path, save):
    rng = np.random.default_rng(0)
    n = 150_000
    x, y, edges = (rng.random((n, 3)) > 0.5).astype(np.float32), rng.random((n, 1)), rng.integers(0, n, (2 * n, 2))
    save(tmp_path / "big.npz", x=x, y=y, edges=edges)
    put(tmp_path, "small", x=x[:5], y=y[:5])
    size = (tmp_path / "big.npz").stat().st_size
    nodes, pairs = source(spark, tmp_path, partBytes=size // 7), source(spark, tmp_path, "edges", partBytes=size // 7)
    by_task = nodes.where("graph_id = 'big'").groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) >= 7 and max(r["count"] for r in by_task) < n / 5
    rows = nodes.where("graph_id = 'big'").orderBy("node_id").toPandas()
    np.testing.assert_array_equal(np.stack(rows["x"]), x)
    np.testing.assert_array_equal(rows["y"], y.astype(np.float32).astype(float)[:, 0])
    assert rows["node_id"].tolist() == list(range(n)) and nodes.count() == n + 5
    got = pairs.toPandas()
    assert sorted(zip(got["u"], got["v"])) == sorted(map(tuple, edges.tolist()))


def test_edges_do_not_touch_x(spark, tmp_path):
    """The bytes of x are damaged behind their header: only a read of x can tell."""
    put(tmp_path, "a", x=np.ones((4000, 4), np.float32), y=np.arange(4000.0), edges=np.array([[0, 1]]))
    raw = bytearray((tmp_path / "a.npz").read_bytes())
    at = raw.index(np.ones(400, np.float32).tobytes())
    raw[at + 64 : at + 80] = bytes(16)
    (tmp_path / "a.npz").write_bytes(raw)
    assert [tuple(r) for r in source(spark, tmp_path, "edges").collect()] == [("a", 0, 1)] and source(spark, tmp_path, "graphs").count() == 1
    assert source(spark, tmp_path, x="false").count() == 4000
    with pytest.raises(Exception, match="CRC"):
        source(spark, tmp_path).collect()


def test_an_empty_folder(spark, tmp_path):
    assert all(source(spark, tmp_path, t).count() == 0 for t in npz_source.TABLES)


def test_files_are_packed_and_decoded_in_small_batches(spark, folder, monkeypatch):
    """F6, F8, F9, F15: a task holds few files at a time, whatever an Arrow batch has; the rows are the same."""
    rows = lambda df: sorted(str(r) for r in df.collect())
    want = rows(npz.read_npz(spark, str(folder)))
    monkeypatch.setattr(npz, "HELD", 2)
    assert rows(npz.read_npz(spark, str(folder))) == want
    packed = spark.createDataFrame([(f"g{i}", [3, 5, 9], [[0.0, 1.0]] * 3, [[1.5], [2.5], [float(i)]], [3, 5, 9, 5], [5, 3, 5, 9]) for i in range(7)], "graph_id string, ids array<bigint>, x array<array<double>>, y array<array<double>>, src array<bigint>, dst array<bigint>").coalesce(1)
    monkeypatch.setattr(npz, "HELD_BYTES", 1)
    files = npz.pack(packed)
    sizes = files.mapInArrow(lambda batches: batches, files.schema).count()
    got = npz.decode_contents(files).select("graph_id", "x", "y", "edges").collect()
    assert sizes == 7 and {r.graph_id: (r.x, r.y, r.edges) for r in got} == {f"g{i}": ([[0.0, 1.0]] * 3, [1.5, 2.5, float(i)], [[0, 1], [1, 2]]) for i in range(7)}
