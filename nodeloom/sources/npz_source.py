"""A Spark data source of NPZ folders: ``spark.read.format("npz")`` after ``register(spark)``.

Options: ``path`` (a folder of ``*.npz``), ``table`` ('nodes', 'edges', 'graphs' or 'skipped'), ``x`` ('false' leaves out x of the nodes),
``partBytes`` (32 MB) and ``strict`` ('true' fails on a file that breaks a rule).

Planning lists the folder.  Small files are dealt together up to ``partBytes``; of a larger one only the zip directory and the array headers
are read, and its rows (nodes or edges) are cut into chunks for several tasks, so a graph with a third of all nodes isn't one task.  A task
reads what its table needs: edges don't touch x, and graphs only headers and y.  Arrays are read as streams, a block of rows at a
time.  Every task tests the rules of ``sources.npz`` by itself; the test that y is finite reads y as a whole, so all tasks of a file agree.

A compressed array has no places to start from: a chunk's task inflates what lies before it and drops it, so such files are cut into ``MOST_CHUNKS`` at most.
Arrays in Fortran order aren't cut.  Where x or the edges behind a sound header turn out to be damaged, the read fails; check sums are those of the zip
format, so they cover arrays that are read as a whole, not chunks from the middle.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 32 << 20
MOST_CHUNKS = 64
#: Rows of an array that a task holds at a time.
BLOCK = 1 << 16

TABLES = {
    "nodes": pa.schema([("graph_id", pa.string()), ("node_id", pa.int64()), ("x", pa.list_(pa.float32())), ("y", pa.float64())]),
    "edges": pa.schema([("graph_id", pa.string()), ("u", pa.int64()), ("v", pa.int64())]),
    "graphs": pa.schema([("graph_id", pa.string()), ("n_nodes", pa.int64()), ("n_markers", pa.int32())]),
    "skipped": pa.schema([("graph_id", pa.string()), ("reason", pa.string())]),
}


@dataclass
class Part(InputPartition):
    """Whole files, or rows ``start`` to ``stop`` of one."""

    files: tuple[str, ...]
    start: int = 0
    stop: int | None = None


class Array:
    """An array in an open archive: its header, and its rows as a stream."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.archive, self.info = archive, archive.getinfo(f"{name}.npy")
        with archive.open(self.info) as f:
            self.shape, self.by_column, self.dtype = self._header(f)
            self.offset = f.tell()

    @staticmethod
    def _header(f) -> tuple:
        version = np.lib.format.read_magic(f)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)

    def rows(self, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
        """Blocks of rows from ``start`` to ``stop``."""
        n, width = self.shape[0], int(np.prod(self.shape[1:], dtype=int))
        stop, size = n if stop is None else min(stop, n), width * self.dtype.itemsize
        with self.archive.open(self.info) as f:
            self._header(f)  # read, not sought: an archive's check sum counts only for what is read from the start
            if self.by_column and len(self.shape) > 1:
                yield np.frombuffer(f.read(n * size), self.dtype).reshape(self.shape, order="F")[start:stop]
                return
            if start:
                f.seek(self.offset + start * size)
            for at in range(start, stop, BLOCK):
                raw = f.read(min(BLOCK, stop - at) * size)
                yield np.frombuffer(raw, self.dtype).reshape(-1, *self.shape[1:])


class Archive:
    """An NPZ file and the rules that it must keep."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        names = {n.removesuffix(".npy") for n in self.zip.namelist()}
        self.arrays = {n: Array(self.zip, n) for n in ("x", "y", "edges") if n in names}

    def problem(self) -> str | None:
        """Why the graph is to be left out, None if it is sound."""
        if "x" not in self.arrays or "y" not in self.arrays:
            return "missing x or y"
        if any(a.dtype.kind not in "biuf" for a in self.arrays.values()):
            return "not numbers"
        x, y, edges = self.arrays["x"], self.arrays["y"], self.arrays.get("edges")
        if len(x.shape) != 2:
            return "x is not 2-D"
        if len(y.shape) != 1 and not (len(y.shape) == 2 and 1 in y.shape):
            return "y is not 1-D"
        if int(np.prod(y.shape)) != x.shape[0]:
            return "y and x differ in length"
        if x.shape[0] <= 1:
            return "fewer than 2 nodes"
        with np.errstate(over="ignore"):
            if not all(np.isfinite(b.astype(np.float32)).all() for b in y.rows()):
                return "y is not finite"
        if edges is not None and (len(edges.shape) != 2 or 0 not in edges.shape and edges.shape[1] != 2):
            return "edges are not (E, 2)"
        return None


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = re.sub("^file:/+", "file:///", options["path"])
        self.table, self.strict = options.get("table", "nodes"), options.get("strict", "false").lower() == "true"
        self.with_x, self.part_bytes = options.get("x", "true").lower() == "true", int(options.get("partbytes", PART_BYTES))

    def _filesystem(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.path:
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), self.path

    def partitions(self) -> list[Part]:
        fs, root = self._filesystem()
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".npz"))
        parts, group, size = [], [], 0
        for path, length in found:
            if length > self.part_bytes and self.table in ("nodes", "edges"):
                parts.extend(self._chunks(fs, path, length))
                continue
            if group and size + length > self.part_bytes:
                parts.append(Part(tuple(group)))
                group, size = [], 0
            group.append(path)
            size += length
        return [*parts, *([Part(tuple(group))] if group else [])] or [Part(())]

    def _chunks(self, fs: pafs.FileSystem, path: str, length: int) -> list[Part]:
        """Equal ranges of a large file's rows; the whole file where its header can't tell."""
        try:
            with fs.open_input_file(path) as file:
                array = Archive(file).arrays["x" if self.table == "nodes" else "edges"]
                n, packed = array.shape[0], array.info.compress_type != zipfile.ZIP_STORED
                wanted = 1 if array.by_column else -(-length // self.part_bytes)
        except Exception:  # told where the rules are tested
            return [Part((path,))]
        chunks = max(1, min(wanted, n, MOST_CHUNKS if packed else wanted))
        return [Part((path,), n * i // chunks, n * (i + 1) // chunks) for i in range(chunks)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = self._filesystem()
        for path in part.files:
            key = path.rsplit("/", 1)[-1].removesuffix(".npz")
            with fs.open_input_file(path) as file:
                try:
                    archive = Archive(file)
                    reason = archive.problem()
                except Exception as e:  # any unreadable content is a reason to skip, not to fail
                    archive, reason = None, f"unreadable: {type(e).__name__}"
                if reason and self.strict:
                    raise ValueError(f"{key}: {reason}")
                if reason is None and self.table != "skipped":
                    yield from self._rows(key, archive.arrays, part)
                elif reason and self.table == "skipped":
                    yield self._batch([key], [reason])

    def _rows(self, key: str, arrays: dict[str, Array], part: Part) -> Iterator[pa.RecordBatch]:
        n, m = arrays["x"].shape
        if self.table == "graphs":
            yield self._batch([key], [n], [m])
        elif self.table == "edges" and "edges" in arrays and 0 not in arrays["edges"].shape:
            for pairs in arrays["edges"].rows(part.start, part.stop):
                pairs = pairs.astype(np.int64)
                yield self._batch([key] * len(pairs), pairs[:, 0], pairs[:, 1])
        elif self.table == "nodes":
            stop, at = n if part.stop is None else part.stop, part.start
            y = arrays["y"]
            y.shape, y.by_column = (n,), False  # (N, 1) and (1, N) lie as (N)
            blocks = arrays["x"].rows(part.start, stop) if self.with_x else (None for _ in range(part.start, stop, BLOCK))
            for target in y.rows(part.start, stop):
                x = next(blocks)
                while x is not None and len(x) < len(target):
                    x = np.concatenate([x, next(blocks)])
                lists = pa.nulls(len(target), pa.list_(pa.float32()))
                if x is not None:
                    x, blocks = x[: len(target)], _pushed(x[len(target) :], blocks)
                    flat = np.ascontiguousarray(x, np.float32).reshape(-1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(target) + 1, dtype=np.int32) * m, pa.int32()), pa.array(flat, pa.float32()))
                yield self._batch([key] * len(target), np.arange(at, at + len(target)), lists, target.astype(np.float32).astype(float))
                at += len(target)

    def _batch(self, *columns) -> pa.RecordBatch:
        schema = TABLES[self.table]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pushed(rest: np.ndarray, blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """``blocks`` with what is left of one before them."""
    if len(rest):
        yield rest
    yield from blocks


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        spelled = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.list_(pa.float32()): "array<float>"}
        return ", ".join(f"{f.name} {spelled[f.type]}" for f in TABLES[self.options.get("table", "nodes")])

    def reader(self, schema) -> NpzReader:
        return NpzReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)
