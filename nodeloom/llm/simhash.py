"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: lower-cased (A-Z) words between ASCII white space, shingles of ``width``
words with repeats, XXH64 (seed 42) of each; a bit is set if it is set in over half the
shingles.  Fewer words give one shingle of the whole sequence; no words (empty or null
text) give fingerprint zero, which links like any other.

Self-join: distinct fingerprints form a binary trie.  Its upper part is cut where a
node holds at most ``leaf_rows`` fingerprints (and at 2^6 nodes at least, to share the work; a
hot region is cut deeper, down to single fingerprints), node pairs of the cut whose
prefixes differ in at most ``budget`` bits become tasks' groups, and in each group the two subtrees are walked together: a pair of nodes splits
into its children's pairs, differing bits add up, and a pair over the budget is pruned.
Groups return a spanning forest of what they link, not all pairs, so that a large
group of near copies stays linear; components are then joined over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nodeloom.llm.storage import checkpointed
from nodeloom.llm.wordhash import ascii_words
from nodeloom.operators.components import connected_components

BITS = 64
#: The trie is cut at this depth at least.
LEAST_DEPTH = 6
#: Shingles hashed at a time, so that a very long text stays small in memory.
CHUNK = 1 << 16
#: Node pairs walked, or leaf pairs verified, at a time.
WALK = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of one whole text."""
    words = ascii_words(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        h = np.array([xxh64_intdigest(line[s:e], 42) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's bits as a signed long), one row per document."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(hashed, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def _prefix(fp: Column | str, depth: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - depth) if depth < BITS else F.col(fp)


def cut_levels(n: int, leaf_rows: int) -> list[int]:
    """Depths at which the trie may be cut: first where ``n`` evenly spread fingerprints half fill the nodes, then deeper."""
    first = LEAST_DEPTH
    while first < BITS and n >> first > leaf_rows // 2:
        first += 1
    return sorted({min(BITS, first + more) for more in (0, 4, 8, 16, 24, 32, 40, 48, BITS)})


def trie_cut(fps: DataFrame, leaf_rows: int) -> tuple[DataFrame, list[int]]:
    """(``fp``, ``depth``, ``prefix`` at the shallowest level whose node holds at most ``leaf_rows``; the levels)."""
    open_rows = checkpointed(fps.select("fp"))
    levels, settled = cut_levels(open_rows.count(), leaf_rows), None
    for depth in levels:
        with_prefix = open_rows.withColumn("prefix", _prefix("fp", depth))
        nodes = with_prefix.groupBy("prefix").agg(F.count("*").alias("n"))
        last = depth == BITS
        small = nodes if last else nodes.where(F.col("n") <= leaf_rows)
        here = with_prefix.join(small.select("prefix"), "prefix").select("fp", F.lit(depth).alias("depth"), "prefix")
        settled = here if settled is None else settled.unionByName(here)
        if last:
            break
        open_rows = checkpointed(with_prefix.join(nodes.where(F.col("n") > leaf_rows).select("prefix"), "prefix").select("fp"))
        if open_rows.isEmpty():
            break
    return settled, levels


def _flips(depth: int, budget: int) -> np.ndarray:
    """Masks of ``depth`` bits with at most ``budget`` ones."""
    masks = {0}
    for _ in range(budget):
        masks |= {m | 1 << b for m in masks for b in range(depth)}
    return np.array(sorted(masks), np.uint64)


def _node_pairs(nodes: DataFrame, budget: int, levels: list[int]) -> DataFrame:
    """Pairs of cut nodes (left at least as deep) whose common prefix differs in few bits."""

    @F.pandas_udf("array<struct<depth:int,prefix:bigint>>")
    def near(depths: pd.Series, prefixes: pd.Series) -> pd.Series:
        masks = {d: _flips(d, budget) for d in levels}
        out = []
        for depth, prefix in zip(depths, prefixes, strict=True):
            p = np.uint64(prefix & (1 << BITS) - 1)
            out.append([{"depth": d, "prefix": int(q)} for d in levels if d <= depth for q in ((p >> np.uint64(depth - d)) ^ masks[d]).view(np.int64)])
        return pd.Series(out)

    left = nodes.select("depth", "prefix", F.explode(near("depth", "prefix")).alias("other"))
    right = nodes.select(F.col("depth").alias("depth2"), F.col("prefix").alias("prefix2"))
    met = left.join(right, (F.col("other.depth") == F.col("depth2")) & (F.col("other.prefix") == F.col("prefix2")))
    once = (F.col("depth") > F.col("depth2")) | (F.col("prefix") <= F.col("prefix2"))
    return met.where(once).select("depth", "prefix", "depth2", "prefix2")


def _forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``parent`` (fully compressed least labels) after linking u[i] with v[i]."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def walk_trie(fps: np.ndarray, budget: int, whole: int | None = None) -> np.ndarray:
    """Least-index labels of sorted distinct ``fps`` (uint64) linked within ``budget`` bits.

    With ``whole``, only pairs across it are sought: fps[:whole] and fps[whole:] are two sorted tries.
    """
    parent = np.arange(len(fps))
    if whole is None:
        stack = [(0, np.array([[0, len(fps), 0, len(fps), 0]]))]
    else:
        stack = [(0, np.array([[0, whole, whole, len(fps), 0]]))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > WALK:
            stack += [(depth, pairs[i : i + WALK]) for i in range(0, len(pairs), WALK)]
            continue
        alo, ahi, blo, bhi, bits = pairs.T
        small = (ahi - alo) * (bhi - blo) <= 64
        if depth >= BITS:
            small[:] = True
        if small.any():
            leaves = pairs[small]
            na, nb = leaves[:, 1] - leaves[:, 0], leaves[:, 3] - leaves[:, 2]
            for at in np.array_split(np.arange(len(leaves)), max(1, int((na * nb).sum() // WALK))):
                size = na[at] * nb[at]
                row = np.repeat(at, size)
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                u, v = leaves[row, 0] + k // nb[row], leaves[row, 2] + k % nb[row]
                near = np.bitwise_count(fps[u] ^ fps[v]) <= budget
                parent = _forest(parent, u[near], v[near])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        alo, ahi, blo, bhi, bits = pairs.T

        def middle(lo, hi):
            """First index of lo..hi whose bit at ``depth`` is set (ranges are sorted and share a prefix)."""
            lo, hi = lo.copy(), hi.copy()
            bit = np.uint64(BITS - 1 - depth)
            while (going := lo < hi).any():
                mid = (lo + hi) // 2
                one = ((fps[np.minimum(mid, len(fps) - 1)] >> bit) & np.uint64(1)).astype(bool)
                hi = np.where(going & one, mid, hi)
                lo = np.where(going & ~one, mid + 1, lo)
            return lo

        am, bm = middle(alo, ahi), middle(blo, bhi)
        same = (alo == blo) & (ahi == bhi)
        split = [
            np.stack([alo, am, blo, bm, bits], 1),
            np.stack([am, ahi, bm, bhi, bits], 1),
            np.stack([alo, am, bm, bhi, bits + 1], 1),
            np.stack([am, ahi, blo, bm, bits + 1], 1)[~same],
        ]
        nxt = np.concatenate(split)
        nxt = nxt[(nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2]) & (nxt[:, 4] <= budget)]
        if len(nxt):
            stack.append((depth + 1, nxt))
    return parent


def _linked(budget: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups arrive sorted by node pair; a group may span batches."""

        def done(left: list, right: list) -> pd.DataFrame | None:
            a = np.unique(np.concatenate(left).view(np.uint64)) if left else np.zeros(0, np.uint64)
            b = np.unique(np.concatenate(right).view(np.uint64)) if right else np.zeros(0, np.uint64)
            if right:
                fps = np.concatenate([a, b])
                parent = walk_trie(fps, budget, len(a))
            else:
                fps = a
                parent = walk_trie(fps, budget)
            moved = np.flatnonzero(parent != np.arange(len(fps)))
            if not len(moved):
                return None
            return pd.DataFrame({"a": fps[moved].view(np.int64), "b": fps[parent[moved]].view(np.int64)})

        group, left, right = None, [], []
        for batch in batches:
            for name, part in batch.groupby(["depth", "prefix", "depth2", "prefix2"], sort=False):
                if name != group:
                    if group is not None and (out := done(left, right)) is not None:
                        yield out
                    group, left, right = name, [], []
                fp, side = part["fp"].to_numpy(np.int64), part["side"].to_numpy()
                for into, of in ((left, 0), (right, 1)):
                    if (side == of).any():
                        into.append(fp[side == of])
        if group is not None and (out := done(left, right)) is not None:
            yield out

    return links


def fingerprint_links(fps: DataFrame, budget: int = 2, leaf_rows: int = 1 << 19) -> DataFrame:
    """``a``, ``b``: a set of links that connects what is within ``budget`` bits (signed longs)."""
    settled, levels = trie_cut(fps.select("fp").where("fp is not null").distinct(), leaf_rows)
    cut = checkpointed(settled)
    pairs = checkpointed(_node_pairs(cut.select("depth", "prefix").distinct(), budget, levels))
    names = ["depth", "prefix", "depth2", "prefix2"]
    first = cut.join(pairs, ["depth", "prefix"]).withColumn("side", F.lit(0))
    second = cut.select("fp", F.col("depth").alias("depth2"), F.col("prefix").alias("prefix2")).join(pairs.where("depth <> depth2 or prefix <> prefix2"), ["depth2", "prefix2"]).withColumn("side", F.lit(1))
    members = first.select(*names, "side", "fp").unionByName(second.select(*names, "side", "fp"))
    return members.repartition(*names).sortWithinPartitions(*names, "side").mapInPandas(_linked(budget), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, budget: int = 2, leaf_rows: int = 1 << 19, hot: int = 1000) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the least key reachable by links, the row's own included (nulls
    are passed over; a component with null keys only has a null id).  Rows with equal
    texts share a fingerprint; repeated rows are kept.
    """
    rows = checkpointed(fingerprints(docs, key, text, width))
    nodes = connected_components(fingerprint_links(rows, budget, leaf_rows))
    # One row per distinct fingerprint: its least key, then the least key of its component.
    firsts = checkpointed(rows.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")))
    linked = firsts.join(nodes.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    moved = linked.join(least, "component").select("fp", "least")
    by_fp = checkpointed(firsts.join(moved, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")))
    # Fingerprints of over 1 / hot of all rows (fewer than ``hot`` of them) meet their rows by a broadcast, the others by a shuffle.
    total = rows.count()
    is_hot = F.col("n") * hot > total
    told = rows.join(F.broadcast(by_fp.where(is_hot).select("fp", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot"))), "fp", "left")
    cold = told.where("_is_hot is null").select(key, "fp").join(by_fp.where(~is_hot).select("fp", "component_id"), "fp")
    every = cold.select(key, "fp", "component_id").unionByName(told.where("_is_hot").select(key, "fp", F.col("_hot").alias("component_id")))
    return every.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the least key.

    Rows with a null key all stay, and rows that share the key of one that stays stay with it (a key
    may have several texts; it goes if none of them is its component's first).
    """
    judged = near_duplicates(docs, key, text, **options)
    gone = judged.groupBy(key).agg(F.max(F.col(key) == F.col("component_id")).alias("_first")).where("not _first").select(key)
    return docs.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
