"""Embedding near-duplicates with hierarchical navigable small-world graphs per shard.

Distinct vectors of one label (and length) are hashed into shards of about ``capacity`` vectors (fewer, if these have
more than ``most_values`` components), each with its own graph.  Graphs are written once to the shared folder, and a task for each pair of shards of a
label opens both: the vectors of either are searched in the other's graph, so every vector queries every
shard, and a link found from one end counts for both.  No vector is shuffled more than once.

A search takes a block of queries at a time: it descends the layers, fills a beam, and then floods over
neighbours at or little below the threshold, so its answer isn't capped by the beam.  Each search of a shard audits itself against
brute force: on queries planted at random angles within the threshold around the shard's own vectors, and on a
sample of its real queries.  The beam doubles until recall, query by query and for few and many
links alike, passes; past twice the shard's size it is brute force.  Candidates are verified by cosine in double precision.

Equal vectors are represented once, and tasks return link counts and a spanning forest,
not all pairs, so groups of copies stay linear.  A task holds two shards' graphs and a bit for each of their pairs of vectors.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.simhash import _forest
from nodeloom.llm.storage import checkpointed, fresh_path
from nodeloom.llm.warc import opened
from nodeloom.operators.components import connected_components

#: Candidates within this of the threshold in single precision are verified in double.
SLACK = 1e-4
#: A flood goes on through vectors within this below the threshold: one at the rim of a group may be a neighbour of such ones only.
MARGIN = 0.05
#: Queries searched together.
BLOCK = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Hnsw:
    """A navigable small-world hierarchy over unit vectors (cosine)."""

    def __init__(self, x: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 7):
        self.x, self.degree = np.ascontiguousarray(x, np.float32), degree
        n = len(x)
        self.base = np.full((n, 2 * degree), -1, np.int32)  # neighbours on layer 0
        self.used = np.zeros(n, np.int32)
        self.upper: list[dict[int, list[int]]] = []  # neighbours on layers 1, 2, ..
        heights = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int)
        self.entry, self.seen, self.mark = 0, np.zeros(n, np.int32), 0
        for i in range(n):
            self._insert(i, int(heights[i]), beam)
        self._adopt()
        #: Each upper layer as its sorted nodes and a row of neighbours for each.
        self.layers = []
        for layer in self.upper:
            nodes = np.array(sorted(layer), np.int32)
            rows = np.full((len(nodes), max([1, *map(len, layer.values())])), -1, np.int32)
            for r, node in enumerate(nodes.tolist()):
                rows[r, : len(layer[node])] = layer[node]
            self.layers.append((nodes, rows))

    def parts(self) -> tuple:
        """What a search needs beside the vectors."""
        return self.base, self.layers, self.entry

    @classmethod
    def of(cls, x: np.ndarray, parts: tuple) -> Hnsw:
        index = cls.__new__(cls)
        index.x = np.ascontiguousarray(x, np.float32)
        index.base, index.layers, index.entry = parts
        return index

    def around(self, node: int, layer: int) -> np.ndarray:
        return self.base[node, : self.used[node]] if layer == 0 else np.array(self.upper[layer - 1][node], np.int32)

    def _insert(self, i: int, height: int, beam: int) -> None:
        q = self.x[i]
        top = len(self.upper)
        if i:
            near = [(float(self.x[self.entry] @ q), self.entry)]
            for layer in range(top, height, -1):
                near = self.search_layer(q, near, 1, layer)
            for layer in range(min(height, top), -1, -1):
                near = self.search_layer(q, near, beam, layer)
                chosen = self._diverse(near, self.degree)
                if layer == 0:
                    self.base[i, : len(chosen)] = chosen
                    self.used[i] = len(chosen)
                else:
                    self.upper[layer - 1][i] = list(chosen)
                for j in chosen:
                    self._hang(j, i, layer)
        if height > top:
            self.upper += [{} for _ in range(height - top)]
            self.entry = i
        for layer in range(1, height + 1):
            self.upper[layer - 1].setdefault(i, [])

    def _diverse(self, near: list[tuple[float, int]], k: int) -> list[int]:
        """Of the nearest, those closer to the query than to one chosen before; then the nearest left."""
        near = sorted(near, reverse=True)[: 4 * k]
        ids = np.array([j for _, j in near])
        among = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        for r, (sim, _) in enumerate(near):
            if len(chosen) == k:
                break
            if not chosen or among[r, chosen].max() < sim:
                chosen.append(r)
        chosen += [r for r in range(len(near)) if r not in set(chosen)][: k // 2 - len(chosen)] if len(chosen) < k // 2 else []
        return ids[chosen].tolist()

    def _hang(self, j: int, i: int, layer: int) -> None:
        """Add i to j's neighbours, keeping a diverse set if they are full."""
        if layer == 0:
            if self.used[j] < self.base.shape[1]:
                self.base[j, self.used[j]] = i
                self.used[j] += 1
                return
            ids = np.append(self.base[j], i)
            kept = self._diverse(list(zip((self.x[ids] @ self.x[j]).tolist(), ids.tolist(), strict=True)), self.base.shape[1] - 4)
            self.base[j] = -1
            self.base[j, : len(kept)] = kept
            self.used[j] = len(kept)
        else:
            mine = self.upper[layer - 1].setdefault(j, [])
            mine.append(i)
            if len(mine) > self.degree:
                ids = np.array(mine)
                self.upper[layer - 1][j] = self._diverse(list(zip((self.x[ids] @ self.x[j]).tolist(), mine, strict=True)), self.degree - 2)

    def _adopt(self) -> None:
        """On layer 0, a link to each node that choosing diverse sets has left without one: from the neighbour of its own with most room."""
        led_to = np.zeros(len(self.x), bool)
        led_to[self.base[self.base >= 0]] = True
        for i in np.flatnonzero(~led_to).tolist():
            near = self.base[i, : self.used[i]]
            if not len(near):
                continue
            j = near[self.used[near].argmin()]
            if self.used[j] == self.base.shape[1]:
                self.base = np.concatenate([self.base, np.full((len(self.x), 1), -1, np.int32)], 1)
            self.base[j, self.used[j]] = i
            self.used[j] += 1

    def search_layer(self, q: np.ndarray, starts: list[tuple[float, int]], beam: int, layer: int) -> list[tuple[float, int]]:
        """The nearest nodes found on a layer: (cosine, node), at most ``beam`` (used while building)."""
        self.mark += 1
        seen, mark, x = self.seen, self.mark, self.x
        best = list(starts)
        heapq.heapify(best)
        todo = [(-s, j) for s, j in starts]
        heapq.heapify(todo)
        for _, j in starts:
            seen[j] = mark
        while todo:
            s, node = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= beam:
                break
            near = self.around(node, layer)
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            sims = x[near] @ q
            if len(best) >= beam:
                ok = sims > best[0][0]
                near, sims = near[ok], sims[ok]
            for sim, j in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (sim, j))
                    heapq.heappush(todo, (-sim, j))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, j))
                    heapq.heappush(todo, (-sim, j))
        return best

    def _descend(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node that each query reaches greedily above layer 0, and its cosine."""
        at = np.full(len(q), self.entry)
        sims = q @ self.x[self.entry]
        for nodes, rows in reversed(self.layers):
            going = np.arange(len(q))
            while len(going):
                near = rows[np.searchsorted(nodes, at[going])]
                s = np.einsum("bkd,bd->bk", self.x[near], q[going])
                s[near < 0] = -np.inf
                best = s.argmax(1)
                s, near = s[np.arange(len(going)), best], near[np.arange(len(going)), best]
                better = s > sims[going]
                going = going[better]
                at[going], sims[going] = near[better], s[better]
        return at, sims

    def _beams(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of each query's beam on layer 0; -1 and -inf where it isn't full."""
        n, wide = len(q), min(4, beam)
        ids, sims, unopened = np.full((n, beam), -1), np.full((n, beam), -np.inf, np.float32), np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0] = self._descend(q)
        unopened[:, 0] = True
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), ids[:, 0]] = True
        going = np.arange(n)
        while len(going):
            order = np.where(unopened[going], sims[going], -np.inf)
            top = np.argpartition(-order, wide - 1, axis=1)[:, :wide]
            real = np.take_along_axis(order, top, 1) > -np.inf
            more = real.any(1)
            going, top, real = going[more], top[more], real[more]
            if not len(going):
                break
            unopened[going[:, None], top] = False
            near = np.where(real[:, :, None], self.base[ids[going[:, None], top]], -1).reshape(len(going), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[going[:, None], near]
            r, c = np.nonzero(new)
            node = near[r, c]
            seen[going[r], node] = True
            fresh = np.full(near.shape, -np.inf, np.float32)
            fresh[r, c] = np.einsum("kd,kd->k", self.x[node], q[going[r]])
            every = np.concatenate([sims[going], fresh], 1)
            kept = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[going] = np.take_along_axis(every, kept, 1)
            ids[going] = np.take_along_axis(np.concatenate([ids[going], near], 1), kept, 1)
            unopened[going] = np.take_along_axis(np.concatenate([unopened[going], new], 1), kept, 1) & (sims[going] > -np.inf)
        return ids, sims

    def within(self, q: np.ndarray, floor: float, beam: int) -> np.ndarray:
        """For each query (unit, single precision) and node, whether it was found with cosine >= ``floor``."""
        n = len(self.x)
        ids, sims = self._beams(q, beam)
        found, tried = np.zeros(len(q) * n, bool), np.zeros(len(q) * n, bool)
        row, c = np.nonzero(sims >= floor - MARGIN)
        at = row * n + ids[row, c]
        found[at], tried[at] = sims[row, c] >= floor, True
        # Flood: all neighbours of what is linked or nearly so, until nothing new is.
        while len(at):
            onward = []
            for some in np.array_split(at, len(at) // (1 << 14) + 1):
                near = self.base[some % n].astype(np.int64)
                around = np.where(near >= 0, near + (some // n * n)[:, None], some[:, None]).ravel()
                around = np.unique(around[~tried[around]])
                tried[around] = True
                cosines = np.einsum("kd,kd->k", self.x[around % n], q[around // n])
                found[around[cosines >= floor]] = True
                onward.append(around[cosines >= floor - MARGIN])
            at = np.concatenate(onward)
        return found.reshape(len(q), n)


def _good_recall(shares: np.ndarray, links: np.ndarray, recall: float, worst: float) -> bool:
    """Whether the mean share of links found is at least ``recall`` for queries of each order of link numbers (1, 2-3, 4-7, ..) and no query's is below ``worst``."""
    orders = np.log2(links).astype(int)
    return shares.min() >= worst and all(shares[orders == o].mean() >= recall for o in np.unique(orders))


def planted(x: np.ndarray, threshold: float, number: int, seed: int = 7) -> np.ndarray:
    """Unit queries at random cosines from the threshold to 1 around sampled rows of ``x`` (all linked, if x has a second dimension to turn in)."""
    rng = np.random.default_rng(seed)
    some = x[rng.integers(0, len(x), number)]
    aside = rng.normal(size=some.shape)
    aside -= (aside * some).sum(1, keepdims=True) * some
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    cosine = rng.uniform(min(1.0, threshold + 1e-9), 1, (number, 1))
    return unit(cosine * some + np.sqrt(1 - cosine**2) * aside)


def linked_in_shard(
    index: Hnsw, x: np.ndarray, queries: np.ndarray, threshold: float, beam: int = 32, audited: int = 64, recall: float = 0.999, worst: float = 0.9, own: bool = False
) -> tuple[np.ndarray, int | None]:
    """(bits of a row for each query (unit, double) and a column for each of the shard's vectors at or above ``threshold``; the beam that passed, None for brute force).

    With ``own`` the queries are the shard's vectors; that they find themselves is no evidence of recall.
    """
    floor = threshold - SLACK

    def verified(q: np.ndarray, near: np.ndarray) -> np.ndarray:
        columns = np.flatnonzero(near.any(0))
        near[:, columns] &= q @ x[columns].T >= threshold
        return near

    def searched(q: np.ndarray, beam: int) -> Iterator[np.ndarray]:
        for at in range(0, len(q), BLOCK):
            yield verified(q[at : at + BLOCK], index.within(q[at : at + BLOCK].astype(np.float32), floor, beam))

    sample = np.random.default_rng(7).permutation(len(queries))[: 4 * audited]
    asked = np.concatenate([queries[sample], planted(x, threshold, audited)])
    truth = asked @ x.T >= threshold
    links = truth.sum(1)
    if own:
        links[: len(sample)] -= truth[np.arange(len(sample)), sample]
    asked, truth, itself = asked[links > 0], truth[links > 0], np.append(sample, np.full(audited, -1))[links > 0] if own else None
    links = links[links > 0]
    while len(links) and beam < 2 * len(x):
        found = np.concatenate(list(searched(asked, beam))) & truth
        shares = found.sum(1)
        if own:
            of = np.flatnonzero(itself >= 0)
            shares[of] -= found[of, itself[of]]
        if _good_recall(shares / links, links, recall, worst):
            return np.concatenate([np.packbits(f, axis=1) for f in searched(queries, beam)]), beam
        beam *= 2
    parts = [np.packbits(queries[at : at + BLOCK] @ x.T >= threshold, axis=1) for at in range(0, len(queries), BLOCK)]
    return np.concatenate(parts), None


def united(there: np.ndarray, back: np.ndarray, own: bool, copies: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two shards of n and m vectors from bits n x m and m x n: (links of the n, of the m, least-place labels of all n + m).

    With ``own`` both are one shard: a vector isn't linked with itself, and each pair counts once.
    """
    n, m = len(there), len(back)
    counts, other, parent = np.zeros(n, np.int64), np.zeros(m, np.int64), np.arange(n if own else n + m)
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        both = np.unpackbits(there[at:to], axis=1, count=m).view(bool) | np.unpackbits(back[:, at // 8 : (to + 7) // 8], axis=1, count=to - at).view(bool).T
        if own:
            both[np.arange(to - at), np.arange(at, to)] = False
        counts[at:to] = both @ copies[1]
        if not own:
            other += copies[0][at:to] @ both
        u, v = np.nonzero(both)
        parent = _forest(parent, u + at, v if own else v + n)
    return counts, other, parent


def _cells(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Graphs of the shards that a task meets (sorted), one after another in one file; yields where each is."""
    fs, root = opened(folder)
    path = f"{root}/{uuid.uuid4().hex}"
    state: dict = {"at": 0, "out": None}

    def written(name: tuple, parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts).sort_values(["rep", "hash"], kind="stable")
        x = np.stack(rows["embedding"].to_numpy())
        index = Hnsw(unit(x))
        blob = pickle.dumps((rows["rep"].tolist(), rows["hash"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), x, index.parts()), protocol=5)
        if state["out"] is None:
            fs.create_dir(root, recursive=True)
            state["out"] = fs.open_output_stream(path, compression=None)
        state["out"].write(blob)
        state["at"] += len(blob)
        return pd.DataFrame({"kin": [name[0]], "shard": [name[1]], "path": [path], "at": [state["at"] - len(blob)], "size": [len(blob)]})

    last, parts = None, []
    try:
        for batch in batches:
            for name, part in batch.groupby(["kin", "shard"], sort=False):
                if name != last and parts:
                    yield written(last, parts)
                    parts = []
                last = name
                parts.append(part)
        if parts:
            yield written(last, parts)
    finally:
        if state["out"] is not None:
            state["out"].close()


def _opened_cell(fs, path: str, at: int, size: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, Hnsw]:
    with fs.open_input_file(path) as file:
        file.seek(at)
        reps, hashes, copies, x, parts = pickle.loads(file.read(size))
    x = unit(x)
    return reps, hashes, copies, x, Hnsw.of(x, parts)


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    capacity: int = 32_768,
    most_values: int = 1 << 24,
    least_shards: int = 4,
    beam: int = 32,
    audited: int = 64,
    recall: float = 0.999,
    task_vectors: int = 2048,
) -> DataFrame:
    """``key``, ``n_links``, ``component_id``, ``kept`` (key = component_id), one row per row.

    Rows link if their labels and vector lengths are equal and their cosine is at least ``threshold``.
    A null label or key, a null, empty or zero vector, and null or non-finite components
    link with nothing: 0 links, own component.  A null key has a null component and isn't kept.
    Rows that repeat a key and vector count as one vector; each keeps its own result row.  Rows that repeat a key with
    different vectors are different vectors, each with its own links and component.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("key").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda v: v != 0)
    rows = rows.withColumn("hash", F.when(F.coalesce(good, F.lit(False)), F.xxhash64(e)))
    same = ["hash", "label", "embedding"]
    distinct = rows.where("hash is not null").distinct().groupBy(*same).agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    #: Vectors of one kin (label and length) may link.
    distinct = checkpointed(distinct.withColumn("kin", F.xxhash64("label", F.size("embedding"))))
    few = F.least(F.lit(least_shards), F.ceil(F.col("count") / audited))
    sizes = distinct.groupBy("kin").agg(F.count("*").alias("count"), F.first(F.size("embedding")).alias("dim"))
    full = F.greatest(few, F.ceil(F.col("count") / capacity), F.ceil(F.col("count") * F.col("dim") / most_values))
    sizes = sizes.select("kin", full.cast("int").alias("shards"))
    placed = distinct.join(sizes, "kin").select("kin", "rep", "hash", "copies", "embedding", F.pmod(F.xxhash64("hash", "rep"), "shards").cast("int").alias("shard"))
    spark = vectors.sparkSession
    folder, kind = fresh_path(spark, "hnsw"), placed.schema["rep"].dataType.simpleString()
    tasks = max(1, distinct.count() // task_vectors)
    dealt = placed.repartition(tasks, "kin", "shard").sortWithinPartitions("kin", "shard")
    cells = checkpointed(dealt.mapInPandas(lambda batches: _cells(batches, folder), "kin bigint, shard int, path string, at bigint, size bigint"))
    ends = [cells.select("kin", *[F.col(c).alias(c + side) for c in ("shard", "path", "at", "size")]) for side in "12"]
    pairs = checkpointed(ends[0].join(ends[1], "kin").where("shard1 <= shard2").drop("kin"))
    threshold_, beam_, audited_, recall_ = threshold, beam, audited, recall

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Link counts (a = b, n) and links that connect what was linked (n = 0), of pairs of shards."""
        fs, _ = opened(folder)
        for batch in batches:
            for pair in batch.itertuples():
                reps, hashes, copies, x, index = _opened_cell(fs, pair.path1, pair.at1, pair.size1)
                own = pair.shard1 == pair.shard2
                if own:
                    there, _ = linked_in_shard(index, x, x, threshold_, beam_, audited_, recall_, own=True)
                    counts, _, parent = united(there, there, True, (copies, copies))
                else:
                    reps2, hashes2, copies2, x2, index2 = _opened_cell(fs, pair.path2, pair.at2, pair.size2)
                    there, _ = linked_in_shard(index2, x2, x, threshold_, beam_, audited_, recall_)
                    back, _ = linked_in_shard(index, x, x2, threshold_, beam_, audited_, recall_)
                    counts, other, parent = united(there, back, False, (copies, copies2))
                    reps, hashes, counts = reps + reps2, np.concatenate([hashes, hashes2]), np.concatenate([counts, other])
                moved, linked = np.flatnonzero(parent != np.arange(len(parent))), np.flatnonzero(counts)
                a, b = np.concatenate([moved, linked]), np.concatenate([parent[moved], linked])
                n = np.concatenate([np.zeros(len(moved), np.int64), counts[linked]])
                yield pd.DataFrame({"a": [reps[i] for i in a], "ah": hashes[a], "b": [reps[i] for i in b], "bh": hashes[b], "n": n})

    links = checkpointed(pairs.repartition(max(1, min(10_000, pairs.count()))).mapInPandas(searched, f"a {kind}, ah bigint, b {kind}, bh bigint, n bigint"))
    # A vector is its least key and its hash.
    found = links.select(F.struct("a", "ah").alias("a"), F.struct(F.col("b").alias("a"), F.col("bh").alias("ah")).alias("b"), "n")
    components = connected_components(found.where("n = 0")).select(F.col("node.a").alias("rep"), F.col("node.ah").alias("hash"), F.col("component.a").alias("component"))
    counts = links.where("n > 0").groupBy(F.col("a").alias("rep"), F.col("ah").alias("hash")).agg(F.sum("n").alias("n"))
    reps = distinct.select(*same, "rep", "copies").join(counts, ["rep", "hash"], "left").join(components, ["rep", "hash"], "left")
    # A table of its own, so that the join below is between plain exchanges and Spark can split a hot vector.
    reps = reps.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(checkpointed(reps), same, "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
