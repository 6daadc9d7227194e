"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items become sequences of words (letters, digits and underscores,
lower-cased).  An item of m words has an error budget of k = floor(``error`` * m) word edits
and is split into k + 1 pieces: if a text holds a passage within k edits of the item, one
piece stands in it unchanged.  Windows of words that hash to a piece give candidate places,
and Myers' bit-parallel distance (words as symbols) verifies each.

An item may be cut anywhere, so of a few cuts the one is taken whose pieces fewest items share: a
phrase that many items have in common makes few candidates.

A benchmark of at most ``block_words`` words (all usual ones) is broadcast, and a worker builds its tables once.  A larger one stays a table of pieces
(width, hash, item, place): one pass over the texts hashes their words and windows and keeps the windows that a broadcast table of
2^26 bits lets through, these meet the pieces by join, and the passages around candidates meet their items for Myers' check.  So
a benchmark of any size needs one pass and bounded memory.  Items without words (null, empty, punctuation) match nothing, nor do null or empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.storage import checkpointed, small_side, unused_name
from nodeloom.llm.wordhash import JOIN, joined, mixed, text_words, words_of

#: Bits of the table that most windows are dismissed by.
TABLE_BITS = 20
#: Bits, as a power of two, of the one broadcast table of a benchmark that isn't broadcast itself: 8 MB.
FILTER_BITS = 26


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    h = words[: len(words) - width + 1]
    for i in range(1, width):
        h = joined(h, words[i : len(words) - width + 1 + i])
    return h


def windows_of(words: np.ndarray, widths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """``window_hashes`` of each of some widths that the text has, shortest first: a wider window's hash is made of the next narrower one's."""
    wanted, h = sorted(w for w in widths if w <= len(words)), words
    if not wanted:
        return
    each = mixed(words)
    for width in range(1, wanted[-1] + 1):
        if width > 1:
            with np.errstate(over="ignore"):
                h = mixed(h[:-1] * JOIN + each[width - 1 :])
        if width in wanted:
            yield width, h


def best_match(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least edits between the whole item and a run of the window, and that run's last index.

    Myers' bit vectors over whole Python integers, free start and end in the window.
    """
    m = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, -1
    for j, w in enumerate(window.tolist()):
        eq = at.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1 & full, left << 1 & full  # free start: no carry into row 0
        up, down = left | ~((eq | down) | right) & full, right & (eq | down)
        if score < best:
            best, end = score, j
    return best, end


def cuts(m: int, pieces: int) -> list[list[int]]:
    """A few ways to cut m words into ``pieces`` (at most m) runs of a word at least: even ones, and some with a shorter or longer first run."""
    even = [m * i // pieces for i in range(pieces + 1)]
    out = [even]
    if pieces > 1:
        for shift in (-(-m // pieces) // 2, 1, -1):
            moved = [0, *(b + shift for b in even[1:-1]), m]
            if all(a < b for a, b in zip(moved, moved[1:])) and moved not in out:
                out.append(moved)
    return out


class Pieces:
    """Pieces of a block of items, by width."""

    def __init__(self, items: list[tuple], error: float):
        self.items, ways = [], []
        shared: dict[tuple[int, int], int] = {}
        for item_id, text in items:
            words = text_words(text)
            if not len(words):
                continue
            k = int(error * len(words) + 1e-9)
            hashes = {}  # by width: of each run of the item's words
            of_item = []
            for bounds in cuts(len(words), k + 1):
                way = []
                for start, stop in zip(bounds, bounds[1:]):
                    if stop - start not in hashes:
                        hashes[stop - start] = window_hashes(words, stop - start)
                    way.append((stop - start, int(hashes[stop - start][start]), start))
                of_item.append(way)
            for piece in {(width, h) for way in of_item for width, h, _ in way}:
                shared[piece] = shared.get(piece, 0) + 1
            self.items.append((item_id, words, k))
            ways.append(of_item)
        by_width: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, of_item in enumerate(ways):
            for width, h, start in min(of_item, key=lambda way: sum(shared[w, h] for w, h, _ in way)):
                by_width.setdefault(width, {}).setdefault(h, []).append((i, start))
        self.by_width = by_width
        self.tables = {}
        for width, places in by_width.items():
            table = np.zeros(1 << TABLE_BITS, bool)
            table[np.array(list(places), np.uint64) & np.uint64((1 << TABLE_BITS) - 1)] = True
            self.tables[width] = table

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, first word, end word, edits), the best place of each item found."""
        words = text_words(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried = set()
        for width, h in windows_of(words, self.tables):
            table = self.tables[width]
            for i in np.flatnonzero(table[h & np.uint64((1 << TABLE_BITS) - 1)]).tolist():
                for item, start in self.by_width[width].get(int(h[i]), ()):
                    diagonal = i - start
                    if (item, diagonal) in tried:
                        continue
                    tried.add((item, diagonal))
                    _, pattern, k = self.items[item]
                    lo, hi = max(0, diagonal - k), diagonal + len(pattern) + k
                    edits, end = best_match(pattern, words[lo:hi])
                    if edits <= k and (item not in best or (edits, lo + end) < (best[item][0], best[item][2])):
                        best[item] = (edits, max(lo, lo + end + 1 - len(pattern)), lo + end)
        return [(self.items[i][0], first, end + 1, edits) for i, (edits, first, end) in sorted(best.items())]


_last: list = []


def pieces_of(block: list[tuple], error: float) -> Pieces:
    """The block's pieces; a worker keeps those that it made last."""
    if not _last or _last[0] is not block or _last[1] != error:
        _last[:] = [block, error, Pieces(block, error)]
    return _last[2]


def benchmark_block(benchmark: DataFrame, item: str, text: str, block_words: int) -> list[tuple] | None:
    """The different items, streamed to the driver; None as soon as they have more than ``block_words`` words."""
    block, words = [], 0
    for row in benchmark.select(F.col(item), F.col(text)).where(F.col(text).isNotNull()).distinct().toLocalIterator(prefetchPartitions=True):
        block.append((row[0], row[1]))
        words += len(words_of(row[1]))
        if words > block_words:
            return None
    return block


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", error: float = 0.2, block_words: int = 2_000_000) -> DataFrame:
    """One row per document and item found in it: ``key``, ``item_id``, ``first_word``, ``end_word``, ``edits``.

    ``first_word`` .. ``end_word`` (words from 0, end exclusive; the start is the end less the
    item's length) is the best place; of equal places, the first.
    Repeated rows give repeated matches; an empty benchmark or table gives no rows.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType, benchmark.schema[item].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    block = benchmark_block(benchmark, item, item_text, block_words)
    if block is None:
        found = _joined_matches(rows, benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")), error)
        return rows.select(F.col("key").alias(key), F.md5("text").alias("_text")).join(found, "_text").drop("_text")
    schema = f"key {kind.simpleString()}, item_id {item_kind.simpleString()}, first_word int, end_word int, edits int"
    shared = spark.sparkContext.broadcast(block)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        pieces = pieces_of(shared.value, error)
        for batch in batches:
            keys, hits = [], []
            for i, t in enumerate(batch.column(1)):
                for hit in pieces.matches(t.as_py()):
                    keys.append(i)
                    hits.append(hit)
            ids, first, end, edits = zip(*hits) if hits else ((), (), (), ())
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(ids, to_arrow_type(item_kind)), *(pa.array(c, pa.int32()) for c in (first, end, edits))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "item_id", "first_word", "end_word", "edits"])

    return rows.mapInArrow(found, schema).withColumnRenamed("key", key)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", error: float = 0.2, block_words: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; unless the benchmark is too large to broadcast, nothing is shuffled."""
    block = benchmark_block(benchmark, item, item_text, block_words)
    if block is not None:
        return docs.where(_clean_of(docs.sparkSession.sparkContext.broadcast(block), error)(F.col(text)))
    found = _joined_matches(docs.select(F.col(text).alias("text")), benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")), error)
    name = unused_name(docs, "_text")
    dirty = small_side(checkpointed(found.select(F.col("_text").alias(name)).distinct()))
    return docs.withColumn(name, F.md5(text)).join(dirty, name, "left_anti").drop(name)


def _clean_of(shared, error: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        pieces = pieces_of(shared.value, error)
        return pd.Series([not pieces.matches(t) for t in texts], dtype=bool)

    return clean


def _piece_rows(benchmark: DataFrame, error: float) -> tuple[DataFrame, DataFrame]:
    """(items: item, item_id, words, k; pieces: width, hash, item, start) of a benchmark of any size, each item cut where its pieces are shared least."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words_out, ks, ways = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                words = text_words(t.as_py())
                if not len(words):
                    continue
                k = int(error * len(words) + 1e-9)
                hashes: dict[int, np.ndarray] = {}
                at.append(i)
                words_out.append(words.view(np.int64))
                ks.append(k)
                of_item = []
                for bounds in cuts(len(words), k + 1):
                    for width in {b - a for a, b in zip(bounds, bounds[1:])} - hashes.keys():
                        hashes[width] = window_hashes(words, width).view(np.int64)
                    of_item.append([{"width": b - a, "hash": int(hashes[b - a][a]), "start": a} for a, b in zip(bounds, bounds[1:])])
                ways.append(of_item)
            piece = pa.struct([("width", pa.int32()), ("hash", pa.int64()), ("start", pa.int32())])
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(words_out, pa.list_(pa.int64())), pa.array(ks, pa.int32()), pa.array(ways, pa.list_(pa.list_(piece)))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "k", "ways"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where("text is not null").distinct().mapInArrow(cut, f"item_id {kind}, words array<bigint>, k int, ways array<array<struct<width:int,hash:bigint,start:int>>>")
    # Rows that share an id and a text are one; an id with several texts keeps them apart by their words.
    items = checkpointed(rows.withColumn("item", F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.concat_ws(",", F.col("words").cast("array<string>"))))))
    ways = items.select("item", F.posexplode("ways").alias("way", "pieces")).select("item", "way", F.explode("pieces").alias("p")).select("item", "way", "p.*")
    shared = ways.select("item", "width", "hash").distinct().groupBy("width", "hash").agg(F.count("*").alias("n"))
    best = ways.join(shared, ["width", "hash"]).groupBy("item", "way").agg(F.sum("n").alias("n")).groupBy("item").agg(F.min(F.struct("n", "way")).alias("b")).select("item", F.col("b.way").alias("way"))
    return items.drop("ways"), checkpointed(ways.join(best, ["item", "way"]).select("width", "hash", "item", "start").distinct())


def _joined_matches(rows: DataFrame, benchmark: DataFrame, error: float) -> DataFrame:
    """``_text`` (MD5 of a text), ``item_id``, ``first_word``, ``end_word``, ``edits``: the best place of each item found in each different text."""
    spark = rows.sparkSession
    items, pieces = _piece_rows(benchmark, error)
    at = F.expr(f"hash & {(1 << FILTER_BITS) - 1}") + 1  # numbers of bitmaps begin at 1
    bitmaps = pieces.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for b, part in bitmaps.toLocalIterator():  # 8 MB in all
        bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(part, np.uint8)
    widths = sorted(r["width"] for r in pieces.select("width").distinct().collect())  # as many as item lengths over budgets give: some ten
    shared = spark.sparkContext.broadcast(bits)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        hit = pa.struct([("width", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())])
        for batch in batches:
            keys, words_out, hits = [], [], []
            for i, t in enumerate(batch.column(1)):
                words, of_text = text_words(t.as_py()), []
                for width, h in windows_of(words, widths):
                    low = h & np.uint64((1 << FILTER_BITS) - 1)
                    passed = np.flatnonzero(bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                    of_text.extend({"width": width, "hash": v, "at": p} for v, p in zip(h[passed].view(np.int64).tolist(), passed.tolist()))
                if of_text:
                    keys.append(i)
                    words_out.append(words.view(np.int64))
                    hits.append(of_text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(words_out, pa.list_(pa.int64())), pa.array(hits, pa.list_(hit))], names=["_text", "words", "hits"])

    hashed = rows.where("text is not null").select(F.md5("text").alias("_text"), "text").mapInArrow(windows, "_text string, words array<bigint>, hits array<struct<width:int,hash:bigint,at:int>>")
    hashed = checkpointed(hashed.dropDuplicates(["_text"]))
    places = hashed.select("_text", F.explode("hits").alias("h")).select("_text", "h.*").join(pieces, ["width", "hash"]).select("_text", "item", (F.col("at") - F.col("start")).alias("diagonal")).distinct()
    # Patterns join first: of a text's words only the passage around the place goes on.
    placed = places.join(items.select("item", "item_id", F.col("words").alias("pattern"), "k"), "item")
    low = F.greatest(F.lit(0), F.col("diagonal") - F.col("k"))
    passage = F.slice("words", low + 1, F.col("diagonal") + F.size("pattern") + F.col("k") - low)
    tried = placed.join(hashed.select("_text", "words"), "_text").select("_text", "item", "item_id", "pattern", "k", low.alias("low"), passage.alias("passage"))

    @F.pandas_udf("edits int, last int")
    def compared(patterns: pd.Series, passages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_match(p, w) for p, w in zip(patterns, passages)], columns=["edits", "last"])

    met = tried.withColumn("m", compared("pattern", "passage")).where("m.edits <= k")
    first = F.greatest(F.col("low"), F.col("low") + F.col("m.last") + 1 - F.size("pattern"))
    best = met.groupBy("_text", "item", "item_id").agg(F.min(F.struct(F.col("m.edits").alias("edits"), (F.col("low") + F.col("m.last") + 1).alias("end"), first.cast("int").alias("first"))).alias("b"))
    return best.select("_text", "item_id", F.col("b.first").alias("first_word"), F.col("b.end").cast("int").alias("end_word"), "b.edits")
