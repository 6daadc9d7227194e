"""Bigram language model whose counts sit, quantised, in log-frequency Bloom filters.

Tokens: words between ASCII white space with A-Z lower-cased, then one end token.  A null
text is empty (its only token is the end).

Every word and bigram of every training text is counted, and every bigram is in a filter.  A filter
holds, for a bigram of count c, the keys (bigram, 1) .. (bigram, q), where q is the number of
``scale`` values that c reaches; a count is read back by probing level after level until one is
missing, and reads as the least count of its last level, so never above the true one (but for false positives).

With N training tokens, an n-gram is *frequent* if it occurs at least N / ``max_entries`` times: by
arithmetic at most ``max_entries`` words and as many bigrams, at any input size.  Frequent words (exact
counts, 16 bytes each) and the filter of frequent bigrams (1.5 bytes a level) are broadcast, which bounds what is broadcast
at 16 * ``max_entries`` bytes and a sixth of that.  All other bigrams have their filter in segments, one for each hash
shard of about ``shard_tokens`` training tokens; probes of what the broadcast filter doesn't hold
are sent to their segment, packed by ``FLUSH`` tokens of texts, and answers return, packed too, as one sum a text.  A bigram with
a rare word lies in that word's shard (the second's, if both are rare), where the exact counts of the shard's rare
words are; of two rare words, the segment holds the first one's count too, quantised upwards.

Score of a token w after v: P(w | v) = (1 - ``share``) * P1(w) + ``share`` * c(v, w) / c(v), with
P1(w) = (c(w) + 1) / (N + V + 1), where V words and one for all unseen ones share the mass; P(w | v) = P1(w) for
a text's first token and after a word never seen.  As counts read low, the sum of P(. | v) over all
words is 1 - ``share`` * (c(v) - sum of read counts of v's bigrams) / c(v): at least 1 - ``share`` / 3 at the scale's steps of 1.5.

Words are identified by XXH64 (two of a million distinct words share one with odds of 3e-8), bigrams
by their shard and 32 bits (in a shard of four million, one of a thousand shares them with another).
Equal texts have equal scores.  Rows that are scored are told apart by 64 bits of key and text: of n rows, n^2 / 3.7e19 pairs are expected to share
them and then to come back as copies of one of the two (none at 1e8 rows, some 270 pairs at 1e11).

Shards hold ``SHARD_TOKENS`` training tokens until there are ``GROWN_FROM`` of them; in a larger corpus they grow with it up to ``MOST_SHARD_TOKENS``,
so that a flush still has several probes for each.  A Spark partition holds one shard, or several one after another where there are more than ``MOST_PARTITIONS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.storage import checkpointed
from nodeloom.llm.wordhash import ascii_words, joined, mixed, word_hashes

END = np.uint64(0x454E44)
PROBES, BITS_PER_KEY = 5, 12
#: Tokens gathered before they are counted or looked up.
FLUSH = 1 << 20
SHARD_TOKENS, GROWN_FROM, MOST_SHARD_TOKENS = 1 << 22, 1 << 12, 1 << 26
MOST_PARTITIONS = 1 << 14
LOW = np.uint64(0xFFFFFFFF)
#: Steps of a factor's natural logarithm in a request (16 bits, to 0.1 %).
STEPS = 512
#: Kinds of a shard's rows, in the order in which a task reads them: its two filters, its rare words, requests, and rows that pass through.
COUNTS, CONTEXTS, WORDS, REQUEST, PASSED = 0, 1, 2, 3, 4
#: Kinds that only training sees: frequent bigrams, and contexts of two rare words.
FREQUENT, RARE_PAIRS = 5, 6
#: What a request asks for: a bigram by which of its words are rare, or (a rare first word) a word alone; 0: nothing.
NONE_RARE, SECOND_RARE, FIRST_RARE, BOTH_RARE, WORD_ALONE = 1, 2, 3, 4, 5


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, and the end token."""
    return np.append(word_hashes(ascii_words(text)), END)


def scale(least: int, most: int, base: float) -> np.ndarray:
    """The least count of each level: ``least`` times powers of ``base``, rounded up, until one is above ``most``."""
    top = int(log(max(most, least) / least) / log(base) + 1e-9) + 2
    return np.unique(np.ceil(least * base ** np.arange(top) - 1e-9).astype(np.int64))


class LogFrequencyFilter:
    """Bits of (key, level) pairs and the scale of the levels."""

    def __init__(self, bits: np.ndarray, levels: np.ndarray):
        self.bits, self.levels = bits, levels

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, least: int, base: float) -> LogFrequencyFilter:
        """A filter of distinct keys with counts of at least ``least``."""
        levels = scale(least, int(counts.max(initial=least)), base)
        q = np.searchsorted(levels, counts, "right")
        size = ceil(int(q.sum()) * BITS_PER_KEY / 8) * 8
        bits = np.zeros(size, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            held = keys[q >= level]
            for start in range(0, len(held), FLUSH // 4):
                for at in cls._places(held[start : start + FLUSH // 4], level, size):
                    bits[at] = True
        return cls(np.packbits(bits, bitorder="little"), levels)

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h = mixed(keys + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level))
        low, step = h & LOW, h >> np.uint64(32) | np.uint64(1)
        for i in range(PROBES):
            yield ((low + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The last level held of each key (0: none), by repeated membership probes."""
        out, going, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(self.bits) and len(going) and j <= len(self.levels):
            there = np.ones(len(going), bool)
            for at in self._places(keys[going], j, len(self.bits) * 8):
                there &= self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            going = going[there]
            out[going] = j
            j += 1
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts rounded down to the scale (0: not held)."""
        return np.concatenate(([0], self.levels))[self.level(keys)].astype(float)

    def counts_above(self, keys: np.ndarray) -> np.ndarray:
        """Counts rounded up to the last of their level (0: not held)."""
        return np.concatenate(([0], self.levels[1:] - 1, self.levels[-1:]))[self.level(keys)].astype(float)

    def packed(self) -> tuple[bytes, bytes]:
        return self.bits.tobytes(), self.levels.tobytes()

    @classmethod
    def unpacked(cls, bits: bytes, levels: bytes) -> LogFrequencyFilter:
        return cls(np.frombuffer(bits, np.uint8), np.frombuffer(levels, np.int64))


EMPTY = LogFrequencyFilter(np.zeros(0, np.uint8), np.zeros(0, np.int64))


class Model:
    """A training corpus: ``frequent`` (sorted words, counts) and ``counts`` are bounded; ``segments`` is a DataFrame of (shard, kind, a, b)."""

    def __init__(self, n: int, v: int, frequent: tuple[np.ndarray, np.ndarray], counts: LogFrequencyFilter, share: float, segments: DataFrame, shards: int):
        self.n, self.v, self.frequent, self.counts, self.share, self.segments, self.shards = n, v, frequent, counts, share, segments, shards


def gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches with the tokens of all their texts, and each text's number of tokens, when about ``FLUSH`` tokens have come."""
    some, texts, size = [], [], 0
    for batch in batches:
        start = 0
        for i, t in enumerate(batch.column(text)):
            texts.append(tokens(t.as_py()))
            size += len(texts[-1])
            if size >= FLUSH:
                some.append(batch.slice(start, i + 1 - start))
                yield some, np.concatenate(texts), np.array([len(h) for h in texts])
                some, texts, size, start = [], [], 0, i + 1
        if start < batch.num_rows:
            some.append(batch.slice(start))
    if texts:
        yield some, np.concatenate(texts), np.array([len(h) for h in texts])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, h, _ in gathered(batches, 0):
        keys, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "c"])


def _codes(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash is in the sorted known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h.view(np.int64)), len(known) - 1)
    return at, known[at] == h.view(np.int64)


def _times(h: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of hashes among the sorted known ones, 0 for others."""
    at, ok = _codes(h, known[0])
    return np.where(ok, known[1][at], 0) if len(known[1]) else np.zeros(len(h), np.int64)


def shard_of(pair: np.ndarray, v: np.ndarray, w: np.ndarray, v_rare: np.ndarray, w_rare: np.ndarray, shards: int) -> np.ndarray:
    """A bigram's shard: that of its rare word (the second, if both are), else its own."""
    return ((np.where(w_rare, w, np.where(v_rare, v, pair)) & LOW) % np.uint64(shards)).astype(np.int64)


def _split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that occur, each with where it does, in order."""
    if not len(shard):
        return iter(())
    order = np.argsort(shard, kind="stable")
    ids, first = np.unique(shard[order], return_index=True)
    return zip(ids.tolist(), np.split(order, first[1:]), strict=True)


def squeezed(fp: np.ndarray) -> bytes:
    """Sorted 32-bit numbers, by their differences."""
    return zlib.compress(np.diff(fp, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def expanded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


PAIRS = pa.schema([("shard", pa.int32()), ("fp", pa.binary()), ("c", pa.binary()), ("v", pa.binary())])


def _packed_pairs(words, shards: int):
    """Counted bigrams of a task's texts, packed by shard: 32 bits and counts, and (two rare words) the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value[0]
        for _, h, sizes in gathered(batches, 0):
            rare = ~_codes(h, known)[1]
            second = np.delete(np.arange(len(h)), np.cumsum(sizes) - sizes)
            pair, at, c = np.unique(joined(h[second - 1], h[second]), return_index=True, return_counts=True)
            at = second[at]
            v, w, v_rare, w_rare = h[at - 1], h[at], rare[at - 1], rare[at]
            shard, fp, both = shard_of(pair, v, w, v_rare, w_rare, shards), (pair >> np.uint64(32)).astype(np.uint32), v_rare & w_rare
            rows = []
            for is_both in (False, True):
                of = np.flatnonzero(both == is_both)
                for s, i in _split(shard[of]):
                    i = of[i]
                    rows.append({"shard": s, "fp": squeezed(fp[i]), "c": c[i].astype(np.int32).tobytes(), "v": v[i].tobytes() if is_both else b""})
            if rows:
                yield _batch(rows, PAIRS)

    return run


SEGMENT = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
SEGMENT_DDL = "shard int, kind int, a binary, b binary"


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one shard after another; they arrive sorted by shard."""
    shard, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard and rows:
                yield shard, rows
                rows = []
            shard = row["shard"]
            rows.append(row)
    if rows:
        yield shard, rows


def _joined_bytes(rows: list[dict], name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def _segments(least: int, base: float):
    """A shard's filter, its frequent bigrams, and the bigrams of two rare words with the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            # Sorted in place as fp and count together, so that a shard needs little memory.
            each = np.concatenate([expanded(r["fp"]) for r in rows]).astype(np.uint64) << np.uint64(32) | _joined_bytes(rows, "c", np.uint32)
            each.sort()
            start = np.flatnonzero(np.diff(each >> np.uint64(32), prepend=np.uint64(1 << 32)))
            fp, c = (each[start] >> np.uint64(32)).astype(np.uint32), np.add.reduceat((each & LOW).astype(np.int64), start)
            del each, start
            top = c >= least
            key = np.uint64(shard) << np.uint64(32) | fp.astype(np.uint64)
            bits, levels = LogFrequencyFilter.of(key[~top], c[~top], 1, base).packed()
            out = [{"shard": shard, "kind": COUNTS, "a": bits, "b": levels}]
            if top.any():
                out.append({"shard": shard, "kind": FREQUENT, "a": key[top].tobytes(), "b": c[top].tobytes()})
            if two := [r for r in rows if r["v"]]:
                fp, at = np.unique(np.concatenate([expanded(r["fp"]) for r in two]), return_index=True)
                out.append({"shard": shard, "kind": RARE_PAIRS, "a": fp.tobytes(), "b": _joined_bytes(two, "v", np.uint64)[at].tobytes()})
            yield _batch(out, SEGMENT)

    return run


def _rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fp = np.frombuffer(row["a"], np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), row["shard"], np.int32)), pa.array(fp.astype(np.int64)), pa.array(np.frombuffer(row["b"], np.int64))], names=["shard", "fp", "v"])


def _contexts(base: float):
    """A shard's filter of the first word's count of bigrams of two rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            fp, c = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (1, 2))
            bits, levels = LogFrequencyFilter.of(np.uint64(shard) << np.uint64(32) | fp.astype(np.uint64), c, 1, base).packed()
            return _batch([{"shard": shard, "kind": CONTEXTS, "a": bits, "b": levels}], SEGMENT)

        last, parts = None, []
        for batch in batches:
            for shard, at in _split(batch.column(0).to_numpy()):
                if shard != last and parts:
                    yield made(last, parts)
                    parts = []
                last = shard
                parts.append(batch.slice(at[0], len(at)))
        if parts:
            yield made(last, parts)

    return run


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rare words packed by shard, about a million at a time."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard, h, c = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(3))
        return _batch([{"shard": s, "kind": WORDS, "a": h[at].tobytes(), "b": c[at].tobytes()} for s, at in _split(shard)], SEGMENT)

    parts, size = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            size += batch.num_rows
        if size >= FLUSH:
            yield packed(parts)
            parts, size = [], 0
    if parts:
        yield packed(parts)


def _shard(h: str | Column, shards: int) -> Column:
    return (F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)) % shards).cast("int")


def grown_shard(n: int) -> int:
    """Training tokens of a shard, of ``n`` in all."""
    return min(MOST_SHARD_TOKENS, max(SHARD_TOKENS, n // GROWN_FROM))


def by_shards(df: DataFrame, shards: int, most: int = MOST_PARTITIONS) -> DataFrame:
    """Rows dealt out so that a partition holds whole shards."""
    partitions = min(shards, most)
    return df.repartitionById(partitions, F.col("shard") % partitions)


def train(docs: DataFrame, text: str = "text", max_entries: int = 1 << 21, base: float = 1.5, share: float = 0.2, shard_tokens: int | None = None) -> Model:
    """The model of all texts of ``docs``; an empty table gives N = V = 0.  ``shard_tokens`` fixes the size of a shard."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    words = checkpointed(texts.mapInArrow(_word_counts, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least, shards = max(1, ceil(n / max_entries)), max(1, ceil(n / (shard_tokens or grown_shard(n))))
    top = words.where(F.col("c") >= least).toPandas().sort_values("h")  # at most max_entries rows
    frequent = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    rare = words.where(F.col("c") < least).select(_shard("h", shards).alias("shard"), "h", "c")
    shared = spark.sparkContext.broadcast(frequent)

    def dealt(df: DataFrame) -> DataFrame:
        return by_shards(df, shards).sortWithinPartitions("shard")

    packed = texts.mapInArrow(_packed_pairs(shared, shards), "shard int, fp binary, c binary, v binary")
    made = checkpointed(dealt(packed).mapInArrow(_segments(least, base), SEGMENT_DDL))
    # Of two rare words, the first one's count comes by a join (no word of it is hot: each occurs less than N / max_entries times).
    two = made.where(F.col("kind") == RARE_PAIRS).select("shard", "a", "b").mapInArrow(_rare_pairs, "shard int, fp bigint, v bigint")
    met = two.join(rare.select(F.col("h").alias("v"), "c"), "v").select("shard", "fp", "c")
    contexts = checkpointed(dealt(met).mapInArrow(_contexts(base), SEGMENT_DDL))
    many = made.where(F.col("kind") == FREQUENT).select("a", "b").toPandas()  # at most max_entries bigrams
    keys, counts = (np.frombuffer(b"".join(many[c]), kind) for c, kind in (("a", np.uint64), ("b", np.int64)))
    segments = made.where(F.col("kind") == COUNTS).unionByName(contexts).unionByName(rare.mapInArrow(_packed_words, SEGMENT_DDL))
    return Model(n, v, frequent, LogFrequencyFilter.of(keys, counts, least, base), share, segments, shards)


def _requests(h: np.ndarray, sizes: np.ndarray, ids: np.ndarray, model: tuple) -> tuple[list[dict], tuple[np.ndarray, ...]]:
    """(a request to each shard that texts' tokens need, and for each text: known tokens, base and gain as far as broadcast counts tell)."""
    known, counts, total, share, shards = model
    row, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    c = _times(h, known)
    rare = c == 0
    base = np.where(rare, 0.0, np.log10(c + 1.0))
    # A token and the one before it; a first token has none.
    before = np.concatenate(([0], np.arange(len(h) - 1)))
    starts = np.zeros(len(h), bool)
    starts[first] = True
    v_rare = rare[before] & ~starts
    pair = joined(h[before], h)
    shard = shard_of(pair, h[before], h, v_rare, rare, shards)
    pair >>= np.uint64(32)
    # log of the factor of c(v, w) in its share of P(w | v) over that of P1(w), without what only a shard knows.
    factor = log(share / (1 - share) * total) - np.where(v_rare, 0.0, np.log(np.maximum(c[before], 1))) - np.where(rare, 0.0, np.log(c + 1.0))
    kind = np.where(starts, np.where(rare, WORD_ALONE, 0), np.where(rare, np.where(v_rare, BOTH_RARE, SECOND_RARE), np.where(v_rare, FIRST_RARE, NONE_RARE))).astype(np.uint8)
    both = np.flatnonzero(kind == NONE_RARE)
    keys, back = np.unique(shard[both].astype(np.uint64) << np.uint64(32) | pair[both], return_inverse=True)
    seen = np.minimum(counts.counts(keys)[back], c[before[both]])
    kind[both[seen > 0]] = 0
    gain = np.bincount(row[both], np.log10(1 + seen * np.exp(factor[both])), len(sizes)).astype(float)
    out, asked = [], np.flatnonzero(kind)
    for s, at in _split(shard[asked]):
        at = asked[at]  # in the order of texts
        texts, start = np.unique(row[at], return_index=True)
        kinds, worded = kind[at], at[kind[at] != NONE_RARE]
        columns = {
            "ids": ids[texts],
            "sizes": np.diff(np.append(start, len(at))).astype(np.int32),
            "a": kinds,
            "b": pair[at].astype(np.uint32),
            "steps": np.rint(factor[at] * STEPS).astype(np.int16),
            "word": np.where(rare[worded], h[worded], h[before[worded]]),
        }
        out.append({"shard": s, "kind": REQUEST, **{n: x.tobytes() for n, x in columns.items()}})
    return out, (np.bincount(row, ~rare, len(sizes)), np.bincount(row, base, len(sizes)), gain)


def _answer(row: dict, counts: LogFrequencyFilter, contexts: LogFrequencyFilter, words: tuple[np.ndarray, np.ndarray]) -> dict:
    """One request's sums by text: ids and gains where there are any, and ids, known tokens and base where a rare word is known."""
    ids, sizes, kind = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["a"], np.uint8)
    times = np.zeros(len(kind), np.int64)
    times[kind != NONE_RARE] = _times(np.frombuffer(row["word"], np.uint64), words)
    of_word = np.where(kind == FIRST_RARE, 0, times)
    key = np.uint64(row["shard"]) << np.uint64(32) | np.frombuffer(row["b"], np.uint32).astype(np.uint64)
    seen = np.where(kind == WORD_ALONE, 0.0, counts.counts(key))
    before = np.where(kind == FIRST_RARE, times, 1.0)
    two = np.flatnonzero(kind == BOTH_RARE)
    before[two] = contexts.counts_above(key[two])
    less = (kind == FIRST_RARE) | (kind == BOTH_RARE)
    seen = np.where(less, np.minimum(seen, before) / np.maximum(before, 1), seen) / (of_word + 1.0)
    gain = np.log10(1 + seen * np.exp(np.frombuffer(row["steps"], np.int16).astype(float) / STEPS))
    start = np.cumsum(sizes) - sizes
    gain, known, base = (np.add.reduceat(x, start) for x in (gain, (of_word > 0).astype(np.int32), np.log10(of_word + 1.0)))
    has_gain, has_word = gain > 0, known > 0
    packed = {"ids": ids[has_gain], "a": gain[has_gain].astype(np.float32), "word": ids[has_word], "sizes": known[has_word].astype(np.int32), "b": base[has_word]}
    return {"tag": row["tag"], "kind": REQUEST, **{n: x.tobytes() for n, x in packed.items()}}


OWN = ("key", "id", "copies", "n_tokens", "n_known", "base", "gain")


def _sums(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    """Answers of one tag as a row for each text."""
    of = {n: np.frombuffer(b"".join(r[n] for r in rows), kind) for n, kind in (("ids", np.int64), ("a", np.float32), ("word", np.int64), ("sizes", np.int32), ("b", np.float64))}
    ids, at = np.unique(np.concatenate([of["ids"], of["word"]]), return_inverse=True)
    gained, worded, n = at[: len(of["ids"])], at[len(of["ids"]) :], len(ids)
    zeros = pa.array(np.zeros(n, np.int64))
    known, base, gain = np.bincount(worded, of["sizes"], n).astype(np.int64), np.bincount(worded, of["b"], n).astype(float), np.bincount(gained, of["a"], n).astype(float)
    return pa.RecordBatch.from_arrays([pa.nulls(n, like.field("key").type), pa.array(ids), zeros, zeros, pa.array(known), pa.array(base), pa.array(gain)], schema=pa.schema([like.field(c) for c in OWN]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    Base: sum over tokens of log10((c + 1) / (N + V + 1)) with exact counts.  Repeated rows
    (equal key and text) are kept; rows are told apart by a 64-bit hash of key and text.
    """
    n, v, share, shards = model.n, model.v, model.share, model.shards
    total = n + v + 1
    shared = docs.sparkSession.sparkContext.broadcast((model.frequent, model.counts, total, share, shards))
    key_type = docs.schema[key].dataType.simpleString()
    own_ddl = f"key {key_type}, id bigint, copies bigint, n_tokens bigint, n_known bigint, base double, gain double"
    packed_ddl = "shard int, kind int, tag bigint, a binary, b binary, steps binary, word binary, ids binary, sizes binary"
    packed = [c.split()[0] for c in packed_ddl.split(", ")]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests, and for each text a row that passes its shard unchanged."""
        from pyspark import TaskContext

        flush = 0
        for some, h, sizes in gathered(batches, 2):
            # Answers to one flush are summed together; that is all the tag is for, so it may differ if the task runs again.
            tag = (TaskContext.get().partitionId() << 32) + flush
            flush += 1
            keys = pa.concat_arrays([b.column(0) for b in some])
            ids = np.concatenate([b.column(1).to_numpy() for b in some])
            rows, (known, base, gain) = _requests(h, sizes, ids, shared.value)
            m = len(sizes)
            columns = {"shard": np.full(m, tag % shards, np.int32), "kind": np.full(m, PASSED, np.int32), "tag": np.full(m, tag)}
            own = [keys, *map(pa.array, (ids, np.ones(m, np.int64), sizes, known.astype(np.int64), base, gain))]
            own = [*(pa.array(columns[c]) if c in columns else pa.nulls(m, pa.binary()) for c in packed), *own]
            schema = pa.schema([pa.field(c, a.type) for c, a in zip((*packed, *OWN), own, strict=True)])
            yield pa.RecordBatch.from_arrays(own, schema=schema)
            if rows:
                yield _batch([{**r, "tag": tag} for r in rows], schema)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by shard and kind: filters and rare words, then requests, then rows that pass."""
        shard, counts, contexts, words, parts = None, EMPTY, EMPTY, None, []
        for batch in batches:
            passes, out = pa.array(batch.column("kind").to_numpy() == PASSED), []
            for row in batch.filter(pa.compute.invert(passes)).to_pylist():
                if row["shard"] != shard:
                    shard, counts, contexts, words, parts = row["shard"], EMPTY, EMPTY, None, []
                if row["kind"] == COUNTS:
                    counts = LogFrequencyFilter.unpacked(row["a"], row["b"])
                elif row["kind"] == CONTEXTS:
                    contexts = LogFrequencyFilter.unpacked(row["a"], row["b"])
                elif row["kind"] == WORDS:
                    parts.append((np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64)))
                else:
                    if words is None:
                        h, c = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
                        order = np.argsort(h)
                        words, parts = (h[order], c[order]), []
                    out.append(_answer(row, counts, contexts, words))
            if out:
                yield _batch(out, batch.schema)
            passed = batch.filter(passes)
            if passed.num_rows:
                yield passed

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers arrive by tag; rows that pass are between them."""
        tag, rows = None, []
        for batch in batches:
            passes = pa.array(batch.column("kind").to_numpy() == PASSED)
            for row in batch.filter(pa.compute.invert(passes)).to_pylist():
                if row["tag"] != tag and rows:
                    yield _sums(rows, batch.schema)
                    rows = []
                tag = row["tag"]
                rows.append(row)
            yield batch.filter(passes).select(list(OWN))
        if rows:
            yield _sums(rows, batch.schema)

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("id"), F.col(text).alias("text"))
    requests = rows.mapInArrow(asked, f"{packed_ddl}, {own_ddl}")
    by_shard = requests.unionByName(model.segments, allowMissingColumns=True)
    by_shard = by_shards(by_shard, shards).sortWithinPartitions("shard", "kind")
    by_tag = by_shard.mapInArrow(answered, f"{packed_ddl}, {own_ddl}").repartition("tag").sortWithinPartitions("tag", "kind")
    parts = by_tag.mapInArrow(summed, own_ddl)
    sums = parts.groupBy("id").agg(F.first("key", ignorenulls=True).alias("key"), *[F.sum(c).alias(c) for c in OWN[2:]])
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    # Of a text's known tokens all but the end are contexts; after each, the unigram has 1 - share of the mass.
    contexts = F.greatest(F.col("n_known") - F.col("copies"), F.lit(0)) * F.lit(log10(1 - share))
    base = F.col("base") - F.col("n_tokens") * F.lit(log10(total))
    return each.select(
        F.col("key").alias(key),
        (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (base / F.col("copies")).alias("base_score"),
        ((base + contexts + F.col("gain")) / F.col("copies")).alias("score"),
    )
