"""Maximal periodic runs of words, found by Lyndon words, and texts with their repeats collapsed.

Words stand between white space (blank and code points 9 to 13).  A run is a stretch of words with smallest period q, at least
``min_length`` and ``min_exponent`` * q words long, that no neighbouring word extends with that period.

Every run has a Lyndon root: under one of the two orders (words by number, or by number reversed) the longest Lyndon word that
starts at a root's place is the root itself.  So a stack scanned from right to left gives, under each order, the
longest Lyndon word at every place, and each such word's length is tried as a period: the common extension to the right, then to the
left, gives the run.  Suffixes are compared and periods extended by a search over rolling hashes; the words so
matched are compared directly, each stretch once for a distance, so that no result rests on a hash.

The scan covers what can hold a run.  In a stretch of L words a run's period is at most L / ``min_exponent``, so each of its words
stands again that near; words that don't are cut out, and what is left is cut again until nothing changes.  In prose little is left;
nothing is lost.  Work is n log n in the words of a text, memory a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULUS, BASE = (1 << 61) - 1, 0x1B3A55C9D2E4F7A1 % ((1 << 61) - 1)
_powers = [1]


def powers(n: int) -> list[int]:
    """Powers of the hash base up to n; a worker keeps them."""
    while len(_powers) <= n:
        _powers.append(_powers[-1] * BASE % MODULUS)
    return _powers


def stretches(ids: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Where runs can be: (first, end) of stretches whose words all stand again within an ``min_exponent``-th of the stretch's length."""
    n = len(ids)
    if n < min_length:
        return []
    order = np.argsort(ids, kind="stable")
    gap = np.diff(order)
    gap[ids[order[1:]] != ids[order[:-1]]] = n
    near = np.full(n, n, np.int64)  # words to the nearest equal one
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    found, todo = [], [(0, n)]
    while todo:
        first, end = todo.pop()
        fits = near[first:end] <= (end - first) // min_exponent
        if fits.all():
            found.append((first, end))
            continue
        turns = np.flatnonzero(np.diff(np.concatenate(([False], fits, [False])).view(np.int8)))
        starts, ends = turns[::2], turns[1::2]
        long = ends - starts >= min_length
        todo.extend(zip((starts[long] + first).tolist(), (ends[long] + first).tolist(), strict=True))
    return found


class Stretch:
    """Words of a stretch as numbers, with common extensions of two places."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.powers = powers(len(words))
        self.hashes = list(accumulate(words, lambda h, w: (h * BASE + w + 1) % MODULUS, initial=0))
        self.same: dict[int, tuple[int, int]] = {}  # distance -> [first, end) whose words equal those at that distance, and the one at end doesn't

    def equal(self, i: int, j: int, length: int) -> bool:
        h = self.hashes
        return (h[i + length] - h[j + length] - (h[i] - h[j]) * self.powers[length]) % MODULUS == 0

    def onward(self, i: int, j: int) -> int:
        """How many words from i < j on are equal."""
        words, n, d = self.words, self.n, j - i
        known = self.same.get(d)
        if known and known[0] <= i < known[1]:
            return known[1] - i
        if j >= n or words[i] != words[j]:
            return 0
        if known and known[0] == i + 1:
            self.same[d] = (i, known[1])
            return known[1] - i
        low, high = 1, 2  # equal, tried
        while j + high <= n and self.equal(i, j, high):
            low, high = high, 2 * high
        high = min(high, n - j + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if self.equal(i, j, middle):
                low = middle
            else:
                high = middle
        low = self.verified(i, j, low, known)
        self.same[d] = (i, i + low)
        return low

    def verified(self, i: int, j: int, length: int, known: tuple[int, int] | None) -> int:
        """``length`` if the words are equal, else how many are; those known to be equal aren't compared again."""
        words = self.words
        stop = known[0] if known and i < known[0] <= i + length else i + length
        if words[i:stop] != words[j : j + stop - i]:
            return next(k for k in range(stop - i) if words[i + k] != words[j + k])
        end = max(i + length, known[1]) if stop < i + length else i + length
        while end + j - i < self.n and words[end] == words[end + j - i]:
            end += 1
        return end - i

    def back(self, i: int, j: int) -> int:
        """How many words before i < j are equal."""
        words = self.words
        low, high = 0, 1
        while high <= i and self.equal(i - high, j - high, high):
            low, high = high, 2 * high
        high = min(high, i + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if self.equal(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle
        if words[i - low : i] != words[j - low : j]:
            low = next(k for k in range(low) if words[i - 1 - k] != words[j - 1 - k])
        while low < i and words[i - 1 - low] == words[j - 1 - low]:
            low += 1
        return low

    def lyndon_ends(self, reverse: bool) -> list[int]:
        """Where the longest Lyndon word that starts at each place ends, under the order of the numbers or its reverse."""
        words, n, onward = self.words, self.n, self.onward
        ends = [n] * n
        for i in range(n - 2, -1, -1):
            j, w = i + 1, words[i]
            while j < n:
                other, at, to = words[j], i, j
                if other == w:
                    k = onward(i, j)
                    at, to = i + k, j + k
                    if to >= n:
                        break  # the later suffix is a part of this one's beginning: smaller
                    other = words[to]
                if (words[at] > other) != reverse:
                    break
                j = ends[j]
            ends[i] = j
        return ends

    def runs(self, min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
        """(start, length, period)."""
        words, n, found, seen = self.words, self.n, set(), set()
        for reverse in (False, True):
            for i, j in enumerate(self.lyndon_ends(reverse)):
                q = j - i
                if j >= n or words[i] != words[j]:
                    continue
                # The first root inside a run has this much of it ahead.
                onward = self.onward(i, j)
                if onward <= (min_exponent - 2) * q or (q, j + onward) in seen:
                    continue
                seen.add((q, j + onward))
                start = i - self.back(i, j)
                length = j + onward - start
                if length >= max(min_length, min_exponent * q):
                    found.add((start, length, q))
        return found


def find_runs(words: list, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of hashable words, by start and period; ``min_exponent`` is 2 at least."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least once: min_exponent >= 2")
    if len(words) < min_length:
        return []
    first_at: dict = {}
    ids = np.fromiter(map(first_at.setdefault, words, count()), np.int64, len(words))
    found = []
    for first, end in stretches(ids, min_length, min_exponent):
        found.extend((first + start, length, q) for start, length, q in Stretch(ids[first:end].tolist()).runs(min_length, min_exponent))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``runs`` (array of start, length, period; by start and period) and ``collapsed``, the words left, joined by a blank.

    A null or empty text has no words, no runs and an empty ``collapsed``.  Repeated rows and null keys keep rows of their own;
    an empty table gives none.  Other columns are not read.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, starts, lengths, periods, offsets, left = [], [], [], [], [0], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode().split()
                runs = find_runs(words, min_length, min_exponent)
                n.append(len(words))
                for start, length, q in runs:
                    starts.append(start)
                    lengths.append(length)
                    periods.append(q)
                offsets.append(len(starts))
                left.append(b" ".join(collapsed(words, runs)))
            rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (starts, lengths, periods)], fields=list(run))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists, pa.array(left, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(found, f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("key", key)
