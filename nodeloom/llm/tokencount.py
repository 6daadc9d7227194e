"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

The count of a piece is its bytes less the merges made in it.  A null text counts as
empty (0 tokens, 0 bytes); texts of any length are counted whole; special strings of
the vocabulary found in a text count one token each.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.bytebpe import MEMO_ENTRIES, MEMO_PIECE, PATTERN, default_vocabulary, printable_bytes


class PieceCounts(dict):
    """piece -> number of tokens, counted on first use; bounded by ``trim``."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[bytes(to_byte[c] for c in left), bytes(to_byte[c] for c in right)] = rank
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.single = [bytes([b]) for b in range(256)]

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= MEMO_PIECE:
            self[piece] = n
        return n

    def count(self, piece: bytes) -> int:
        n, rank_of, single = len(piece), self.ranks.get, self.single
        nodes: list[bytes | None] = [single[b] for b in piece]
        queue = [(rank, i) for i in range(n - 1) if (rank := rank_of((nodes[i], nodes[i + 1]))) is not None]
        if not queue:
            return n
        heapq.heapify(queue)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while queue:
            rank, at = heapq.heappop(queue)
            nxt = after[at]
            if nodes[at] is None or nxt >= n or rank_of((nodes[at], nodes[nxt])) != rank:
                continue  # stale
            merges += 1
            grown = nodes[at] = nodes[at] + nodes[nxt]
            nodes[nxt] = None
            after[at] = following = after[nxt]
            if following < n:
                before[following] = at
                if (new := rank_of((grown, nodes[following]))) is not None:
                    heapq.heappush(queue, (new, at))
            if (left := before[at]) >= 0 and (new := rank_of((nodes[left], grown))) is not None:
                heapq.heappush(queue, (new, left))
        return n - merges

    def of(self, text: str) -> int:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        if self.special is None:
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


@lru_cache(maxsize=2)
def piece_counts(path: str | None) -> PieceCounts:
    """Loaded once in each Python worker."""
    return PieceCounts(path or default_vocabulary())


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > ``limit``)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path)
        for batch in batches:
            n = [counts.of(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = rows.mapInArrow(counted, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
