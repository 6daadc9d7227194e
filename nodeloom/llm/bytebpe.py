"""Byte-level BPE encoding and decoding with a heap of merge ranks over a linked symbol list.

A text is cut at the vocabulary's special strings, the rest is split into pieces by
the vocabulary's pattern, and each piece is merged: every adjacent pair that has a rank
waits in a priority queue, the lowest (rank, position) is popped, entries whose
symbols have changed since are skipped as stale, and the two list nodes are spliced.
Decoding concatenates the byte strings of the vocabulary.

Whole texts of any length are processed; a null text is an empty text (no ids, empty
decoded text).  Work and memory are per piece, and the memo of piece -> ids that each
Python worker keeps has a fixed number of entries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.storage import unused_name

# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's memo; it is emptied when full.
MEMO_ENTRIES = 400_000
#: Longer pieces are merged each time, so that the memo's bytes are bounded too.
MEMO_PIECE = 64


def default_vocabulary() -> str:
    """Path of the installed ``byte_bpe_50k.json`` (resolved where it is called)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file -> the byte.

    Printable Latin-1 characters stand for themselves; the others are numbered from 256.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    table = {chr(b): b for b in own}
    rest = (b for b in range(256) if chr(b) not in table)
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What encoding and decoding need of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.byte_id = [0] * 256
        for char, byte in to_byte.items():
            self.byte_id[byte] = vocab[char]
        #: left * 2^20 + right -> (rank, merged id)
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        self.strings = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.memo: dict[str, bytes] = PieceMemo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.byte_id[b] for b in piece]
        n, pairs = len(symbols), self.pairs
        # An entry is rank * 2^32 + position: the lowest rank first, the leftmost of equals.
        queue = [found[0] << 32 | i for i in range(n - 1) if (found := pairs.get(symbols[i] << 20 | symbols[i + 1]))]
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            at = entry & 0xFFFFFFFF
            nxt = after[at]
            if symbols[at] < 0 or nxt >= n:
                continue
            found = pairs.get(symbols[at] << 20 | symbols[nxt])
            if found is None or found[0] != entry >> 32:
                continue  # stale
            symbols[at], symbols[nxt] = found[1], -1
            after[at] = following = after[nxt]
            if following < n:
                before[following] = at
                if new := pairs.get(found[1] << 20 | symbols[following]):
                    heapq.heappush(queue, new[0] << 32 | at)
            if (left := before[at]) >= 0 and (new := pairs.get(symbols[left] << 20 | found[1])):
                heapq.heappush(queue, new[0] << 32 | left)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        parts = self.split_special.split(text) if self.split_special else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.memo.__getitem__, self.pieces(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters."""
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class PieceMemo(dict):
    """piece -> its ids as bytes, merged on first use."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= MEMO_PIECE:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Vocabulary:
    """The vocabulary, loaded once in each Python worker."""
    return Vocabulary(path or default_vocabulary())


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` (the text rebuilt from them).

    Columns of these names that ``docs`` already has are replaced.  A null text gives an
    empty array and an empty text.
    """
    kept = docs.drop(ids, decoded)
    schema = f"{ids} array<int>, {decoded} string"

    @F.pandas_udf(schema)
    def coded(texts):
        import pandas as pd

        v = vocabulary(path)
        raw = [v.encode(t or "") for t in texts]
        return pd.DataFrame({ids: [np.frombuffer(b, "<i4") for b in raw], decoded: [v.decode(b) for b in raw]})

    both = unused_name(kept, "_coded")
    return kept.withColumn(both, coded(F.col(text))).select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"{both}.{ids}").alias(ids), F.col(f"{both}.{decoded}").alias(decoded))


def token_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``n_tokens`` and the SHA-256 of the ids and of the decoded text.

    The digests are taken as the ids are made, so that no id array leaves the worker.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for t in batch.column(1):
                raw = v.encode(t.as_py() or "")
                n.append(len(raw) // 4)
                of_ids.append(hashlib.sha256(raw).hexdigest())
                of_text.append(hashlib.sha256(v.decode(raw).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(digest, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
