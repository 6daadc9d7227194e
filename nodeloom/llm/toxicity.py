"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: distinct words, pairs of adjacent words and pairs one word apart, hashed into
2^``bits`` coordinates.  Training runs one online pass over a bounded, hash-ordered
sample of labelled rows; per-coordinate learning rates and the L1 threshold leave few
non-zero weights, which are broadcast (at most 2^``bits`` of them).  Whole texts are scored.
Null and empty texts have no features and get the score of the intercept.  With no labelled rows
nothing is learned: every score is 0 and no row is taken for toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.wordhash import joined, mixed, text_words

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct coordinates of a whole text; coordinate 0 is the intercept."""
    words = text_words(text)
    grams = np.concatenate([mixed(words), joined(words[:-1], words[1:], 1), joined(words[:-2], words[2:], 2)])
    at = np.unique((grams >> np.uint64(64 - bits)).astype(np.int32))
    return np.union1d(at, [0]).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal state of a logistic regression with 0/1 features."""

    def __init__(self, bits: int = BITS):
        self.z = np.zeros(1 << bits)
        self.n = np.zeros(1 << bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 0, 0.0, L1)  # the intercept is not shrunk
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = probability(w.sum()) - label
        n = self.n[at]
        rate_change = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA
        self.z[at] += gradient - rate_change * w
        self.n[at] = n + gradient * gradient


def probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", allowed: Column | None = None, max_rows: int = 20_000, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero.

    ``allowed`` is a condition on ``labels``.  Rows with a null key or a label other than 0 and
    1 are not learned from; a key labelled more than once counts once (its largest label), and
    so does a key that several rows share (the least of their texts).
    ``max_rows`` bounds the sample: the first keys in the order of their hash.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    if allowed is not None:
        known = known.where(allowed)
    rows = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label")).withColumn("_at", F.xxhash64("_key"))
    # Of the hash range so much that about 2 * max_rows keys remain: what is sorted stays small at any size.
    share = 2.0 * max_rows / max(known.count(), 1)
    sample = rows.where(F.col("_at") / 2.0**64 + 0.5 <= share).orderBy("_at", "_key").limit(max_rows).select("_key", "_label")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    texts = texts.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))  # a key that many rows share counts once

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], names=["order", "label", "at"])

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, any_row = Ftrl(bits), False
        for batch in batches:
            for at, y in zip(batch["at"], batch["label"], strict=True):
                model.learn(at, y)
                any_row = True
        if any_row:
            w = model.weights(np.arange(1 << bits))
            kept = np.flatnonzero(w)
            yield pd.DataFrame({"at": kept.astype(np.int32), "weight": w[kept]})

    rows = texts.select(F.xxhash64("_key").alias("order"), "_text", "_label").mapInArrow(featured, "order bigint, label int, at array<int>")
    # One task reads the bounded sample as a stream; it holds the weights and one batch.
    model = rows.repartition(1).sortWithinPartitions("order").mapInPandas(learned, "at int, weight double").toPandas()
    return model["at"].to_numpy(np.int32), model["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``key`` and ``score`` (0 to 1; 0 if nothing was learned) of every row."""
    shared, learned = docs.sparkSession.sparkContext.broadcast(model), len(model[0]) > 0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            out = [probability(dense[features(t.as_py(), bits)].sum()) if learned else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scored, f"key {kind}, score double").withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with their columns; all rows if nothing was learned."""
    if not len(model[0]):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        dense = np.zeros(1 << bits)
        dense[shared.value[0]] = shared.value[1]
        return texts.map(lambda t: probability(dense[features(t, bits)].sum()), na_action=None)

    return docs.where(scored(F.col(text)) < threshold)
