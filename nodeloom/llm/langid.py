"""Language identification by nearest centroid with distance-based rejection.

A text's letters (lower-cased; anything else is a space) give character 1- to 3-grams hashed
into ``DIMS`` coordinates; weights are (1 + ln tf) * idf, normalised.  Each language has a few
centroids from spherical k-means over a bounded sample; the prediction is the language
of the nearest centroid by cosine.

``score`` is that cosine (0 to 1).  A text that is null or has no letter is ``und`` with
score 0.  ``rejected`` marks ``und`` and texts whose cosine is below their language's limit.  Limits are
learned: each half of a language's sample meets centroids of the other half, and the limit is ``margin`` times
the first percentile of these cosines (of the language's own or of all languages', whichever is lower; 0 where no
language has two rows).  Ties go to the centroid that sorts first by language.  With no labelled rows nothing can be
learned and every text is ``und`` and rejected.

A letter is a character of a Unicode category L*: digits, numbers such as ``½`` or ``Ⅷ``, marks and signs are none.

The limits don't depend on length, and the cosines of very short texts scatter: of texts of three words about a fifth are rejected, of five or
more about 3 % (measured on held-out texts cut short), and a filter that drops what is rejected drops that share of them.

Every ``lang`` value is learned, however many there are.  A language has ``clusters`` centroids of 16 KB; up to ``most_centroids`` are one
broadcast, more are dealt into blocks of about that size.  Then each block is a pass over the texts that keeps the better of its own and the
earlier blocks' nearest centroid, and the texts are written to the shared folder between passes, so driver and workers hold one block at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.storage import checkpointed, small_side, unused_name
from nodeloom.llm.wordhash import mixed
from nodeloom.operators.quantiles import exact_quantiles

DIMS_BITS = 12
DIMS = 1 << DIMS_BITS
not_letters = re.compile(r"[\W\d_]+")
blanks = re.compile(" +")
#: Centroids that are broadcast at a time: 16 MB.
MOST_CENTROIDS = 1000
#: Characters hashed at a time, so that very long texts stay small in memory.
CHUNK = 1 << 18


def letter_line(text: str | None) -> str:
    """The lower-cased letters of a text, anything between them one blank."""
    line = not_letters.sub(" ", text.lower()) if text else ""
    if not line.isascii() and (others := {ord(c): " " for c in set(line) if not c.isalpha()}.keys() - {32}):
        # What is left of numbers that aren't digits.
        line = blanks.sub(" ", line.translate(dict.fromkeys(others, " ")))
    return line.strip()


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed character n-grams of a whole text; None if it has no letter."""
    line = letter_line(text)
    if not line:
        return None
    points = np.frombuffer(f" {line} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(DIMS, np.int64)
    for at in range(0, len(points), CHUNK):
        part = points[at : at + CHUNK + 2]
        for n in (1, 2, 3):
            keys = part[: min(CHUNK, len(part) - n + 1)].copy()
            for i in range(1, n):
                keys = keys << np.uint64(21) | part[i : i + len(keys)]
            counts += np.bincount((mixed(keys + np.uint64(n)) >> np.uint64(64 - DIMS_BITS)).astype(np.int64), minlength=DIMS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows of count rows."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def spherical_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` unit centroids of unit rows; starts: the mean, then the rows farthest from the starts."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        nearest = (x @ np.stack(centres).T).max(1)
        centres.append(x[int(nearest.argmin())])
    c = np.stack(centres)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def crossed_cosines(x: np.ndarray, k: int) -> np.ndarray:
    """Of each unit row, the cosine to the nearest of ``k`` centroids of the half that it isn't in; none for a single row."""
    halves = x[::2], x[1::2]
    return np.concatenate([(a @ spherical_means(b, k).T).max(1) for a, b in (halves, halves[::-1]) if len(b) and len(a)] or [np.zeros(0, np.float32)])


class Centroids:
    """Languages, their unit centroids, the idf, and the least cosine by language."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, limits: dict[str, float]):
        self.langs, self.centroids, self.idf, self.limits = langs, centroids, idf, limits

    def rejects(self, lang: str, score: float) -> bool:
        return lang == "und" or score < self.limits[lang]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        for at in range(0, len(texts), 64):
            counts = [ngram_counts(t) for t in texts[at : at + 64]]
            rows = [i for i, c in enumerate(counts) if c is not None]
            if rows:
                near = weighted(np.stack([counts[i] for i in rows]), self.idf) @ self.centroids.T
                for i, best in zip(rows, near.argmax(1), strict=True):
                    langs[at + i] = self.langs[best]
                for i, cosine in zip(rows, near.max(1), strict=True):
                    scores[at + i] = float(min(1.0, max(0.0, cosine)))
        return langs, scores


class CentroidBlocks:
    """More centroids than one broadcast takes, as a table (lang, centroid, limit) that is read a block of languages at a time."""

    def __init__(self, table: DataFrame, blocks: int, idf: np.ndarray):
        self.table, self.blocks, self.idf, self.langs = table, blocks, idf, True

    def block(self, i: int) -> Centroids:
        return _centroids(self.table.where(F.pmod(F.xxhash64("lang"), F.lit(self.blocks)) == i), self.idf)


def _centroids(table: DataFrame, idf: np.ndarray) -> Centroids:
    rows = table.select("lang", "centroid", "limit", "i").toPandas().sort_values(["lang", "i"], kind="stable")  # a block at most
    return Centroids(rows["lang"].tolist(), np.array(rows["centroid"].tolist(), np.float32).reshape(-1, DIMS), idf, dict(zip(rows["lang"], rows["limit"], strict=True)))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", allowed: Column | None = None, per_lang: int = 1000, clusters: int = 4, most_centroids: int = MOST_CENTROIDS, margin: float = 0.75) -> Centroids | CentroidBlocks:
    """Centroids from rows whose ``lang`` and ``key`` are not null.

    ``per_lang`` bounds the sample of each language (the first keys in the order of their hash).  Rows that repeat a key and language count once (with the least of their
    texts).  Texts without letters are passed over.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.col(lang) != "und"))
    if allowed is not None:
        known = known.where(allowed)
    keys = known.select(F.col(key).alias("_key"), F.col(lang).alias("_lang")).withColumn("_at", F.xxhash64("_key"))
    # Of a language's hash range so much that about 4 * per_lang rows remain: what is ranked stays small at any size.
    sizes = checkpointed(keys.groupBy("_lang").agg(F.count("*").alias("_size")))
    few = keys.join(small_side(sizes), "_lang").where(F.col("_at") / 2.0**64 + 0.5 <= 4.0 * per_lang / F.col("_size")).select("_key", "_lang", "_at").distinct()
    first = Window.partitionBy("_lang").orderBy("_at", "_key")
    sample = few.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_lang).select("_key", "_lang")
    texts = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_l"), F.col(text).alias("_text")).join(small_side(checkpointed(sample)), "_key").where("_l = _lang")
    texts = texts.groupBy("_key", "_lang").agg(F.min("_text").alias("_text"))  # a key that many rows share counts once

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, n = [], [], []
            for lang_value, t in zip(batch.column(0), batch.column(1), strict=True):
                if (c := ngram_counts(t.as_py())) is not None:
                    found = np.flatnonzero(c)
                    langs.append(lang_value.as_py())
                    at.append(found.astype(np.int16))
                    n.append(np.minimum(c[found], 2**31 - 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int16())), pa.array(n, pa.list_(pa.int32()))], names=["lang", "at", "n"])

    rows = checkpointed(texts.select("_lang", "_text").mapInArrow(counted, "lang string, at array<smallint>, n array<int>"))
    total = rows.count()
    idf = np.full(DIMS, np.log(1 + total) + 1)
    for at, df in rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # at most DIMS rows
        idf[at] = np.log((1 + total) / (1 + df)) + 1

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(group), DIMS), np.int32)
        for i, (at, n) in enumerate(zip(group["at"], group["n"], strict=True)):
            counts[i, at] = n
        order = np.lexsort(counts[:, ::-64].T)  # the same at each run, whatever order the rows came in
        x = weighted(counts[order], idf)
        centres = spherical_means(x, clusters)
        crossed = crossed_cosines(x, clusters).astype(float)
        more = [None] * (len(centres) - 1)
        low = float(np.percentile(crossed, 1)) if len(crossed) else 1.0
        return pd.DataFrame({"lang": group["lang"].iloc[0], "i": range(len(centres)), "centroid": list(centres), "cosines": [crossed.tolist(), *more], "low": low})

    found = checkpointed(rows.groupBy("lang").applyInPandas(clustered, "lang string, i int, centroid array<float>, cosines array<double>, low double"))
    every = exact_quantiles(found.select(F.explode("cosines").alias("c")), "c", [0.01]).first()  # one row, or none
    limit = F.lit(0.0) if every is None else margin * F.least("low", F.lit(every["q"][0]))
    table, n = found.withColumn("limit", limit), found.count()
    return _centroids(table, idf) if n <= most_centroids else CentroidBlocks(table, -(-n // most_centroids), idf)


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (columns of these names are replaced)."""
    kept = docs.drop("lang_pred", "score", "rejected")
    said = unused_name(kept, "_said")
    out = _by_blocks(kept, model, text, said) if isinstance(model, CentroidBlocks) else _judged(kept, model, text, said)
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"{said}.{c}").alias(c) for c in ("lang_pred", "score", "rejected")])


def _by_blocks(docs: DataFrame, model: CentroidBlocks, text: str, said: str) -> DataFrame:
    """``docs`` with the struct ``said``, made block by block."""
    out, new = docs, unused_name(docs, f"{said}_new")
    for i in range(model.blocks):
        judged = _judged(out, model.block(i), text, new)
        if i:
            old, this = F.col(said), F.col(new)
            better = (old["lang_pred"] == "und") | (this["score"] > old["score"]) | ((this["score"] == old["score"]) & (this["lang_pred"] < old["lang_pred"]))
            judged = judged.withColumn(said, F.when(better & (this["lang_pred"] != "und"), this).otherwise(old)).drop(new)
        else:
            judged = judged.withColumnRenamed(new, said)
        out = checkpointed(judged)
    return out


def _judged(docs: DataFrame, model: Centroids, text: str, said: str) -> DataFrame:
    """``docs`` with the struct ``said`` of language, score and rejection by one block of centroids."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.centroids, model.idf, model.limits))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        model = Centroids(*shared.value)
        langs, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": [model.rejects(*x) for x in zip(langs, scores, strict=True)]})

    return docs.withColumn(said, predicted(F.col(text)))


def without_unknown(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that aren't rejected, with their columns; all rows if ``model`` learned no language."""
    if not model.langs:
        return docs
    if isinstance(model, CentroidBlocks):
        said = unused_name(docs, "_said")
        return _by_blocks(docs, model, text, said).where(~F.col(f"{said}.rejected")).drop(said)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.centroids, model.idf, model.limits))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        model = Centroids(*shared.value)
        return pd.Series([not model.rejects(*x) for x in zip(*model.predict(texts.tolist()), strict=True)], dtype=bool)

    return docs.where(known(F.col(text)))
