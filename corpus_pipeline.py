"""Cleaning pipeline over ``documents``: each stage takes and returns whole tables.

Stages: toxic documents go; documents of no known language go; one document of each
SimHash group stays (the one with the least doc_id); documents that hold a benchmark item
go; the rest is encoded and decoded.  ``lang`` and ``toxic`` labels are used for learning only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import bytebpe, decontam, langid, simhash, toxicity
from nodeloom.llm.storage import bounded_batches, fresh_path


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.3 by a model of the ``labels`` of the rows at hand.

    Null and empty texts score by the intercept.  Without labels nothing is learned and all rows stay.  Repeated
    rows are judged alike; all columns stay as they are, whatever their names.
    """
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is close enough to a language learned from the rows' own ``lang``.

    Texts that are null or have no letter go.  If no row has a ``lang``, nothing is learned and all rows stay.  Repeated
    rows are judged alike; all columns (a ``score`` of the caller's too) stay as they are.
    """
    bounded_batches(spark)
    return langid.without_unknown(docs, langid.train(docs))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the least doc_id, by the rule of op2 (3-word shingles, 2 bits).

    That rule joins exact copies and copies with very few edits: a changed word in a text of 100 words flips about
    five bits, so most edited copies stay.  Texts without words are one component.  Rows with a null doc_id
    stay; rows that share the doc_id of one that stays, repeated rows among them, stay with it.
    """
    bounded_batches(spark)
    return simhash.without_near_duplicates(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of ``benchmark`` within 20 % of its words in edits.

    Null and empty texts, and items without words, match nothing; with an empty benchmark all rows stay.
    """
    bounded_batches(spark)
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's text encoded and decoded: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    A null text is empty: no tokens and the digests of nothing.  Repeated rows give repeated results.
    """
    bounded_batches(spark)
    return bytebpe.token_digests(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("language_id", stage_language),
    ("simhash_near_dedup", stage_simhash),
    ("benchmark_decontamination", stage_decontamination),
    ("bpe_encode_decode", stage_bpe),
]

#: Learned models and SimHash aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return STAGES[-1][1](spark, out, sf_dir)
