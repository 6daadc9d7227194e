"""Shared folder paths, bounded Arrow batches, and the hold-out rule of the queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.storage import checkpointed, shared_dir, small_side

__all__ = ["bounded_batches", "checkpointed", "fresh_path", "held_out", "shared_dir", "small_side", "unused_name"]


def fresh_path(spark: SparkSession, kind: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the rows of an Arrow batch, so that a batch of very long texts stays small.

    A setting of the session that stays, as queries run after they are made; a lower one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def unused_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    while base.lower() in {c.lower() for c in df.columns}:
        base += "_"
    return base
