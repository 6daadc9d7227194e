"""Checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side that is broadcast after it has been measured.
MOST_BROADCAST = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local session gets a temporary folder and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nodeloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def laid_out(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """``df`` (checkpointed) dealt out and sorted by ``keys`` once, and checkpointed so that Spark knows it: joins and groups on these keys move only the other side.

    Spark forgets a checkpoint's partitioning where the job may be planned anew while it runs, so that is off for this job.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    shared_dir(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.repartition(partitions, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def _bytes_of(name: str, kind: T.DataType) -> Column:
    """About how many bytes a column's value takes."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(c) + 16
    elif isinstance(kind, T.ArrayType | T.MapType):
        size = F.size(c) * 16 + 32
    else:
        size = F.lit(64 if isinstance(kind, T.StructType) else 16)
    return F.coalesce(F.greatest(size, F.lit(16)), F.lit(16)).cast("long")


def small_side(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A checkpointed join side: broadcast if it has at most about ``most`` bytes, else left to a shuffle that Spark can split."""
    width = sum((_bytes_of(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df
