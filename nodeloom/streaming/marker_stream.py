"""Marker statistics of nodes that arrive as files: the batch operators on a stream.

Graphs come in whole files, so there is no event time; counts and means per marker are running
aggregates whose state is one row per marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nodeloom import schema
from nodeloom.operators.markers import positive_rows


def node_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder, in the nodes schema."""
    return spark.readStream.schema(schema.NODES).option("maxFilesPerTrigger", max_files).parquet(path)


def running_marker_stats(nodes: DataFrame) -> DataFrame:
    """``marker_id``, ``n_pos``, ``y_mean``, ``y_std`` over all nodes so far."""
    return positive_rows(nodes, "y").groupBy("marker_id").agg(F.count("*").alias("n_pos"), F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std"))


def write_marker_stats(nodes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's state replaces the folder ``path``; what is available is processed and the query stops."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)  # one row per marker

    return running_marker_stats(nodes).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
