"""Edges laid out once for any number of message-passing layers.

The layout deals the edges by (graph_id, src) and writes them to the shared folder, so that every layer's join finds them in place:
only node states and summed messages move.  Each node has an edge to itself, marked as its own, so a layer is one
join and one sum that gives a node its own state beside its neighbours', and a plan grows by one such pair a layer, whatever
their number.

A source with more than ``heavy_from`` edges (a hub) has them dealt in as many salted shares of about that size, and its state is
copied once for each share; a hub's incoming messages are summed where they arise before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.storage import checkpointed, laid_out, small_side

HEAVY_FROM = 100_000


@dataclass
class Wiring:
    """``edges`` (graph_id, node_id, [salt,] dst, own), dealt out; ``shares`` (graph_id, node_id, shares) of the hubs, None if there are none."""

    edges: DataFrame
    shares: DataFrame | None

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, partitions: int | None = None, heavy_from: int = HEAVY_FROM) -> Wiring:
        """The layout of a graph table; ``partitions`` is the session's number of shuffle partitions unless it is given.  Rows with a null graph_id are left out."""
        n = partitions or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = nodes.select("graph_id", "node_id", F.col("node_id").alias("dst"), F.lit(True).alias("own"))
        sent = edges.select("graph_id", F.col("src").alias("node_id"), "dst", F.lit(False).alias("own"))
        rows = checkpointed(own.unionByName(sent).where("graph_id is not null"))
        out = rows.groupBy("graph_id", "node_id").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_from)
        hubs = checkpointed(out.select("graph_id", "node_id", F.ceil(F.col("_n") / heavy_from).cast("int").alias("shares")))
        if hubs.isEmpty():
            return cls(laid_out(rows, n, "graph_id", "node_id"), None)
        salt = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("shares")), F.lit(0)).cast("int")
        rows = rows.join(small_side(hubs), ["graph_id", "node_id"], "left").withColumn("salt", salt).drop("shares")
        return cls(laid_out(rows, n, "graph_id", "node_id", "salt"), hubs)

    def passed(self, states: DataFrame, column: str, width: int, how: str = "mean", degree: bool = False) -> DataFrame:
        """``graph_id``, ``node_id``, ``own`` (the node's ``column``) and ``near`` (the mean or sum of its in-neighbours', zeros without any).

        ``states`` has a row a node; nodes that it lacks neither send nor receive.  ``degree`` adds the number of in-edges that count.
        """
        rows, keys = states.select("graph_id", "node_id", F.col(column).alias("_f")), ["graph_id", "node_id"]
        if self.shares is not None:
            salts = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("salt")
            rows, keys = rows.join(small_side(self.shares), keys, "left").select("graph_id", "node_id", "_f", salts), [*keys, "salt"]
        met = rows.join(self.edges, keys)
        fn = {"mean": F.avg, "sum": F.sum}[how]
        value = lambda i: F.get("_f", F.lit(i)).cast("double")
        own = [F.max(F.when(F.col("own"), value(i))).alias(f"_o{i}") for i in range(width)]
        near = [fn(F.when(~F.col("own"), value(i))).alias(f"_n{i}") for i in range(width)]
        sums = met.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.max("own").alias("_own"), F.count_if(~F.col("own")).alias("degree"), *own, *near)
        array = lambda c: F.array(*[F.coalesce(f"_{c}{i}", F.lit(0.0)) for i in range(width)])
        return sums.where("_own").select("graph_id", "node_id", array("o").alias("own"), array("n").alias("near"), *(["degree"] if degree else []))
