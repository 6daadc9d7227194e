"""Shards of near-equal bytes by longest-processing-time scheduling of text groups.

Rows with equal texts form a group that stays together.  All groups, largest first, go one after another to the
least-loaded shard of a heap.  Groups of one size are interchangeable, so the driver schedules size
classes (size, number of groups), each in one step of closed form if it is large: T bytes have at most
sqrt(2 T) distinct sizes of groups (5 million at 10 TB), which bounds what the driver sees.  A group's rank in its class then decides
its shard.  Ranks, and the slots of a shard's rows, are counted in hash buckets with offsets, so no
sort is of a whole class or shard, and the number of buckets follows the number of rows.  No text is shuffled.

Null and empty texts are one group of size 1 a row.  Ties of load go to the lowest shard, ties of size are
ranked by the texts' hashes, so shards are the same at each run; slots follow the order in which rows are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.llm.storage import checkpointed, small_side

#: Rows ranked in one task.
BUCKET_ROWS = 50_000
#: Groups with over 1 / HOT of all rows (fewer than HOT) are met by a broadcast join.
HOT = 1000


def filled(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets if each goes to the least-loaded shard (the lowest, of equals)."""
    if count <= 4 * len(loads):
        heap, got = [(load, i) for i, load in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        return got
    # An item that would find load + j * size on shard i comes at that level: find the highest level that is reached.
    below = lambda level: [max(0, -((load - level) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * (count + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    got = below(low)
    left = count - sum(got)
    for i, load in enumerate(loads):
        if left and load + got[i] * size == low:
            got[i] += 1
            left -= 1
    return got


def schedule(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, shards used, ranks at which each ends) of (size, number of groups) classes, largest first."""
    loads, out = [0] * shards, []
    for size, count in sorted(classes, reverse=True):
        got = filled(loads, size, count)
        used, ends, end = [], [], 0
        for i, n in enumerate(got):
            if n:
                end += n
                loads[i] += n * size
                used.append(i)
                ends.append(end)
        out.append((size, used, ends))
    return out


def _ranked(df: DataFrame, by: str, order: list[str], rank: str, rows: int) -> DataFrame:
    """``df`` with a gapless rank from 0 within ``by``: by hash bucket of ``order``'s columns, then by these."""
    buckets = -(-rows // BUCKET_ROWS) or 1
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select(by, "_bucket", (F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket")) - F.col("_n")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(small_side(checkpointed(offsets)), [by, "_bucket"]).withColumn(rank, (F.col("_place") + F.col("_offset")).cast("long")).drop("_bucket", "_place", "_offset")


def group_shards(groups: DataFrame, shards: int, count: int) -> DataFrame:
    """``group`` and ``shard`` of ``count`` groups (``group``, ``size``): longest processing time first."""
    spark: SparkSession = groups.sparkSession
    classes = [(r[0], r[1]) for r in groups.groupBy("size").count().toLocalIterator()]
    table = spark.createDataFrame(schedule(classes, shards), "size bigint, used array<int>, ends array<bigint>")
    placed = _ranked(groups, "size", ["group"], "rank", count).join(small_side(table), "size")
    return placed.select("group", F.element_at("used", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1).alias("shard"))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot``, ``grown_shard`` (null).

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1.  An empty table gives no rows; repeated
    rows, and rows with a null or repeated key, each get a slot of their own.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("group"),
    )
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = checkpointed(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    decided = checkpointed(group_shards(groups.select("group", "size"), shards, count))
    # A hot group's rows stay where they are; the others meet their group's shard by a shuffle of hashes.
    hot = groups.where(F.col("n") * HOT > total).select("group").join(decided, "group").withColumnRenamed("shard", "hot_shard")
    told = rows.join(F.broadcast(hot), "group", "left")
    met = told.where("hot_shard is null").drop("hot_shard").join(decided, "group")
    names = ["key", "size", "text_crc32", "row", "shard"]
    sharded = met.select(names).unionByName(told.where("hot_shard is not null").withColumnRenamed("hot_shard", "shard").select(names))
    out = _ranked(checkpointed(sharded), "shard", ["row"], "slot", total)
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
