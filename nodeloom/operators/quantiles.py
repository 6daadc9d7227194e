"""Exact linear-interpolation quantiles, and row ranks, of groups of any size.

Groups of at most ``GROUP_ROWS`` values are one aggregate.  A larger group's values are cut into chunks at approximate quantiles (a bounded sketch); chunk
sizes give each chunk's first rank, ranks inside a chunk come from a running count over its
distinct values, and the two order statistics around each quantile are interpolated.  No
group is gathered in one task: a group with a third of all rows is spread over as many chunks as its rows need,
of about ``CHUNK_ROWS`` rows each (up to ``MOST_CHUNKS``, beyond which chunks grow).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.storage import checkpointed, small_side

#: Chunks of a large group at least and at most (squares), and the rows of one.
CHUNKS = 64
MOST_CHUNKS = 16_384
CHUNK_ROWS = 1_000_000
#: Values of a group that one task may hold.
GROUP_ROWS = 100_000


def chunk_splits(rows: DataFrame, by: Sequence[str], value: str, chunks: int | None = None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """(``by``, ``_s``: approximate split points of ``value``, ``_n``: rows, checkpointed; the number of chunks).

    Unless ``chunks`` is given, the first pass makes ``CHUNKS``, and if the largest group needs more, a second one makes as many.
    """

    def made(chunks: int) -> DataFrame:
        at = F.percentile_approx(value, [i / chunks for i in range(1, chunks)], max(1000, 10 * chunks))
        return checkpointed(rows.groupBy(*by).agg(at.alias("_s"), F.count("*").alias("_n")))

    if chunks:
        return made(chunks), chunks
    splits = made(CHUNKS)
    most = splits.agg(F.max("_n")).first()[0] or 0
    side = min(isqrt(MOST_CHUNKS), isqrt(most // chunk_rows) + 1)
    return (splits, CHUNKS) if side * side <= CHUNKS else (made(side * side), side * side)


def chunk_of(value: str, chunks: int) -> Column:
    """How many of the split points ``_s`` are at most ``value``: a look at every side-th one, then at those between two of them."""
    side, v = isqrt(chunks), F.col(value)
    at_most = lambda points: F.size(F.filter(points, lambda s: s <= v))
    if side * side != chunks:
        return at_most(F.col("_s"))
    coarse = at_most(F.array(*[F.get("_s", F.lit(i * side - 1)) for i in range(1, side)]))
    return coarse * side + at_most(F.slice("_s", coarse * side + 1, F.lit(side - 1)))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), chunks: int | None = None, group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``by`` columns, ``n`` and ``q`` (array<double> in the order of ``probs``) of each group.

    Null values are passed over.  A group without values gives no row; without ``by``, an empty
    table gives no row.  Null group keys form a group.  Both ways are exact, so ``group_rows`` only decides how the work is spread.
    """
    if not by:
        return _chunked_quantiles(df, value, probs, by, chunks, chunk_rows)
    rows = df.select(*by, (F.col(value).cast("double") + 0.0).alias("_v")).where("_v is not null")
    large = checkpointed(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > group_rows).select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)]))
    on = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)])
    none = large.isEmpty()
    side = None if none else small_side(large)
    few = (rows if none else rows.join(side, on, "left_anti")).groupBy(*by).agg(F.count("*").alias("n"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    if none:
        return few
    return few.unionByName(_chunked_quantiles(rows.join(side, on, "left_semi"), "_v", probs, by, chunks, chunk_rows))


def _chunked_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], chunks: int | None, chunk_rows: int) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], (F.col(value).cast("double") + 0.0).alias("_v")).where("_v is not null")
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    splits, chunks = chunk_splits(rows, keys, "_v", chunks, chunk_rows)

    def same(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"{k}b") for k in keys], *[c for c in b.columns if c not in keys])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}b"))
        out = a.join(b, on) if keys else a.crossJoin(F.broadcast(b))  # one row
        return out.drop(*[f"{k}b" for k in keys])

    placed = same(counts, small_side(splits) if keys else splits).withColumn("_chunk", chunk_of("_v", chunks)).drop("_s")
    sizes = placed.groupBy(*keys, "_chunk").agg(F.sum("_c").alias("_size"))  # at most `chunks` rows a group
    first = sizes.withColumn("_first", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_size")).drop("_size")
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_v")
    ranked = placed.withColumn("_upto", F.sum("_c").over(inside))
    first = first.withColumnRenamed("_chunk", "_chunk2")
    ranked = same(ranked.withColumnRenamed("_chunk", "_chunk1"), first.withColumn("_dummy", F.lit(0))).where("_chunk1 = _chunk2") if keys else ranked.join(F.broadcast(first), F.col("_chunk") == F.col("_chunk2"))
    # Ranks lo <= r < hi hold the value.
    hi = F.col("_first") + F.col("_upto")
    ranked = ranked.select(*keys, "_v", "_n", (hi - F.col("_c")).alias("_lo"), hi.alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    at = lambda p: F.lit(1.0) * (F.col("_n") - 1) * p
    hits = ranked.withColumn("_w", F.filter(wanted, lambda w: (F.floor(at(w["p"])) < F.col("_hi")) & (F.ceil(at(w["p"])) >= F.col("_lo")))).where(F.size("_w") > 0)
    hits = hits.select(*keys, "_v", "_n", "_lo", "_hi", F.explode("_w").alias("_w"))
    pos = at(F.col("_w.p"))
    low = F.max(F.when((F.floor(pos) >= F.col("_lo")) & (F.floor(pos) < F.col("_hi")), F.col("_v"))).alias("_a")
    high = F.max(F.when((F.ceil(pos) >= F.col("_lo")) & (F.ceil(pos) < F.col("_hi")), F.col("_v"))).alias("_b")
    pairs = hits.groupBy(*keys, "_n", F.col("_w.i").alias("_i"), F.col("_w.p").alias("_p")).agg(low, high)
    between = at(F.col("_p")) - F.floor(at(F.col("_p")))
    pairs = pairs.withColumn("_q", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * between))
    out = pairs.groupBy(*keys, "_n").agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_q"))
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col("_n").alias("n"), F.transform("_q", lambda s: s["_q"]).alias("q"))


def row_ranks(df: DataFrame, by: str, chunk_on: Column, order: Sequence[str | Column], name: str = "rank", chunks: int | None = None, chunk_rows: int = CHUNK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` with each row's number from 1 within its group, in ``order``.

    Groups of at most ``group_rows`` rows are one window each.  ``chunk_on`` is a number that never falls along the order; a larger group's rows are
    numbered inside chunks of it and offset by the chunks before.  Null group keys are left out.
    """
    if chunks is None:
        # Small groups are numbered as they are; only large ones are cut into chunks.
        large = checkpointed(df.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > group_rows).where(F.col(by).isNotNull()).select(by))
        number = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long").alias(name)
        if large.isEmpty():
            return df.where(F.col(by).isNotNull()).select("*", number)
        side = small_side(large)
        few = df.where(F.col(by).isNotNull()).join(side, by, "left_anti").select("*", number)
        return few.unionByName(_chunked_ranks(df.join(side, by, "left_semi"), by, chunk_on, order, name, None, chunk_rows))
    return _chunked_ranks(df, by, chunk_on, order, name, chunks, chunk_rows)


def _chunked_ranks(df: DataFrame, by: str, chunk_on: Column, order: Sequence[str | Column], name: str, chunks: int | None, chunk_rows: int) -> DataFrame:
    rows = df.withColumn("_at", chunk_on.cast("double"))
    splits, chunks = chunk_splits(rows, [by], "_at", chunks, chunk_rows)
    placed = rows.join(small_side(splits.drop("_n")), by).withColumn("_chunk", chunk_of("_at", chunks)).drop("_s", "_at")
    sizes = placed.groupBy(by, "_chunk").agg(F.count("*").alias("_size"))  # at most `chunks` rows a group
    first = checkpointed(sizes.select(by, "_chunk", (F.sum("_size").over(Window.partitionBy(by).orderBy("_chunk")) - F.col("_size")).alias("_first")))
    inside = F.row_number().over(Window.partitionBy(by, "_chunk").orderBy(*order))
    return placed.withColumn("_r", inside).join(small_side(first), [by, "_chunk"]).withColumn(name, F.col("_first") + F.col("_r")).drop("_r", "_first", "_chunk")
