"""Nodes within two undirected hops, counted without a row for each pair that a hub joins.

A node reaches the union of the closed neighbourhoods (the node and its neighbours) of its own closed neighbourhood.  Middle
nodes are taken apart by the size of theirs:

* A heavy one's neighbourhood (more than ``heavy_from`` nodes) is a compressed set: the nodes next to any heavy one are numbered
  within their graph, and some 30,000 numbers are one bitmap of 4 KB.  Nodes that are next to the same heavy ones share one union
  of such sets (a class; a hub's leaves are one class, a clique is one class), so a hub of degree d costs d rows once, not d squared.
* A light one gives pairs of its neighbours as rows, each pair once: at most ``heavy_from`` for an edge between light nodes. Two heavy
  nodes meet over a light one once for its class, and a light one and its heavy neighbour are in a set anyway.

Two nodes are in each other's sets or in neither's (they share a heavy neighbour), so one bit is looked up for a pair, and the pairs that
are inside are taken off.  Rows are dealt out by their number, and a key with many of them in shares, so that a task's memory doesn't grow with the tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.storage import checkpointed, laid_out, small_side

#: Members of a closed neighbourhood beyond which it is a bitmap: a bitmap's 4 KB are as much as some 128 rows.
HEAVY_FROM = 128
#: Rows, and bitmaps, that a task takes; partitions at most.
TASK_ROWS = 250_000
TASK_SETS = 8_192
MOST_PARTITIONS = 16_384
#: Nodes of a graph to a bitmap, which holds 32,768: they are dealt by hash, so their number varies by some hundreds.
SET_NODES = 30_000

PAIR = ["graph_id", "x", "y"]


def _parts(rows: int, most: int | None = None) -> int:
    return min(MOST_PARTITIONS, rows // (most or TASK_ROWS) + 1)


def _dealt(df: DataFrame, rows: int, *keys: str, most: int | None = None) -> DataFrame:
    """``df`` in as many parts as its number of rows needs: Spark would merge parts by their compressed bytes."""
    return df.repartition(_parts(rows, most), *keys)


def _joined_in_shares(rows: DataFrame, n: int, side: DataFrame, on: Sequence[str], spread: str, most: int | None = None) -> DataFrame:
    """``rows`` (checkpointed, ``n`` of them) joined with ``side``, whose keys are unique: a key with more than ``most`` rows is dealt in shares by ``spread``, and its row of ``side`` repeated for each."""
    crowded = small_side(checkpointed(rows.groupBy(*on).agg(F.ceil(F.count("*") / (most or TASK_ROWS)).alias("_shares")).where("_shares > 1")))
    shares = F.coalesce("_shares", F.lit(1))
    left = rows.join(crowded, on, "left").withColumn("_share", F.pmod(F.xxhash64(spread), shares)).drop("_shares")
    right = side.join(crowded, on, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("_shares")
    return _dealt(left, n, *on, "_share", most=most).join(right, [*on, "_share"]).drop("_share")


def near_nodes(edges: DataFrame) -> tuple[DataFrame, int]:
    """Distinct (graph_id, src, dst) in both directions without loops, from a checkpoint; their number."""
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    rows = checkpointed(edges.where("graph_id is not null and src <> dst").select("graph_id", *ends))
    there = checkpointed(_dealt(rows, rows.count(), "graph_id", "src", "dst").distinct())
    return there.unionByName(there.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))), 2 * there.count()


def two_hop_sizes(nodes: DataFrame, edges: DataFrame, heavy_from: int = HEAVY_FROM) -> DataFrame:
    """``graph_id``, ``node_id``, ``reached``: how many nodes of its graph are within two undirected hops, itself included.

    Loops and repeated edges change nothing; a node without edges reaches itself, and an edge's end that isn't among the nodes counts as one.
    Rows with a null graph_id or id are left out.  ``heavy_from`` only decides how the work is spread.
    """
    near, n_near = near_nodes(edges)
    degrees = checkpointed(near.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("_n")))
    hubs = small_side(checkpointed(degrees.where(F.col("_n") >= heavy_from).select("graph_id", F.col("node_id").alias("hub"))))
    hub_as = lambda name: hubs.withColumnRenamed("hub", name)
    some = not hubs.isEmpty()

    light = near.join(hub_as("src"), ["graph_id", "src"], "left_anti") if some else near
    walk = checkpointed((light.join(hub_as("dst"), ["graph_id", "dst"], "left_anti") if some else light).select("graph_id", F.col("src").alias("x"), F.col("dst").alias("m")))
    counts = [nodes.where("graph_id is not null and node_id is not null").select("graph_id", "node_id", F.lit(0).cast("long").alias("_pairs")), degrees.select("graph_id", "node_id", F.lit(0).cast("long").alias("_pairs"))]
    pairs = None if walk.isEmpty() else checkpointed(_light_pairs(walk, light, hubs if some else None))
    if pairs is not None:
        counts += _of_both(pairs, 1)
    if not some:
        return _summed(counts, n_near).select("graph_id", "node_id", (F.col("_pairs") + 1).alias("reached"))

    links = near.join(hub_as("src"), ["graph_id", "src"], "left_semi").select("graph_id", F.col("src").alias("hub"), F.col("dst").alias("node_id"))
    links = laid_out(links.unionByName(hubs.select("graph_id", "hub", F.col("hub").alias("node_id"))), _parts(n_near), "graph_id", "node_id")
    member = _members(links)
    n_member = member.count()
    heads = small_side(checkpointed(member.groupBy("graph_id", "class").agg(F.min("node_id").alias("node_id"))))
    class_hubs = checkpointed(links.join(heads, ["graph_id", "node_id"]).select("graph_id", "class", "hub"))
    unions = _unions(links.join(member.drop("class"), ["graph_id", "node_id"]), links.count(), class_hubs)
    by_hubs = checkpointed(unions.groupBy("graph_id", "class").agg(F.sum(F.bitmap_count("bits")).alias("_by_hubs")))

    of_hub = small_side(checkpointed(member.join(hub_as("node_id"), ["graph_id", "node_id"], "left_semi")))
    # A light node has fewer hubs than heavy_from, so a class of one gives fewer pairs than its square.
    over = class_hubs.join(checkpointed(member.join(hub_as("node_id"), ["graph_id", "node_id"], "left_anti").select("graph_id", "class").distinct()), ["graph_id", "class"], "left_semi")
    x, y = over.withColumnRenamed("hub", "x"), over.withColumnRenamed("hub", "y")
    n_over = over.groupBy("graph_id", "class").agg(F.count("*").alias("_n")).agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0
    met = checkpointed(_dealt(x, n_over, "graph_id", "class").join(y, ["graph_id", "class"]).where("x < y").select(*PAIR).distinct())
    counts += _of_both(met, 1)

    placed = lambda of, name: of.select("graph_id", F.col("node_id").alias(name), "bucket", "bit")
    classed = lambda of, name: of.select("graph_id", F.col("node_id").alias(name), "class")
    looked = [met.join(placed(of_hub, "x"), ["graph_id", "x"]).join(classed(of_hub, "y"), ["graph_id", "y"])]
    if pairs is not None:
        n_pairs = pairs.count()
        at = checkpointed(_dealt(pairs, n_pairs, "graph_id", "x").join(placed(member, "x"), ["graph_id", "x"]))
        looked.append(at.where("heavy").join(classed(of_hub, "y"), ["graph_id", "y"]))
        looked.append(_dealt(at.where("not heavy"), n_pairs, "graph_id", "y").join(classed(member, "y"), ["graph_id", "y"]))
    cols = [*PAIR, "class", "bucket", "bit"]
    keyed = looked[0].select(*cols)
    for more in looked[1:]:
        keyed = keyed.unionByName(more.select(*cols))
    keyed = checkpointed(keyed)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    inside = F.expr("(shiftright(_byte, cast(bit % 8 as int)) & 1) = 1")
    counts += _of_both(_joined_in_shares(keyed, keyed.count(), unions, ["graph_id", "class", "bucket"], "x").withColumn("_byte", byte).where(inside), -1)

    few, on = small_side(by_hubs), ["graph_id", "class"]
    of_class = (_joined_in_shares(member, n_member, by_hubs, on, "node_id") if few is by_hubs else member.join(few, on)).select("graph_id", "node_id", F.lit(0).cast("long").alias("_pairs"), "_by_hubs")
    counts = [c.withColumn("_by_hubs", F.lit(None).cast("long")) for c in counts] + [of_class]
    return _summed(counts, n_near, F.max("_by_hubs").alias("_by_hubs")).select("graph_id", "node_id", (F.col("_pairs") + F.coalesce("_by_hubs", F.lit(1))).alias("reached"))


def _of_both(pairs: DataFrame, each: int) -> list[DataFrame]:
    """``graph_id``, ``node_id``, ``_pairs``: a pair counts ``each`` for either of its nodes."""
    return [pairs.groupBy("graph_id", F.col(c).alias("node_id")).agg((F.count("*") * each).alias("_pairs")) for c in ("x", "y")]


def _summed(counts: list[DataFrame], rows: int, *more) -> DataFrame:
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return _dealt(every, rows, "graph_id", "node_id").groupBy("graph_id", "node_id").agg(F.sum("_pairs").alias("_pairs"), *more)


def _light_pairs(walk: DataFrame, light: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Distinct pairs (graph_id, x, y, ``heavy``: whether y is) that are neighbours or meet over a light node: x is light, and below y if y is light too."""
    no = F.lit(False).alias("heavy")
    ends = walk.select("graph_id", "m", F.col("x").alias("y"), no)
    if hubs is not None:
        used = walk.select("graph_id", F.col("m").alias("src")).distinct()
        to_hub = light.join(hubs.withColumnRenamed("hub", "dst"), ["graph_id", "dst"], "left_semi").join(used, ["graph_id", "src"], "left_semi")
        ends = ends.unionByName(to_hub.select("graph_id", F.col("src").alias("m"), F.col("dst").alias("y"), F.lit(True).alias("heavy")))
    ends = checkpointed(ends)
    at = ends.groupBy("graph_id", "m").agg((F.count("*") * F.count_if(~F.col("heavy"))).alias("_n"))
    n = at.agg(F.sum("_n")).first()[0] or 0
    met = _dealt(walk, n, "graph_id", "m").join(ends, ["graph_id", "m"]).where("heavy or x < y").select(*PAIR, "heavy")
    next_to = walk.where("x < m").select("graph_id", "x", F.col("m").alias("y"), no)
    return _dealt(met.distinct().unionByName(next_to), n, *PAIR).distinct()


def _members(links: DataFrame) -> DataFrame:
    """(graph_id, node_id, class, bucket, bit) of each node next to a heavy one, checkpointed."""
    # A class is named by 128 bits of its hubs; any member tells which they are.
    name = F.concat_ws(":", *[F.hex(F.bit_xor(F.xxhash64("hub", F.lit(seed)))) for seed in (0, 1)], F.count("*").cast("string"))
    named = checkpointed(links.groupBy("graph_id", "node_id").agg(name.alias("class")))
    large = checkpointed(named.groupBy("graph_id").agg(F.ceil(F.count("*") / SET_NODES).alias("_chunks")).where("_chunks > 1"))
    chunk = F.pmod(F.xxhash64("node_id"), F.coalesce("_chunks", F.lit(1)))
    chunked = named.join(small_side(large), "graph_id", "left").withColumn("_chunk", chunk).drop("_chunks")
    place = F.row_number().over(Window.partitionBy("graph_id", "_chunk").orderBy("node_id")).cast("long")
    placed = _dealt(chunked, named.count(), "graph_id", "_chunk").withColumn("_place", place)
    # The chunk's number is above the bucket's, which is 1 but for a chunk of more than 32,768 nodes.
    bucket = F.col("_chunk") * 65536 + F.bitmap_bucket_number("_place")
    return checkpointed(placed.select("graph_id", "node_id", "class", bucket.alias("bucket"), F.bitmap_bit_position("_place").alias("bit")))


def _unions(links: DataFrame, n_links: int, class_hubs: DataFrame) -> DataFrame:
    """(graph_id, class, bucket, bits): the nodes next to any hub of a class, checkpointed."""
    rows = _dealt(links.select("graph_id", "hub", "bucket", "bit"), n_links, "graph_id", "hub", "bucket")
    sets = checkpointed(rows.groupBy("graph_id", "hub", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    # A class of many hubs is merged in lanes of some TASK_SETS / 32 sets first.
    lanes = checkpointed(class_hubs.groupBy("graph_id", "class").agg(F.ceil(F.count("*") * 32 / TASK_SETS).alias("_lanes")).where("_lanes > 1"))
    lane = F.pmod(F.xxhash64("hub"), F.coalesce("_lanes", F.lit(1))).alias("_lane")
    laned = class_hubs.join(small_side(lanes), ["graph_id", "class"], "left").select("graph_id", "class", "hub", lane)
    spots = checkpointed(laned.join(sets.select("graph_id", "hub", "bucket"), ["graph_id", "hub"]))
    n = spots.count()
    met = _joined_in_shares(spots, n, sets, ["graph_id", "hub", "bucket"], "class", TASK_SETS)
    keys = ["graph_id", "class", "bucket"]
    merged = _dealt(met, n, *keys, "_lane", most=TASK_SETS).groupBy(*keys, "_lane").agg(F.bitmap_or_agg("bits").alias("bits"))
    if lanes.isEmpty():
        return checkpointed(merged.drop("_lane"))
    merged = checkpointed(merged)
    return checkpointed(_dealt(merged, merged.count(), *keys, most=TASK_SETS).groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits")))


def two_hop_reach(nodes: DataFrame, edges: DataFrame, heavy_from: int = HEAVY_FROM) -> DataFrame:
    """``graph_id``, ``two_hop_frac``: mean over nodes of the share of the graph within two undirected hops, the node itself included."""
    reached = two_hop_sizes(nodes, edges, heavy_from).groupBy("graph_id").agg(F.sum("reached").alias("_r"))
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("_n"))
    return n.join(reached, "graph_id").select("graph_id", (F.col("_r") / (F.col("_n") * F.col("_n"))).alias("two_hop_frac"))
