"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``CELLS`` cells; every shard owns ``virtual_nodes`` of them, and the arc of a virtual node is the run of
cells that ends at its own. A row belongs to the cell its key hashes to. A shard takes at most its quota; what an arc
holds beyond that continues clockwise to the next virtual node whose shard has room. Only the counts of the arcs
(shards x virtual_nodes rows, whatever the input) are walked in ring order; rows then find their shard by a join on
the cell and their rank.

Defined results: a null key is replaced by a hash of the payload, so null keys spread over the ring; rows alike in
every column still get slots of their own; an empty table gives no rows; the caller's other columns are not touched
(helper columns live in a struct called ``_ring``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELLS = 1 << 16
VIRTUAL_NODES = 32


def ring(spark, shards: int, virtual_nodes: int) -> DataFrame:
    """(arc, shard, cell): virtual nodes in clockwise order; arc counts from 0."""
    nodes = (
        spark.range(shards * virtual_nodes, numPartitions=1)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("node"))
        .withColumn("cell", F.pmod(F.xxhash64(F.lit("node"), "shard", "node"), F.lit(CELLS)).cast("int"))
    )
    order = W.partitionBy(F.lit(0)).orderBy("cell", "shard", "node")  # shards x virtual_nodes rows
    return nodes.select((F.row_number().over(order) - 1).alias("arc"), "shard", "cell")


def cell_arcs(spark, nodes: DataFrame) -> DataFrame:
    """(cell, arc) for each of the CELLS cells: the first virtual node at or after it, around the ring."""
    starts = nodes.groupBy("cell").agg(F.min("arc").alias("arc"))
    cells = spark.range(CELLS, numPartitions=1).select(F.col("id").cast("int").alias("cell")).join(F.broadcast(starts), "cell", "left")
    ahead = W.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)  # CELLS rows
    return cells.select("cell", F.coalesce(F.last("arc", ignorenulls=True).over(ahead), F.lit(0)).alias("arc"))


def followers(nodes: DataFrame, shards: int) -> DataFrame:
    """(arc, following): the shards in the order of their first virtual node at or after the arc."""
    pairs = nodes.select("arc", F.col("shard").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    by_shard = W.partitionBy("shard")
    ahead = by_shard.orderBy(F.desc("arc")).rowsBetween(W.unboundedPreceding, 0)
    own = F.when(F.col("own") == F.col("shard"), F.col("arc"))
    after = F.coalesce(F.last(own, ignorenulls=True).over(ahead), F.min(own).over(by_shard) + F.count("*").over(by_shard))
    met = pairs.select("arc", F.struct(after.alias("after"), "shard").alias("met")).groupBy("arc").agg(F.sort_array(F.collect_list("met")).alias("met"))
    return met.select("arc", F.col("met.shard").alias("following"))


def walk(arcs: DataFrame, shards: int, headroom: float) -> DataFrame:
    """(arc, shard, lo, hi, base): rows ranked [lo, hi) of an arc take slots from ``base`` in that shard.

    arcs: (arc, n, following), one row per virtual node. One fold over them, in ring order. With headroom 0 the quotas
    are the two whole numbers next to the mean and add up to the rows, else each is ceil((1 + headroom) * mean).
    """
    one = arcs.groupBy().agg(F.sort_array(F.collect_list(F.struct("arc", "n", "following"))).alias("arcs"), F.sum("n").alias("total"))
    ids = F.sequence(F.lit(0), F.lit(shards - 1))
    mean = F.col("total") / shards
    quota = F.transform(ids, lambda s: (F.ceil(mean * (1 + headroom)) if headroom else F.floor(mean) + (s < F.col("total") % shards).cast("long")).cast("long"))
    none, cut_type = F.lit(0).cast("long"), "array<struct<arc:int,shard:int,lo:bigint,hi:bigint,base:bigint>>"

    def take(acc: Column, s: Column, arc: Column, n: Column) -> Column:
        load = F.element_at(acc["loads"], s + 1)
        got = F.least(n - acc["given"], F.element_at(acc["quota"], s + 1) - load)
        cut = F.struct(arc.alias("arc"), s.alias("shard"), acc["given"].alias("lo"), (acc["given"] + got).alias("hi"), load.alias("base"))
        taken = F.struct(
            (acc["given"] + got).alias("given"),
            acc["quota"].alias("quota"),
            F.transform(acc["loads"], lambda x, j: F.when(j == s, x + got).otherwise(x)).alias("loads"),
            F.concat(acc["cuts"], F.array(cut)).alias("cuts"),
        )
        return F.when((acc["given"] < n) & (got > 0), taken).otherwise(acc)

    def step(acc: Column, a: Column) -> Column:
        begin = F.struct(none.alias("given"), acc["quota"].alias("quota"), acc["loads"].alias("loads"), acc["cuts"].alias("cuts"))
        return F.aggregate(a["following"], begin, lambda inner, s: take(inner, s, a["arc"], a["n"]))

    start = F.struct(none.alias("given"), quota.alias("quota"), F.transform(ids, lambda _: none).alias("loads"), F.array().cast(cut_type).alias("cuts"))
    return one.filter("total > 0").select(F.inline(F.aggregate("arcs", start, step)["cuts"]))


def ring_shards(rows: DataFrame, key: Column, payload: Column, shards: int, virtual_nodes: int = VIRTUAL_NODES, headroom: float = 0.0) -> DataFrame:
    """rows with (shard int, slot long) in a struct ``_ring``; slots are gapless from 0 in each shard.

    key decides a row's place on the ring; payload only parts rows of one key, so that a repeated key is a set of small
    groups. Rows of one cell are ranked together: 1/CELLS of all rows.
    """
    spark = rows.sparkSession
    place = F.coalesce(F.xxhash64(F.lit("row"), key), F.lit(0))
    place = F.when(key.isNull(), F.xxhash64(F.lit("none"), payload)).otherwise(place)
    placed = rows.withColumn("_ring", F.struct(F.pmod(place, F.lit(CELLS)).cast("int").alias("cell"), F.pmod(F.xxhash64(F.lit("part"), key, payload), F.lit(64)).cast("int").alias("part"), key.alias("key"), payload.alias("payload")))
    nodes = ring(spark, shards, virtual_nodes)
    in_cell = W.partitionBy("cell").orderBy("part")
    counts = (
        placed.groupBy(F.col("_ring.cell").alias("cell"), F.col("_ring.part").alias("part"))
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(cell_arcs(spark, nodes)), "cell")
        .withColumn("before", F.sum("n").over(in_cell) - F.col("n"))
    )
    of_cells = counts.groupBy("arc", "cell").agg(F.sum("n").alias("n"))
    cells = of_cells.withColumn("start", F.sum("n").over(W.partitionBy("arc").orderBy("cell")) - F.col("n"))
    of_arcs = of_cells.groupBy("arc").agg(F.sum("n").alias("n"))
    arcs = followers(nodes, shards).join(F.broadcast(of_arcs), "arc", "left").select("arc", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "following")
    plan = walk(arcs, shards, headroom)
    spans = counts.join(cells.select("cell", "start"), "cell").select("cell", "part", "arc", (F.col("start") + F.col("before")).alias("start"))
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_ring.cell", "_ring.part").orderBy("_ring.key", "_ring.payload")) - 1)
    found = (
        ranked.alias("r")
        .join(spans.alias("s"), (F.col("r._ring.cell") == F.col("s.cell")) & (F.col("r._ring.part") == F.col("s.part")))
        .join(F.broadcast(plan).alias("p"), (F.col("s.arc") == F.col("p.arc")) & (F.col("s.start") + F.col("r._rank") >= F.col("p.lo")) & (F.col("s.start") + F.col("r._rank") < F.col("p.hi")))
    )
    given = F.struct(F.col("p.shard").alias("shard"), (F.col("p.base") + F.col("s.start") + F.col("r._rank") - F.col("p.lo")).alias("slot"))
    return found.select(*(F.col(f"r.`{c}`") for c in rows.columns), given.alias("_ring"))
