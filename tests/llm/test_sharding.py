import math

import pytest
from pyspark.sql import functions as F

from pagewright.llm import sharding


def test_sharding(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("shard"), F.col("id").alias("slot")).union(spark.range(9).selectExpr("1L", "'u'", "5L"))
    placed = sharding.ring_shards(rows, F.col("doc_id"), F.col("slot"), 24)
    got = placed.groupBy("_ring.shard").agg(F.count("*").alias("n"), F.countDistinct("_ring.slot").alias("d"), F.max("_ring.slot").alias("m")).collect()
    assert len(got) == 24 and max(r.n for r in got) - min(r.n for r in got) <= 1 and all(r.n == r.d == r.m + 1 for r in got) and sum(r.n for r in got) == 5009
    assert sharding.ring_shards(rows.limit(0), F.col("doc_id"), F.col("slot"), 24).collect() == []
    roomy = [sharding.ring_shards(rows.filter("doc_id is not null").distinct(), F.col("doc_id"), F.col("slot"), n, headroom=0.25).select("doc_id", "_ring.shard") for n in (24, 25)]
    moved = roomy[0].join(roomy[1].withColumnRenamed("shard", "grown"), "doc_id").filter("shard <> grown").count()
    assert moved < 0.25 * 4300


def walked(spark, rows, shards, virtual_nodes, headroom):
    """(shard, slot) of each (doc_id, payload) by a plain walk around the ring; hashes are Spark's."""
    nodes = [(r.cell, r.shard) for r in sharding.ring(spark, shards, virtual_nodes).orderBy("arc").collect()]
    hashed = lambda *c: F.xxhash64(*c)
    place = F.when(F.col("doc_id").isNull(), hashed(F.lit("none"), "payload")).otherwise(hashed(F.lit("row"), "doc_id"))
    given = rows.select("doc_id", "payload", F.pmod(place, F.lit(sharding.CELLS)).alias("cell"), F.pmod(hashed(F.lit("part"), "doc_id", "payload"), F.lit(64)).alias("part")).collect()
    arcs = [[] for _ in nodes]
    for r in given:
        arcs[next((i for i, (cell, _) in enumerate(nodes) if cell >= r.cell), 0)].append(r)
    n = len(given)
    quota = [math.ceil(n / shards * (1 + headroom)) if headroom else n // shards + (s < n % shards) for s in range(shards)]
    out, load = {}, [0] * shards
    for arc, members in enumerate(arcs):
        members.sort(key=lambda r: (r.cell, r.part, r.doc_id is not None, r.doc_id or 0, r.payload))
        at = arc
        for r in members:
            while load[nodes[at % len(nodes)][1]] == quota[nodes[at % len(nodes)][1]]:
                at += 1  # the shard is full: on to the next virtual node
            shard = nodes[at % len(nodes)][1]
            out[r.doc_id, r.payload] = (shard, load[shard])
            load[shard] += 1
    return out


@pytest.mark.parametrize(("shards", "virtual_nodes", "headroom"), [(5, 4, 0.0), (6, 4, 0.0), (5, 3, 0.2), (24, 32, 0.0)])
def test_against_a_plain_walk(spark, shards, virtual_nodes, headroom):
    rows = spark.range(700).select(F.when(F.col("id") % 9 > 0, F.col("id") % 500).alias("doc_id"), (F.col("id") * 7).alias("payload"))
    got = sharding.ring_shards(rows, F.col("doc_id"), F.col("payload"), shards, virtual_nodes, headroom).collect()
    assert {(r.doc_id, r.payload): (r._ring.shard, r._ring.slot) for r in got} == walked(spark, rows, shards, virtual_nodes, headroom)


def test_movement(spark):
    """A shard more moves about what it takes where there is headroom; with quotas that add up to the rows (law rows) overflow moves others too."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("payload"))

    def moved(headroom):
        a, b = (sharding.ring_shards(rows, F.col("doc_id"), F.col("payload"), n, headroom=headroom).select("doc_id", F.col("_ring.shard").alias(f"s{n}")) for n in (24, 25))
        return a.join(b, "doc_id").filter("s24 <> s25").count() / 20_000

    assert moved(0.25) < 0.15 and moved(0.0) < 0.15
