"""Places of rows in an order over a whole table: one range shuffle, whatever the keys, and no task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import storage

ROWS = 1 << 33  # Spark's increasing ids have the partition above these bits


def ranked(rows: DataFrame, *order: Column, name: str = "_rank") -> DataFrame:
    """rows, written in the shared folder, with a long column ``name``: their place from 0 in the given order.

    Rows alike in all of ``order`` get places in any order among them. Each partition of the range shuffle is written with its rows'
    places in it; what precedes it is a sum over partitions (as many rows as there are shuffle partitions).
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = storage.written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.floor(F.col("_place") / ROWS).cast("long")
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = placed.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return found.withColumn(name, F.col("_before") + F.col("_place") % ROWS).drop("_part", "_before", "_place")
