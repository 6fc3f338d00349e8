"""Look-ups of unequal keys: the few keys that hold many rows are broadcast, the rest are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_PARTS = 500  # a key is hot from 1/HOT_PARTS of all rows on, so that many are hot at most


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined (left outer) with right, whose keys are unique; both have the string column ``key``.

    Hot keys of left are found by a count with partial sums; their rows of right (HOT_PARTS at most) are broadcast. The other rows
    are joined by key; hot rows take part there under keys of their own, spread evenly, which nothing matches.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = left.count()
    hot = counts.filter(F.col("_n") * HOT_PARTS >= max(total, 1)).select(key)
    values = [c for c in right.columns if c != key]
    found = F.struct(F.lit(True).alias("_hot"), *(F.col(c) for c in values))
    hot_right = hot.join(right, key, "left").select(F.col(key).alias("_key"), found.alias("_found"))
    first = left.join(F.broadcast(hot_right), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    own_key = F.when(F.col("_found._hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\x00hot"), F.xxhash64(*(c for c in left.columns if c != key)).cast("string")))
    cold = right.select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    second = first.withColumn("_own", own_key).join(cold, F.col("_own") == F.col("_key"), "left")
    return second.select(*left.columns, *(F.coalesce(F.col(f"_found.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values))


def counted_lookup(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """left joined (left outer) with right, whose keys are unique and not null and whose column ``n`` has the rows of left for each, or more; they add up to ``total``.

    Rows of right with 1/HOT_PARTS of the total or more (HOT_PARTS at most) are broadcast; rows of left that they serve are spread over the other join, where nothing matches them.
    """
    values = [c for c in right.columns if c not in keys]
    is_hot = F.col(n) * HOT_PARTS >= max(total, 1)
    hot = right.filter(is_hot).select(*keys, F.struct(*values).alias("_hot"))
    first = left.join(F.broadcast(hot), keys, "left")
    first = first.withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*left.columns).bitwiseOR(F.lit(1).cast("long"))))
    cold = right.filter(~is_hot).select(*keys, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_spread"))
    second = first.join(cold, [*keys, "_spread"], "left")
    return second.select(*left.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values))
