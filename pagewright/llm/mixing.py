"""Mixing sources to target weights by fitting word budgets with subset sums.

A source's target is its share, by weight, of ``PERCENT`` percent of all words, at most ``MOST`` times its own words; the excess is shared again among the
others until none is above. A target is so many whole passes over the source and a remaining budget, for which documents are chosen by exact
length: documents are counted by (source, length); each length gets its part of the budget in whole documents; what rounding leaves is
filled by single documents of seeded lengths until at most ``TABLE`` words remain, and those by bounded-knapsack dynamic programming over the
lengths that still have documents. Which documents of a length are taken is decided by a seeded hash.

At size: all documents go through one range shuffle, of numbers (source, length, hash, id), which ranks those of each length (ranks.ranked). A length that
holds much of a source is spread over many tasks there and joined to its plan by broadcast (skew.counted_lookup). Lengths of one source, at most as many as its longest text has
words, are fitted in one task. Sources are a table too: they are numbered by ranks.ranked, and resharing is a sum over that table, again for each time that a source is capped.

Defined results: a null source is a source, the last; null, empty and blank texts have size 0, and taken 0; a source without words has target 0; rows alike in id
and text are documents each (which of them is taken more often is not told apart); the hash of a null id is that of its text; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import ranks, skew, storage

WEIGHTS, PERCENT, MOST = (3, 1, 2), 150, 2  # of sources in their order, again and again; of all words; passes over a source
TABLE = 1 << 17  # words of budget that the dynamic program fits at most
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
PLAN = "source struct<none:boolean,name:string>, size long, start long, n long, source_size long, target double, passes long, picks long"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size), in the order of ``source``."""
    listed = F.array(*map(F.lit, weights))
    numbered = ranks.ranked(sizes, F.col("source"))
    weighed = storage.written(numbered.select("source", "source_size", F.element_at(listed, (F.col("_rank") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")), "weighed")
    budget = (weighed.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    share, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * share
        count, taken, open_ = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if count == capped or not open_:
            return weighed.select("source", "source_size", F.when(above, F.col("cap")).otherwise(F.col("weight") * share).alias("target"))
        capped, share = count, (budget - (taken or 0)) / open_


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: float, seed: str, table: int = TABLE) -> np.ndarray:
    """How many documents of each length (positive, all different) to take, so that their words come near the budget."""
    total = float((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    ideal = counts * (budget / total)
    picks = np.minimum(np.floor(ideal).astype(np.int64), counts)
    left = int(round(budget)) - int((picks * lengths).sum())
    draw = np.array([zlib.crc32(f"{seed}:{n}".encode()) for n in lengths])
    order = np.lexsort((draw, -(ideal - picks)))  # those that rounding cut most first
    for again in (False, True):  # one document of a length at first, then as many as there are
        for i in order:
            if left <= table:
                break
            more = min(int(counts[i] - picks[i]), max(left - table, lengths[i]) // int(lengths[i]) if again else 1, left // int(lengths[i]))
            picks[i] += more
            left -= more * int(lengths[i])
    if left > 0:
        picks += knapsack(lengths, counts - picks, order, min(left, table))
    return picks


def knapsack(lengths: np.ndarray, counts: np.ndarray, order: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length make the largest sum up to the budget. Counts are taken as powers of two and a rest; a sum remembers the part that first made it."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    made_by, parts = np.full(budget + 1, -1, np.int64), []
    for i in order:
        rest, power = min(int(counts[i]), budget // int(lengths[i])), 1
        while rest and not reached[budget]:
            times = min(power, rest)
            weight = times * int(lengths[i])
            new = np.flatnonzero(reached[: budget + 1 - weight] & ~reached[weight:]) + weight
            reached[new], made_by[new] = True, len(parts)
            parts.append((i, times))
            rest, power = rest - times, power * 2
    at, picks = int(np.flatnonzero(reached)[-1]), np.zeros(len(lengths), np.int64)
    while at:
        i, times = parts[made_by[at]]
        picks[i] += times
        at -= times * int(lengths[i])
    return picks


def plans(lengths: DataFrame, seed: int = SEED, table: int = TABLE) -> DataFrame:
    """PLAN of (source, size, start, n, source_size, target): each document of a length is taken ``passes`` times, and ``picks`` of them once more."""

    def plan(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("size", ignore_index=True)
        size, target = int(own["source_size"][0]), float(own["target"][0])
        passes = int(target // size) if size else 0
        own["passes"], own["picks"] = passes, 0
        words = own["size"].to_numpy() > 0
        if target > passes * size:
            own.loc[words, "picks"] = fitted(own["size"].to_numpy()[words], own["n"].to_numpy()[words], target - passes * size, f"{seed}:{own['source'][0]}", table)
        return own[[c.split()[0] for c in ("source", "size", "start", "n", "source_size", "target", "passes", "picks")]]

    return lengths.groupBy("source").applyInPandas(plan, PLAN)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED, table: int = TABLE) -> DataFrame:
    """(key, size, source_size, target, taken) of each document."""
    with storage.scratch(docs.sparkSession) as keep:
        name = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))
        hashed = F.when(F.col(key).isNull(), F.xxhash64(F.lit(seed), F.lit("text"), F.col(text))).otherwise(F.xxhash64(F.lit(seed), F.col(key)))
        rows = storage.written(docs.select(F.col(key).alias("key"), name.alias("source"), n_words(F.col(text)).alias("size"), hashed.alias("hash")), "sizes")
        sized = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most)
        placed = storage.written(ranks.ranked(rows, *map(F.col, ("source", "size", "hash", "key"))), "placed")
        lengths = placed.groupBy("source", "size").agg(F.min("_rank").alias("start"), F.count("*").alias("n"))
        plan = storage.written(plans(lengths.join(sized, "source"), seed, table), "plan")
        found = skew.counted_lookup(placed, plan, ["source", "size"], "n", plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        more = (F.col("_rank") - F.col("start") < F.col("picks")).cast("long")
        return keep(found.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * (F.col("passes") + more)).alias("taken")), "mixed")
