"""Target-distribution importance resampling over hashed n-grams of words.

Texts are read where they lie, once for the counts by bucket and once for the weights, and are never shuffled or written: identical texts
are worked out each, which costs less than to bring all texts together. The draw is the head of an order over all documents (ranks.ranked): one range shuffle of numbers.

The driver sees BUCKETS counts at most of each table; they are sent to tasks as BUCKETS gains.

Defined results: null texts count as empty, texts without words have no features and weight 0; rows alike in id and text get
scores alike and ranks one after the other; a null doc_id seeds its noise with ``<seed>:`` and comes last among ties; empty tables of either
kind count nothing (all gains follow from smoothing alone); other columns of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import crc, ranks, storage
from .text import Texts, slices

BUCKETS, ORDERS = 10_000, 3  # buckets of features; words of the longest feature
LEAST_WORDS, PERCENT, SEED = 20, 5, 42  # words of a text that can be drawn, percent of those to draw

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.ones(256, bool)  # what parts words: all of ASCII but digits and small letters
_GAP[128:] = _GAP[48:58] = _GAP[97:123] = False


def buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, documents, buckets): an entry for each run of 1 to ORDERS words."""
    lowered = Texts(_LOWER[texts.data], texts.offsets)
    starts, ends, docs = lowered.spans(_GAP)
    lengths = ends - starts
    word = crc.crc32(lowered.data, starts, ends)
    space = crc.crc32(np.array([32], np.uint8), np.array([0]), np.array([1]))
    spaced = crc.moved(np.repeat(space, len(word)), lengths) ^ word  # of a space and the word
    run, of, hashes = word, [docs], [word]
    for order in range(1, ORDERS):
        m = max(0, len(word) - order)
        run = crc.moved(run[:m], lengths[order:] + 1) ^ spaced[order:]
        inside = docs[:m] == docs[order:]
        of.append(docs[:m][inside])
        hashes.append(run[inside])
    return np.bincount(docs, minlength=texts.n), np.concatenate(of), (np.concatenate(hashes) % np.uint32(BUCKETS)).astype(np.int64)


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket's features are in the only column of texts; null is the empty text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, some in slices(batch.column(0)):
                sums += np.bincount(buckets(some)[2], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums)], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))), in doubles."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight) of rows (key, text)."""
    shared = storage.broadcast(rows.sparkSession, gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column(1)):
                words, docs, found = buckets(texts)
                features = np.bincount(docs, minlength=texts.n)
                weight = np.bincount(docs, shared.value[found], texts.n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], *map(pa.array, (words, features, weight))], ["key", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, f"key {dict(rows.dtypes)['key']}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h being the first 32 bits of the SHA-256 of ``seed:key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of each document; rank counts from 1 for the drawn ``percent`` of those with ``least`` words, else it is null."""
    with storage.scratch(docs.sparkSession) as keep:
        gain = gains(counts(docs.select(text)), counts(target.select(text)))
        rows = weighed(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), gain)
        score = F.col("weight") + noise(F.col("key"), seed)
        scored = storage.written(rows.withColumn("score", score), "scored")
        able = scored.filter(F.col("n_words") >= least)
        placed = ranks.ranked(able, F.col("score").desc(), F.col("key").asc_nulls_last())
        drawn = able.count() * percent // 100
        rank = F.when(F.col("_rank") < drawn, F.col("_rank") + 1)
        both = placed.withColumn("rank", rank).drop("_rank").unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
        return keep(both.select(F.col("key").alias(key), "n_features", "weight", "score", "rank"), "resampled")
