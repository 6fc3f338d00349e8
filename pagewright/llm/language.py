"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training reads a bounded sample of labelled rows: about ``SAMPLE`` of each language, those of smallest hash of their key.
Counts of (language, feature) are summed by Spark; the driver gets languages x FEATURES numbers at most and broadcasts the
matrix of log-probabilities. Scoring takes whole texts, in slices, as sparse (document, feature, count) triples.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text when nothing is
learned; equal best scores go to the first language by name; rows alike get the same answer; the table's other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

FEATURES, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
SAMPLE = 1500  # rows of each language to learn from, about
SLICE = 1 << 18  # characters looked at together
UNKNOWN = "und"
GUESS = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE characters."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < SLICE):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, features, counts), by document and feature: hashed n-grams of the lower-cased characters."""
    lowered = [(t or "").lower() for t in texts]
    of = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = []
    for order in ORDERS:
        m = len(chars) - order + 1
        if m <= 0:
            continue
        value = np.full(m, order, np.uint64)
        for k in range(order):
            value = (value ^ chars[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        inside = of[:m] == of[order - 1 :]
        found.append((of[:m] * FEATURES + (value & np.uint64(FEATURES - 1)).astype(np.int64))[inside])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    keys, times = np.unique(np.concatenate(found), return_counts=True)
    return keys // FEATURES, keys % FEATURES, times


class Model:
    """Languages and their log-probabilities: prior (languages) and matrix (FEATURES x languages)."""

    def __init__(self, counts: dict[str, np.ndarray], rows: dict[str, int]):
        """counts: by language, how often each feature was met; rows: by language, the labelled rows there are."""
        self.languages = sorted(counts)
        table = np.stack([counts[x] for x in self.languages], 1) + SMOOTHING if counts else np.zeros((FEATURES, 0))
        self.matrix = np.log(table / table.sum(0))
        total = sum(rows[x] for x in self.languages)
        self.prior = np.log([rows[x] / total for x in self.languages]) if counts else np.zeros(0)

    def guess(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text."""
        sums = np.tile(self.prior, (len(texts), 1))
        docs, found, times = features(texts)
        if len(docs) and self.languages:
            firsts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
            for j in range(len(self.languages)):
                sums[docs[firsts], j] += np.add.reduceat(self.matrix[found, j] * times, firsts)
        out = []
        for text, row in zip(texts, sums, strict=True):
            if not self.languages or not any(map(str.isalpha, text or "")):
                out.append((UNKNOWN, 0.0))
            else:
                best = int(row.argmax())
                out.append((self.languages[best], float(1 / np.exp(row - row[best]).sum())))
        return out


def fit(labelled: DataFrame, key: Column, sample: int = SAMPLE) -> Model:
    """Learns from (text, lang); rows with a null in either are passed over. key orders the rows of the sample."""
    kept = labelled.filter("text is not null and lang is not null").select("lang", "text", F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("_place"))
    rows = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not rows:
        return Model({}, {})
    cut = F.element_at(F.create_map(*(F.lit(x) for lang, n in rows.items() for x in (lang, int(min(1.0, sample / n) * (1 << 30))))), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to in parts(texts):
                docs, found, times = features(texts[at:to])
                for lang in set(langs[at:to]):
                    own = np.array([x == lang for x in langs[at:to]])[docs] if len(docs) else np.zeros(0, bool)
                    sums[lang] = sums.get(lang, 0) + np.bincount(found[own], times[own], FEATURES)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "feature", "n"])

    sampled = kept.filter(F.col("_place") < cut).select("lang", "text")
    summed = sampled.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = {}
    for r in summed.groupBy("lang").agg(F.collect_list("feature").alias("at"), F.collect_list("n").alias("n")).toLocalIterator():
        counts[r["lang"]] = np.zeros(FEATURES)
        counts[r["lang"]][np.array(r["at"], np.int64)] = r["n"]
    return Model(counts, rows)


def identified(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """docs with a struct column ``name`` (lang, score); a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(GUESS)
    def guess(column: pa.Array) -> pa.Array:
        langs, scores = [], []
        texts = column.to_pylist()
        for at, to in parts(texts):
            for lang, score in shared.value.guess(texts[at:to]):
                langs.append(lang)
                scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return docs.withColumn(name, guess(F.col(text)))


def fold(key: Column) -> Column:
    """The key's fold of four: crc32 of its text, mod 4; a null key is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(4)), F.lit(0))
