"""Nearest vectors against brute force, and the index's recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import vectors

SF = "/root/testdata/sf0.1"


def brute(rows, asks, k):
    """Sorted (key, rank, neighbor, similarity)."""
    width = next((len(v) for key, v in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0])), 0)
    fit = [(key, np.array(v, float) / np.linalg.norm(np.array(v, float))) for key, v in rows if key is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for key, v in fit:
        if asks(key):
            near = sorted((-round(float(v @ w), 9), other) for other, w in fit if other != key)[:k]
            out += [(key, i + 1, other, -s + 0.0) for i, (s, other) in enumerate(near)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, list int, row string")


def some():
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 5)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(300, 500)]  # a group of copies
    return rows + [(0, rows[1][1]), (7, rows[7][1]), (501, None), (502, [1.0]), (503, [0.0] * 5), (504, [float("nan")] * 5), (505, [1.0, None, 1.0, 1.0, 1.0]), (506, [float("inf")] * 5), (None, [1.0] * 5)]


@pytest.mark.parametrize(("per", "asked"), [(8192, 2048), (40, 7)])
def test_exact_against_brute_force(spark, monkeypatch, per, asked):
    monkeypatch.setattr(vectors, "ROWS", per)
    monkeypatch.setattr(vectors, "ASKED", asked)
    rows = some()
    got = vectors.neighbors(table(spark, rows).repartition(5), F.col("vec_id") % 10 == 0, 6).collect()
    want = brute(rows, lambda key: key % 10 == 0, 6)
    assert np.allclose(sorted(map(tuple, got)), want) and len({r[0] for r in want}) > 40


def test_index_finds_all_when_it_looks_everywhere(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 30)
    rows = some()
    frame = table(spark, rows)
    index = vectors.fit(vectors.usable(frame, "vec_id", "embedding"), 6, lists=9)
    assert index.centroids.shape == (9, 5) and np.allclose(np.linalg.norm(index.centroids, axis=1), 1)
    got = vectors.neighbors(frame, F.col("vec_id") % 10 == 0, 6, vectors.Index(index.centroids, 9)).collect()
    assert np.allclose(sorted(map(tuple, got)), brute(rows, lambda key: key % 10 == 0, 6))


def recall(spark, frame, asks):
    exact = {(r.vec_id, r.neighbor) for r in vectors.neighbors(frame, asks).collect()}
    found = {(r.vec_id, r.neighbor) for r in vectors.related(frame, asks).collect()}
    return len(exact & found) / len(exact)


def test_recall_on_the_given_vectors(spark):
    assert recall(spark, spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 50 == 0) >= 0.9


def test_recall_and_few_probes_on_clusters(spark):
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centers[i % 40] + 0.2 * draw.normal(size=16)]) for i in range(4000)]
    frame = table(spark, rows).cache()
    index = vectors.fit(vectors.usable(frame, "vec_id", "embedding"), sample=1500)
    assert index.probes <= len(index.centroids) // 4
    assert recall(spark, frame, F.col("vec_id") % 50 == 0) >= 0.9
    frame.unpersist()


def test_small_tables(spark):
    none = table(spark, [])
    assert vectors.neighbors(none, F.lit(True)).collect() == [] and vectors.related(none, F.lit(True)).collect() == []
    one = table(spark, [(1, [1.0, 0.0])])
    assert vectors.related(one, F.lit(True)).collect() == []
    two = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 2.0])])
    assert sorted(map(tuple, vectors.related(two, F.lit(True)).collect())) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]
