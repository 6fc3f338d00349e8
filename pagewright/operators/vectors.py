"""Related notes: the nearest vectors by cosine, over all vectors or through an inverted-file index.

The index has centroids, fitted by spherical k-means on a bounded sample: about ``SAMPLE`` vectors, those of smallest hash of their key. Every vector goes to the list of
its nearest centroid. A query looks into the ``probes`` nearest lists; how many is measured when the index is fitted: the fewest for which
the sample's own queries find ``RECALL`` of their true neighbours in the sample. Vectors without clusters need many lists, clustered ones a few.

A search is cut into cells of about ``ROWS`` vectors and ``ASKED`` queries of one list: a list that holds a third of all rows is many cells.
Each cell is one matrix product and keeps ``k`` rows a query; the best of those are the result (partial ranks before the shuffle). The exact search
is the same with one list for all. Similarities are of doubles, rounded to ``DIGITS`` digits; equal ones go by key, so results do not depend on how rows are dealt.

Defined results: null vectors, those with a null, infinite or NaN part, of another width than the first by key or of length 0 neither ask nor are found; a vector is not
found by its own key, whichever row that is in; rows of one key are each a vector, and ask once each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

SAMPLE, MOST_LISTS, ROUNDS = 20_000, 1024, 10  # vectors to fit on, about; lists at most; rounds of k-means
RECALL, TRIED = 0.95, 256  # recall that probes are chosen for, on so many queries of the sample
ROWS, ASKED, DIGITS = 8192, 2048, 9
FOUND = "query long, row long, neighbor long, similarity double"


@dataclass(frozen=True)
class Index:
    """Unit centroids (lists x width), and how many lists a query looks into."""

    centroids: np.ndarray
    probes: int

    def nearest(self, units: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each unit vector, nearest first."""
        near = units @ self.centroids.T
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector array<double>) of the rows that can be compared."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter("key is not null and vector is not null")
    width = rows.agg(F.min_by(F.size("vector"), "key")).first()[0]
    broken = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = rows.filter((F.size("vector") == (width or 0)) & ~F.exists("vector", broken))
    return fit.filter(F.exists("vector", lambda x: x != 0))


def units(column: pa.Array) -> np.ndarray:
    """A list column as unit rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    matrix = matrix / np.abs(matrix).max(1, keepdims=True) if len(column) else matrix
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def fit(rows: DataFrame, k: int = 10, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> Index:
    """An index for (key, vector) of ``usable``; lists: about the square root of the rows if none is given, MOST_LISTS at most."""
    n = rows.count()
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    kept = rows.filter(place < int(min(1.0, sample / max(n, 1)) * (1 << 30))).select("vector", "key").toArrow()  # about `sample` rows
    if not kept.num_rows:
        return Index(np.zeros((1, 0)), 1)
    order = np.argsort(kept.column("key").to_numpy(), kind="stable")
    seen = units(kept.column("vector"))[order]
    centroids = k_means(seen, min(lists or max(1, round(n**0.5)), MOST_LISTS, len(seen)))
    return Index(centroids, probes_for(seen, centroids, k, recall))


def k_means(points: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of unit points; begins with points spread over their order. A list that loses its points keeps its centroid."""
    centroids = points[np.linspace(0, len(points) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        of = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(points, len(points) // 4096 + 1)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    return centroids


def probes_for(points: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists that hold so much of the true neighbours of TRIED points among the others."""
    asked = np.linspace(0, len(points) - 1, min(TRIED, len(points))).astype(int)
    of = Index(centroids, 1).nearest(points, 1)[:, 0]
    order = np.argsort(Index(centroids, 1).nearest(points[asked], len(centroids)), axis=1)  # of each list, its place
    near = points[asked] @ points.T
    near[np.arange(len(asked)), asked] = -2
    k = min(k, len(points) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    places = np.take_along_axis(order, of[best], 1)
    held = np.bincount(places.ravel(), minlength=len(centroids)).cumsum() / places.size
    return int(np.searchsorted(held, recall)) + 1


def _with_lists(rows: DataFrame, index: Index | None, probes: int) -> DataFrame:
    """(key, vector, list): a row for each of its nearest lists; all in list 0 without an index."""
    if index is None:
        return rows.withColumn("list", F.lit(0))
    shared = rows.sparkSession.sparkContext.broadcast(index)  # MOST_LISTS centroids at most

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array) -> pa.Array:
        found = shared.value.nearest(units(vectors), probes).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    return rows.withColumn("list", F.explode(nearest("vector")))


def best_of(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a cell for each of its queries: similarity down, then key up."""
    asked, keys = queries.column("key").to_numpy(), rows.column("key").to_numpy()
    if not len(asked) or not len(keys):
        return pa.table({c: np.zeros(0, kind) for c, kind in (("query", np.int64), ("row", np.int64), ("neighbor", np.int64), ("similarity", float))})
    order = np.argsort(keys, kind="stable")
    keys, matrix, mine, out = keys[order], units(rows.column("vector"))[order], units(queries.column("vector")), []
    row = queries.column("row").to_numpy()
    for at in range(0, len(asked), 256):
        near = np.round(mine[at : at + 256] @ matrix.T, DIGITS) + 0.0  # no negative zero
        near[asked[at : at + 256, None] == keys] = -2
        if len(keys) > k:
            least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            ahead = near > least
            tied = (near == least) & (np.cumsum(near == least, axis=1) <= k - ahead.sum(1, keepdims=True))  # the first by key
            near = np.where(ahead | tied, near, -2)
        i, j = np.nonzero(near > -2)
        out.append((asked[at + i], row[at + i], keys[j], near[i, j]))
    return pa.table(dict(zip(("query", "row", "neighbor", "similarity"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _cells(rows: DataFrame, other: DataFrame, own: str, theirs: str, per: int, per_other: int) -> DataFrame:
    """rows with a cell number of their own in their list, once for each cell number of the others."""
    counts = other.groupBy("list").agg(F.ceil(F.count("*") / per_other).cast("int").alias("_cells"))
    size = rows.groupBy("list").agg(F.ceil(F.count("*") / per).cast("int").alias("_own"))
    cut = rows.join(F.broadcast(size.join(counts, "list")), "list")  # a row a list, MOST_LISTS at most
    cut = cut.withColumn(own, F.pmod(F.xxhash64("key", "row"), F.col("_own")).cast("int"))
    return cut.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells", "_own")


def neighbors(vectors: DataFrame, asks: Column, k: int = 10, index: Index | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, rank, neighbor, similarity): the k most similar rows of each row for which ``asks`` holds; exact without an index."""
    rows = usable(vectors, key, vector).withColumn("row", F.monotonically_increasing_id())
    asked = usable(vectors.filter(asks), key, vector).withColumn("row", F.monotonically_increasing_id())
    held, wanted = _with_lists(rows, index, 1), _with_lists(asked, index, index.probes if index else 1)
    names = ["list", "cell", "ask"]

    def search(queries: pa.Table, found: pa.Table) -> pa.Table:
        return best_of(queries, found, k)

    left = _cells(wanted, held, "ask", "cell", ASKED, ROWS).groupBy(*names)
    right = _cells(held, wanted, "cell", "ask", ROWS, ASKED).groupBy(*names)
    met = left.cogroup(right).applyInArrow(search, FOUND)
    order = W.partitionBy("query", "row").orderBy(F.desc("similarity"), "neighbor")
    best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("query").alias(key), F.col("rank").cast("long").alias("rank"), "neighbor", "similarity")


def related(vectors: DataFrame, asks: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """``neighbors`` through an index that is fitted here; options: of ``fit``."""
    return neighbors(vectors, asks, k, fit(usable(vectors, key, vector), k, **options), key, vector)
