"""Approximate nearest neighbours by an inverted multi-index.

Each vector is cut into two halves, and each half has its own codebook of
``CENTROIDS`` points; a pair of centroids is a cell of the index.  A query visits
cells in the order of its summed squared distance to the two centroids, taken
one by one from a heap over the two sorted lists, until the visited cells hold
``SHARE`` of all entries, whatever the table's size (and ``LEAST`` = 10 times the answers at least).  The entries of those cells are
ranked again by the exact distance on the original vectors.

The codebooks are fitted on a bounded sample (``SAMPLE`` vectors, those whose ids
have the smallest hashes); every vector is indexed.  Cells are dealt to shards
of about ``SHARD`` entries; a larger cell gets shards of its own, so neither a
popular cell nor a vector repeated many times makes a large task.  A shard's
task holds its entries and streams the queries past them.  What is
broadcast is the codebooks and one row per cell (at most ``CENTROIDS`` squared).

Rules: vectors that are null, zero, or hold null or non-finite components, rows
without an id, and vectors whose length is not the commonest one (ties: the
smaller) take no part.  A query's own id is no candidate.  Rows repeating an id
count once per query, by their nearest vector; of a query id's rows the smallest
vector asks.  Ties in distance go to the smaller id.  Only the id and the vector are
read, extra columns of any name play no part.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolex.llm.common import cut, in_arrow, named, partitions, table

CENTROIDS, SAMPLE, ROUNDS = 64, 16384, 12
SHARE, LEAST = 0.6, 100
SHARD = 8192
TOP = 10


def usable(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, vector as doubles) of the rows that take part, and their length."""
    v = F.col("vector")
    rows = vectors.select(named(vec_id).cast("long").alias("vec_id"),
                          named(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(
        F.col("vec_id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0))
    commonest = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = commonest.n if commonest else 0
    # copies of a row count once, so that none of them can fill a shard
    return rows.filter(F.size("vector") == length).dropDuplicates(["vec_id", "vector"]), length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((points ** 2).sum(1)[:, None] + (centroids ** 2).sum(1) - 2 * points @ centroids.T, 0)


def halves(points: np.ndarray) -> list[np.ndarray]:
    cut_at = points.shape[1] // 2
    return [points[:, :cut_at], points[:, cut_at:]]


def codebook(points: np.ndarray, size: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """k-means; a centroid that nothing is nearest to stays where it was."""
    centroids = points[np.linspace(0, len(points) - 1, min(size, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = squared(points, centroids).argmin(1)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def fit(rows: DataFrame, sample: int = SAMPLE) -> list[np.ndarray]:
    """The two codebooks."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vector").limit(sample).select("vector").collect()  # SAMPLE rows
    points = np.array([r.vector for r in chosen], np.float64)
    return [codebook(half) for half in halves(points)]


def cells_of(points: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    first, second = (squared(h, b).argmin(1) for h, b in zip(halves(points), books))
    return first * len(books[1]) + second


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by rising first[i] + second[j] until they hold ``enough`` entries."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap, found, total = [(x[0] + y[0], 0, 0)], [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * len(b) + b[j]
        if counts[cell]:
            found.append(cell)
            total += counts[cell]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return found


def deal(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first shard and number of shards.  Cells share a shard while it
    has room; one with more than SHARD entries has its own."""
    first, pieces = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // SHARD))
    shard = room = 0
    for cell, n in enumerate(counts.tolist()):
        if n > room:
            shard, room = shard + 1, SHARD
        first[cell] = shard
        if pieces[cell] > 1:
            shard, room = shard + int(pieces[cell]) - 1, 0
        else:
            room -= n
    return first, pieces


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed component by component in order."""
    total = np.zeros(len(points))
    for k in range(points.shape[1]):
        total += (points[:, k] - query[k]) ** 2
    return np.sqrt(total)


def nearest(ids: np.ndarray, points: np.ndarray, query_id: int, query: np.ndarray, top: int) -> list[tuple[int, float]]:
    """The ``top`` nearest distinct ids but the query's own, ties to the smaller id."""
    rough = ((points - query) ** 2).sum(1)
    rough[ids == query_id] = np.inf
    kept, want = np.empty(0, np.int64), top
    while len(kept) < min(want, len(ids)):
        bound = np.partition(rough, min(want, len(ids)) - 1)[min(want, len(ids)) - 1]
        kept = np.flatnonzero(rough <= bound * (1 + 1e-9) + 1e-300)
        if len(np.unique(ids[kept])) < top and len(kept) < len(ids):
            want, kept = 2 * max(want, len(kept)), np.empty(0, np.int64)
    kept = kept[np.isfinite(rough[kept])]
    exact = distances(points[kept], query)
    found: dict[int, float] = {}
    for k in np.lexsort((ids[kept], exact)).tolist():
        found.setdefault(int(ids[kept[k]]), float(exact[k]))
        if len(found) == top:
            break
    return list(found.items())


def search(vectors: DataFrame, is_query: Callable[[Column], Column], top: int = TOP, share: float = SHARE,
           least: int = LEAST, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest entries found for each row whose id
    ``is_query``."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows, length = usable(vectors, vec_id, vector)
    if not length:
        return spark.createDataFrame([], out)
    books = spark.sparkContext.broadcast(fit(rows))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = cells_of(matrix(batch.column(1), length), books.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())],
                                                 names=["vec_id", "vector", "cell"])

    entries = cut(in_arrow(rows, assign, "vec_id long, vector array<double>, cell int"), "op10-entries")
    counts = np.zeros(len(books.value[0]) * len(books.value[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row per cell
        counts[r.cell] = r["count"]
    first, pieces = deal(counts)
    total = int(counts.sum())
    enough = min(total, max(least, int(np.ceil(share * total))))
    index = spark.sparkContext.broadcast((counts, first, pieces))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, start, several = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column(1), length)
            near = [squared(h, b) for h, b in zip(halves(points), books.value)]
            for i, query_id in enumerate(batch.column(0).to_pylist()):
                by_shard: dict[int, list[int]] = {}
                for cell in visited(near[0][i], near[1][i], size, enough):
                    for piece in range(int(several[cell])):
                        by_shard.setdefault(int(start[cell]) + piece, []).append(cell)
                n = len(by_shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(by_shard), pa.int32()), pa.array([query_id] * n, pa.int64()),
                     pa.array([points[i]] * n, pa.list_(pa.float64())),
                     pa.array(list(by_shard.values()), pa.list_(pa.int32()))],
                    names=["shard", "id", "vector", "cells"])

    queries = entries.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = in_arrow(queries, probe, "shard int, id long, vector array<double>, cells array<int>")
    per_cell = spark.createDataFrame([(c, int(first[c]), int(pieces[c])) for c in np.flatnonzero(counts).tolist()],
                                     "_cell int, _first int, _pieces int")
    held = entries.join(F.broadcast(per_cell), F.col("cell") == F.col("_cell")).select(
        (F.col("_first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("_pieces"))).cast("int").alias("shard"),
        F.col("vec_id").alias("id"), "vector", F.array("cell").alias("cells"))
    both = (held.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)))
            .repartition(partitions(spark), "shard").sortWithinPartitions("shard", "asks")
            .select("shard", "asks", "id", "vector", "cells"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard, each shard's entries before its queries."""
        shard, gathered, ready = None, [], None
        for batch in batches:
            key, asks, ids = (batch.column(c).to_numpy() for c in range(3))
            steps = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *steps.tolist()], [*steps.tolist(), len(key)]):
                if a == b:
                    continue
                if key[a] != shard:
                    shard, gathered, ready = key[a], [], None
                points = matrix(batch.column(3).slice(a, b - a), length)
                if not asks[a]:
                    gathered.append((ids[a:b], points, batch.column(4).slice(a, b - a).flatten().to_numpy()))
                    continue
                if not gathered:  # the hash left this piece of a large cell empty
                    continue
                if ready is None:
                    held_ids, held_points, held_cells = (np.concatenate(x) for x in zip(*gathered))
                    order = np.argsort(held_cells, kind="stable")
                    ready = held_ids[order], held_points[order], held_cells[order]
                made = []
                for i, cells in enumerate(batch.column(4).slice(a, b - a).to_pylist()):
                    inside = np.isin(ready[2], cells)
                    made += [(int(ids[a + i]), *x) for x in
                             nearest(ready[0][inside], ready[1][inside], ids[a + i], points[i], top)]
                if made:
                    q, v, s = zip(*made)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()),
                                                      pa.array(s, pa.float64())],
                                                     names=["query_id", "vec_id", "score"])

    found = in_arrow(both, rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))


def op10_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


#: Exact search, against which the tests measure recall.
EXACT_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(range(1, 65), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])),
                          lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
