"""Approximate nearest neighbours by collision counting over sorted single projections.

Every vector is projected on ``LINES`` random directions; the projections of a shard are kept as one
sorted array per line. A query opens a window centred on its own projection on every line
and counts, for each vector, on how many lines it falls into the window. Virtual rehashing
widens all windows by the factor ``GROWTH`` per round; only the newly covered ends of the arrays are
counted. Vectors with at least ``THRESHOLD`` of the lines are verified by their exact distance. The
search ends when the k-th verified distance is within the current radius: every true neighbour then
falls into a line's window with probability 0.77, and misses the threshold rarely.

Vectors are dealt by id hash into shards of about ``SHARD_ROWS``. Queries are sent to every shard
and streamed past its arrays, so a task holds one shard and one batch, whatever the number of
queries; each shard returns its k best and Spark merges them. Equal vectors need no care:
they stand side by side on every line.

Vectors of each length have shards of their own and are searched among themselves.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; of
several vectors of one query id the smallest asks; a query row is never its own neighbour (nor are rows of the same id); rows that repeat an
id count once, with their smallest distance; equal distances go to the smaller id; fewer than
k candidates give fewer rows; an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.blocks import map_arrow

LINES = 48
WIDTH = 2.4  # window width at radius 1
THRESHOLD = 0.65
GROWTH = 1.25
SHARD_ROWS = 16_384
SEED = 7


def usable(embedding: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def directions(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((LINES, dimension))


class Shard:
    """Sorted projections of a bounded set of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lines = directions(vectors.shape[1])
        projected = self.lines @ vectors.T
        self.order = np.argsort(projected, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        gaps = np.linalg.norm(vectors[: min(len(ids), 64)] - vectors[len(ids) // 2], axis=1)
        self.start = max(float(np.median(gaps)) / 4, 1e-6)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first."""
        n = len(self.ids)
        centre = self.lines @ query
        counts = np.zeros(n, np.int16)
        low = np.array([np.searchsorted(line, c) for line, c in zip(self.sorted, centre, strict=True)])
        high = low.copy()
        verified = np.zeros(n, bool)
        found, distance = np.zeros(0, np.int64), np.zeros(0)
        radius = self.start
        while True:
            for i in range(LINES):
                line, order = self.sorted[i], self.order[i]
                a = np.searchsorted(line, centre[i] - WIDTH * radius / 2, side="left")
                b = np.searchsorted(line, centre[i] + WIDTH * radius / 2, side="right")
                a, b = min(a, low[i]), max(b, high[i])
                counts[order[a : low[i]]] += 1
                counts[order[high[i] : b]] += 1
                low[i], high[i] = a, b
            fresh = np.flatnonzero((counts >= THRESHOLD * LINES) & ~verified)
            if len(fresh):
                verified[fresh] = True
                exact = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))
                keep = self.ids[fresh] != own
                found = np.concatenate([found, self.ids[fresh][keep]])
                distance = np.concatenate([distance, exact[keep]])
                order = np.lexsort((found, distance))
                found, distance = found[order], distance[order]
                _, first = np.unique(found, return_index=True)
                first = np.sort(first)
                # all at the k-th distance stay: ties are settled by id
                if len(first) > k:
                    first = first[: max(k, int(np.searchsorted(distance[first], distance[first][k - 1], side="right")))]
                found, distance = found[first], distance[first]
            if (len(found) >= k and distance[k - 1] <= radius) or verified.all():
                return found[:k], distance[:k]
            radius *= GROWTH
            if len(found) >= k:  # no need to pass the k-th distance by more than it takes
                radius = min(radius, max(float(distance[k - 1]), radius / GROWTH * 1.01))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found (columns vec_id, embedding)."""
    good = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = good.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dims"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    per_length = good.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    shards = max(1, per_length.agg(F.sum("shards")).first()[0] or 0)
    good = good.join(per_length, "dims")
    data = good.select("dims", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("part"), "vec_id", "embedding")
    # of several vectors of one id the smallest asks
    asked = good.where("asks").groupBy("vec_id").agg(F.min(F.struct("embedding", "dims", "shards")).alias("q"))
    asked = asked.select("q.dims", F.explode(F.sequence(F.lit(0), F.col("q.shards") - 1)).alias("shard"), F.lit(1).alias("part"), "vec_id", "q.embedding")
    both = data.unionByName(asked).repartition(shards, "dims", "shard").sortWithinPartitions("dims", "shard", "part", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, shard = None, [], None
        for batch in batches:
            dims, number, part, all_ids = (batch.column(c).to_numpy() for c in ("dims", "shard", "part", "vec_id"))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(number) != 0) | (np.diff(part) != 0)) + 1
            out = []
            for first, last in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if first == last:
                    continue
                if (dims[first], number[first]) != current:
                    current, gathered, shard = (dims[first], number[first]), [], None
                ids = all_ids[first:last]
                vectors = batch.column("embedding").slice(first, last - first).flatten().to_numpy().reshape(-1, dims[first])
                if part[first] == 0:
                    gathered.append((ids, vectors))
                    continue
                if shard is None and gathered:
                    shard = Shard(np.concatenate([g for g, _ in gathered]), np.concatenate([v for _, v in gathered]))
                    gathered = []
                if shard is not None:
                    out += [(int(i), *shard.search(int(i), v, k)) for i, v in zip(ids, vectors, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([q for q, _, _ in out], [len(f) for _, f, _ in out]).astype(np.int64)),
                    pa.array(np.concatenate([f for _, f, _ in out]).astype(np.int64)), pa.array(np.concatenate([d for _, _, d in out])),
                ], names=["query_id", "vec_id", "score"])

    found = map_arrow(both, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
