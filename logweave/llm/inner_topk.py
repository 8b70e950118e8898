"""Exact top-k inner products of integer vectors by branch and bound over vertical dimension blocks.

Every component x becomes ``floor(scale * x)``. A shard keeps its vectors vertically, one row per
dimension, dimensions of most mass first. Scores are accumulated dimension block by dimension block;
after each block a candidate's score can grow by at most the product of the remaining norms of query
and candidate (Cauchy-Schwarz), so a candidate whose bound lies under the k-th best exact score known
is gone. While most survive, a block is one matrix product for several queries; then the
survivors are compacted and only their columns are read. What is left has its exact score.

Candidates are dealt over shards of bounded size by a hash of the row (not of its id or value, so a
vector that fills a third of the table is spread), queries go to every shard and are streamed past
it: a task holds one shard and one batch, whatever the number of queries. Each shard returns its k
best, and Spark merges them. Before that every query gets a lower bound: its k-th best score among a
sample of ``SAMPLE_ROWS`` candidates; the sample changes speed only.

Sums are exact: in doubles while the norms' product is under 2**53, else in Python integers; a score
that no 64-bit integer holds is given as the nearest one.

Defined results: vectors null or holding null or non-finite components (also after scaling) and rows
without id take no part; zero and empty vectors do; only vectors of equal length are compared; rows
of the query's own id are no candidates; of several vectors of one query id the smallest asks; repeated
rows are all candidates; equal scores go to the smaller id; fewer than k candidates give fewer rows;
an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.blocks import map_arrow
from logweave.session import cut_lineage

SHARD_VALUES = 1 << 22  # components a shard holds, 32 MB as doubles
LEAST_ROWS = 4096
SAMPLE_ROWS = 2048
BLOCK_DIMS = 8
QUERIES_AT_ONCE = 16
COMPACT_SHARE = 0.3
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


class Shard:
    """Candidates of one length, stored one row per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.dims = ids, vectors.shape[1]
        mass = np.square(vectors).sum(axis=0)
        self.order = np.argsort(-mass, kind="stable")
        self.rows = np.ascontiguousarray(vectors[:, self.order].T)
        self.starts = list(range(0, self.dims, BLOCK_DIMS))
        self.left = self._remaining(self.rows)
        self.norm = float(self.left[0].max()) if self.dims and len(ids) else 0.0

    def _remaining(self, rows: np.ndarray) -> list[np.ndarray]:
        """Per block: the norm of each column's components from that block on; zeros at the end."""
        total = np.zeros(rows.shape[1])
        out = [total]
        for start in reversed(self.starts):
            total = total + np.square(rows[start : start + BLOCK_DIMS]).sum(axis=0)
            out.append(np.sqrt(total) * (1 + 1e-9))
        return out[::-1]

    def search(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """For each query: its place, its best candidates' columns in order, and their scores.

        ``floors``: scores under these are of no interest (-inf: none known).
        """
        norms = np.linalg.norm(queries, axis=1)
        exact = norms * self.norm < EXACT
        for at in np.flatnonzero(~exact):
            yield self._by_integers(int(at), int(ids[at]), queries[at], k)
        inside = np.flatnonzero(exact)
        for start in range(0, len(inside), QUERIES_AT_ONCE):
            some = inside[start : start + QUERIES_AT_ONCE]
            yield from self._by_blocks(some, ids[some], queries[some][:, self.order], floors[some], k)

    def _by_integers(self, at: int, own: int, query: np.ndarray, k: int) -> tuple[int, np.ndarray, list[int]]:
        whole = [int(x) for x in query[self.order]]
        scores = [sum(a * int(b) for a, b in zip(whole, column, strict=True)) for column in self.rows.T]
        found = sorted((i for i in range(len(scores)) if self.ids[i] != own), key=lambda i: (-scores[i], self.ids[i]))[:k]
        return at, np.array(found, np.int64), [max(-LONG - 1, min(LONG, scores[i])) for i in found]

    def _by_blocks(self, places: np.ndarray, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator:
        left = self._remaining(queries.T)
        floors = floors.copy()
        partial = np.zeros((len(queries), len(self.ids)))
        done, keep = 0, None
        while done < len(self.starts):
            block = slice(self.starts[done], self.starts[done] + BLOCK_DIMS)
            partial += queries[:, block] @ self.rows[block]
            done += 1
            bound = partial + left[done][:, None] * self.left[done]
            if done == 1:
                for i in range(len(queries)):
                    floors[i] = max(floors[i], self._floor(ids[i], queries[i], bound[i], k))
            keep = bound >= floors[:, None]
            if keep.mean() < COMPACT_SHARE:
                break
        for i, place in enumerate(places.tolist()):
            alive = np.arange(len(self.ids)) if keep is None else np.flatnonzero(keep[i])
            alive = alive[self.ids[alive] != ids[i]]
            score = partial[i, alive]
            for b in range(done, len(self.starts)):
                block = slice(self.starts[b], self.starts[b] + BLOCK_DIMS)
                score = score + queries[i, block] @ self.rows[block, alive]
                stays = score + left[b + 1][i] * self.left[b + 1][alive] >= floors[i]
                alive, score = alive[stays], score[stays]
            if len(alive) > k:  # ties at the border stay, the id decides
                stays = score >= np.partition(score, len(score) - k)[len(score) - k]
                alive, score = alive[stays], score[stays]
            best = np.lexsort((self.ids[alive], -score))[:k]
            yield place, alive[best], score[best].astype(np.int64).tolist()

    def _floor(self, own: int, query: np.ndarray, bound: np.ndarray, k: int) -> float:
        """The k-th best exact score among the candidates of highest bounds."""
        some = np.argpartition(bound, max(0, len(bound) - 8 * k))[max(0, len(bound) - 8 * k) :]
        some = some[self.ids[some] != own]
        if len(some) < k:
            return -np.inf
        return float(np.sort(query @ self.rows[:, some])[-k])


def _matrix(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).reshape(-1, dims) if dims else np.zeros((len(column), 0))


def _floors_from(sample: DataFrame, queries: DataFrame, k: int, scale: float) -> DataFrame:
    """Queries with ``floor``: the k-th best score among a bounded sample, null if it has fewer of their length."""
    by_dims: dict[int, list] = {}
    for row in sample.collect():  # at most SAMPLE_ROWS rows
        by_dims.setdefault(len(row["vector"]), []).append((row["vec_id"], row["vector"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {}
        for dims, rows in by_dims.items():
            vectors = np.floor(np.array([v for _, v in rows], np.float64).reshape(len(rows), dims) * scale)
            shards[dims] = Shard(np.array([i for i, _ in rows], np.int64), vectors)
        for batch in batches:
            floors: list[int | None] = [None] * batch.num_rows
            lengths = batch.column(2).to_numpy()
            for dims in set(lengths.tolist()) & shards.keys():
                rows = np.flatnonzero(lengths == dims)
                part = batch.take(pa.array(rows))
                ids = part.column(0).to_numpy()
                found = shards[dims].search(ids, _matrix(part.column(1), dims, scale), np.full(len(rows), -np.inf), k)
                for at, _, scores in found:
                    if len(scores) == k and abs(scores[-1]) < EXACT:
                        floors[rows[at]] = scores[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], names=["vec_id", "vector", "dims", "floor"])

    kind = queries.schema["vector"].dataType.simpleString()
    return map_arrow(queries, run, f"vec_id long, vector {kind}, dims int, floor long")


def _search_shards(rows: DataFrame, k: int, scale: float) -> DataFrame:
    """Stream (shard, dims, asks, vec_id, vector, floor), sorted, through one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, shard = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, dims, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            change = (np.diff(shards) != 0) | (np.diff(dims) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for first, last in zip(edges, edges[1:], strict=False):
                part = batch.slice(first, last - first)
                if (shards[first], dims[first]) != key:
                    key, ids, vectors, shard = (shards[first], dims[first]), [], [], None
                own, matrix = part.column(3).to_numpy(), _matrix(part.column(4), int(dims[first]), scale)
                if not asks[first]:
                    ids.append(own)
                    vectors.append(matrix)
                    continue
                if not ids:
                    continue
                if shard is None:
                    shard = Shard(np.concatenate(ids), np.concatenate(vectors))
                    vectors = []
                floors = part.column(5).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                asked, best, scored = [], [], []
                for at, found, scores in shard.search(own, matrix, floors, k):
                    asked += [own[at]] * len(found)
                    best.append(shard.ids[found])
                    scored += scores
                columns = [pa.array(asked, pa.int64()), pa.array(np.concatenate(best) if best else [], pa.int64()), pa.array(scored, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return map_arrow(rows, run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, asks: Column, k: int = 5, scale: float = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of every row for which ``asks`` holds: query_id, rank, vec_id, score."""
    vector = F.col(f"`{embedding}`")
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.where(usable(vector) & usable(scaled) & F.col(f"`{vec_id}`").isNotNull())
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        vector.alias("vector"), F.size(vector).alias("dims"), F.coalesce(asks, F.lit(False)).alias("asks"),
    )
    rows = cut_lineage(rows, "vectors")
    n, dims = rows.agg(F.count("*"), F.max("dims")).first()
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    per_shard = max(1, min(SHARD_VALUES // max(1, dims or 1), max(LEAST_ROWS, -(-n // parallel))))
    shards = max(1, -(-n // per_shard))

    queries = rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE_ROWS).select("vec_id", "vector")
    queries = cut_lineage(_floors_from(sample, queries.select("vec_id", "vector", "dims"), k, scale), "queries")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select(everywhere.alias("shard"), "dims", F.lit(True).alias("asks"), "vec_id", "vector", "floor")
    held = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "dims", F.lit(False).alias("asks"), "vec_id", "vector", F.lit(None).cast("long").alias("floor")
    )
    streams = held.unionByName(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "dims", "asks")
    found = _search_shards(streams, k, scale)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
