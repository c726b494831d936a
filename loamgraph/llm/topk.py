"""Exact top-k inner products over an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vector import against_shards

#: Vectors of one index shard.
SHARD = 8192
#: Levels of quantised impact in a posting list, and passes over descending impact.
LEVELS = 16
PASSES = 6


class ImpactIndex:
    """Posting lists of one shard: for each dimension its vectors by quantised component.

    A list read from its top serves positive query weights, from its bottom
    negative ones, so that gains over the least possible contribution come in descending segments.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        self.level = ((vectors - self.low) // width).astype(np.int8)
        self.order = np.argsort(self.level, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)
        #: Where each level begins in its dimension's list.
        self.begin = np.zeros((dims, LEVELS + 1), np.int64)
        for d in range(dims):
            self.begin[d, 1:] = np.cumsum(np.bincount(self.level[:, d], minlength=LEVELS))
        edge = np.arange(LEVELS + 1)
        self.least = self.low[:, None] + edge[:-1] * width[:, None]
        self.most = np.minimum(self.low[:, None] + edge[1:] * width[:, None] - 1, self.high[:, None])

    def possible(self, query: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
        """Indices of vectors that may be among the k best; all others are proved not to be.

        After each pass a vector's score lies between what its processed postings
        gained and that plus, for each open dimension, the most an open
        segment there can gain. A vector whose upper bound is below the k-th lower bound is out.
        """
        n, dims = self.vectors.shape
        alive = np.flatnonzero(~skip)
        if len(alive) <= k:
            return alive
        used = np.flatnonzero(query)
        up = query > 0
        # The most that a segment's postings gain over the dimension's least contribution.
        gain = np.where(up[:, None], query[:, None] * (self.most - self.low[:, None]), query[:, None] * (self.least - self.high[:, None]))
        floor = np.where(up, query * self.low, query * self.high)
        gained = np.zeros(n, np.int64)
        counts = np.diff(self.begin, axis=1)
        impacts = gain[used].ravel()
        by = np.argsort(-impacts, kind="stable")
        load = np.cumsum(counts[used].ravel()[by])
        cuts = [int(impacts[by[min(np.searchsorted(load, load[-1] * (p + 1) / PASSES), len(by) - 1)]]) for p in range(PASSES)] if len(used) else []
        done = np.zeros(dims, np.int64)
        exact = np.abs(gain).max(axis=1).sum() < 2**53
        for least_gain in cuts:
            # Levels of each dimension whose segments gain as much as this pass asks.
            reach = (gain >= least_gain).sum(axis=1)
            for d in used:
                a, b = done[d], reach[d]
                if b <= a:
                    continue
                at = slice(self.begin[d, LEVELS - b], self.begin[d, LEVELS - a]) if up[d] else slice(self.begin[d, a], self.begin[d, b])
                gained[self.order[d, at]] += query[d] * self.values[d, at] - floor[d]
                done[d] = b
            open_ = used[done[used] < LEVELS]
            nearest = np.where(up[open_], LEVELS - 1 - done[open_], done[open_])
            rest = gain[open_, nearest]
            level = self.level if len(alive) == n else self.level[alive]
            # Open postings: below the next level from the top, or at and above it from the bottom.
            edge = np.where(up, LEVELS - done, done).astype(np.int8)
            pending = (level < edge) == up
            weight = np.zeros(dims)
            weight[open_] = rest
            lower = gained[alive]
            upper = lower + (pending.astype(np.float64) @ weight if exact else (pending.astype(np.float64) @ weight) * (1 + 2.0**-40))
            alive = alive[upper >= np.partition(lower, len(lower) - k)[len(lower) - k]]
            if len(alive) <= max(k, n // 8):
                break
        return alive

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best, higher score first, then smaller id."""
        at = self.possible(query, k, ids == own)
        scores = self.vectors[at] @ query
        best = np.lexsort((ids[at], -scores))[:k]
        return ids[at][best], scores[best]


def integers(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def whole(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy()
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Vectors are dealt into shards of bounded size, each of which moves and is indexed once; the queries stream past every shard, which gives k rows a query.
    Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part. Shorter vectors count as ending in zeros. Rows with the query's own id are no
    candidates; an id repeated among queries is asked once, with its
    least vector; repeated candidates each count. Components so large that a score might not fit 64 bits are refused with an error. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & whole(F.col("v")))
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    dims, most = size.dims or 1, (size.most or 0.0) * scale + 1
    if most >= 2.0**31 or dims * most**2 >= 2.0**63:
        raise ValueError("scores of these vectors may not fit 64 bits")
    rows = rows.select("id", "asks", integers(F.col("v"), scale).alias("v"))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))

    def ask(made: tuple[np.ndarray, ImpactIndex], names: pa.Array, v: pa.Array) -> Iterator[pa.RecordBatch]:
        ids, index = made
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own, query in zip(names.to_numpy(zero_copy_only=False), _matrix(v, dims), strict=True):
            found, scores = index.search(query, k, ids, own)
            out.append((np.full(len(found), own), found, scores))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    near = against_shards(rows.select("id", "v"), asked, SHARD, lambda ids, v: (ids.to_numpy(), ImpactIndex(_matrix(v, dims))), ask, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
