"""Approximate nearest neighbours by a layered navigable graph in each shard of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector import ASKED, PLACES, RECALL, against_shards, matrix, top_k

#: Vectors of a shard, links of a vector in the upper layers (twice as many in the lowest), and candidates that links are chosen from.
SHARD, LINKS, CANDIDATES = 8192, 16, 48
#: Widths of the beam that are tried in turn for a recall.
BEAMS = (32, 64, 128, 256, 512, 1024)
ROWS = 512
SEED = 7


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, a zero row stays zero."""
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def spread_links(x: np.ndarray, links: int) -> np.ndarray:
    """Places of at most `links` neighbours of each row, -1 where there are fewer.

    Of the nearest candidates, nearest first, one is linked unless a linked one is nearer to it than the row is: so links point into all directions. Room that is
    left goes to the nearest others, then to rows that link here.
    """
    n = len(x)
    c = min(CANDIDATES, n - 1)
    out = np.full((n, links), -1, np.int32)
    if c <= 0:
        return out
    for at in range(0, n, ROWS):
        block = x[at : at + ROWS]
        rows = np.arange(len(block))
        s = block @ x.T
        s[rows, at + rows] = -np.inf
        near = np.argpartition(-s, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        own = np.take_along_axis(s, near, axis=1)
        between = x[near] @ x[near].transpose(0, 2, 1)
        kept = np.zeros((len(block), c), bool)
        for t in range(c):
            hidden = (kept & (between[:, t] > own[:, t, None])).any(axis=1)
            kept[:, t] = ~hidden & (kept.sum(axis=1) < links)
        # Chosen ones first, then the rest, each nearest first.
        first = np.argsort(~kept, axis=1, kind="stable")[:, : min(links, c)]
        # Half of the room is for rows that link here.
        chosen = np.take_along_axis(near, first, axis=1)
        spare = np.arange(chosen.shape[1])[None] >= np.maximum(kept.sum(axis=1), links // 2)[:, None]
        out[at : at + ROWS, : chosen.shape[1]] = np.where(spare, -1, chosen)
    src, slot = np.nonzero(out >= 0)
    dst = out[src, slot]
    free = (out < 0).sum(axis=1)
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order].astype(np.int64)
    new = ~(out[dst] == src[:, None]).any(axis=1)
    src, dst = src[new], dst[new]
    first = np.searchsorted(dst, dst)
    rank = np.arange(len(dst)) - first
    fits = rank < free[dst]
    out[dst[fits], links - free[dst[fits]] + rank[fits]] = src[fits]
    return out


class LayeredGraph:
    """Layers of links: all rows in the lowest, one in LINKS of a layer's rows in the one above, drawn by their ids."""

    def __init__(self, ids: pa.Array, v: np.ndarray):
        self.ids, self.x = ids, unit(v)
        n = len(self.x)
        draw = np.random.default_rng(SEED).random(n)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        members, level = np.arange(n), 0
        while True:
            links = spread_links(self.x[members], 2 * LINKS if level == 0 else LINKS)
            self.layers.append((members, np.where(links >= 0, members[links], -1)))
            level += 1
            above = np.flatnonzero(draw < LINKS ** -float(level))
            if len(above) < 2 or len(above) == len(members):
                break
            members = above

    def beam(self, q: np.ndarray, layer: int, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, scores, rows scored) of the best `width` found for each query: from its start, the best row not yet opened is opened until none of the beam is left."""
        members, links = self.layers[layer]
        place = np.full(len(self.x), -1, np.int64)
        place[members] = np.arange(len(members))
        nq = len(q)
        at = np.full((nq, width), -1, np.int64)
        score = np.full((nq, width), -np.inf, np.float32)
        opened = np.ones((nq, width), bool)
        seen = np.zeros((nq, len(self.x)), bool)
        for i in range(start.shape[1]):
            own = start[:, i]
            fresh = (own >= 0) & ~seen[np.arange(nq), own]
            at[:, i] = np.where(fresh, own, -1)
            score[:, i] = np.where(fresh, np.einsum("ij,ij->i", q, self.x[own]), -np.inf)
            opened[:, i] = ~fresh
            seen[np.flatnonzero(fresh), own[fresh]] = True
        scored = seen.sum(axis=1)
        while True:
            waiting = np.where(opened, -np.inf, score)
            pick = waiting.argmax(axis=1)
            live = np.flatnonzero(waiting[np.arange(nq), pick] > -np.inf)
            if not len(live):
                return at, score, scored
            pick = pick[live]
            opened[live, pick] = True
            near = links[place[at[live, pick]]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            row, col = np.nonzero(fresh)
            seen[live[row], near[row, col]] = True
            scored[live] += fresh.sum(axis=1)
            s = np.full(near.shape, -np.inf, np.float32)
            s[row, col] = np.einsum("ij,ij->i", q[live[row]], self.x[near[row, col]])
            both = np.concatenate([score[live], s], axis=1)
            best = np.argpartition(-both, width - 1, axis=1)[:, :width]
            at[live] = np.take_along_axis(np.concatenate([at[live], np.where(fresh, near, -1)], axis=1), best, axis=1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], ~fresh], axis=1), best, axis=1)
            score[live] = np.take_along_axis(both, best, axis=1)

    def search(self, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, scores, rows scored) of k a query, -1 where there are fewer: down the layers by the nearest row, then a beam in the lowest."""
        q = unit(q)
        at = np.full((len(q), 1), self.layers[-1][0][0], np.int64)
        total = np.zeros(len(q), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            at, score, scored = self.beam(q, layer, at, 4)
            at = np.take_along_axis(at, np.argsort(-score, axis=1, kind="stable"), axis=1)
            total += scored
        at, score, scored = self.beam(q, 0, at, max(k, width))
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(at, order, axis=1), np.take_along_axis(score, order, axis=1), total + scored


def graph_search(vectors: DataFrame, queries: DataFrame, k: int = 10, width: int = 128, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), id, score, scored of the k nearest by cosine that a graph search finds; scored is the number of vectors compared for the query in all.

    Each shard of about `shard` vectors moves once and becomes a LayeredGraph; queries stream past it, and shards' answers are merged by rank. Null
    vectors, and queries that are null, are left out; a zero vector has cosine 0. Ties go to the smaller id among those found.
    """
    kind, qkind = (df.schema[c].dataType.simpleString() for df, c in ((vectors, id_col), (queries, query_col)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    asked = queries.select(F.col(query_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x

    def ask(graph: LayeredGraph, names: pa.Array, v: pa.Array) -> Iterator[pa.RecordBatch]:
        q = matrix(v)
        for at in range(0, len(q), ROWS):
            places, score, scored = graph.search(q[at : at + ROWS], k, width)
            row, col = np.nonzero(places >= 0)
            yield pa.RecordBatch.from_arrays([names.slice(at, ROWS).take(pa.array(row)), graph.ids.take(pa.array(places[row, col])), pa.array(np.round(score[row, col].astype(np.float64), PLACES)), pa.array(np.where(col == 0, scored[row], 0))], ["query_id", "id", "score", "scored"])

    found = against_shards(rows, asked, shard, lambda ids, v: LayeredGraph(flat(ids), matrix(v)), ask, f"query_id {qkind}, id {kind}, score double, scored long")
    by = Window.partitionBy("query_id")
    found = found.withColumn("scored", F.sum("scored").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "id")))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "scored")


def width_for(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", shard: int = SHARD) -> int:
    """The first of BEAMS that finds a share `recall` of the true k nearest of ASKED queries, which are drawn by a hash; the last if none does."""
    drawn = queries.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(query_col)).limit(ASKED)
    exact = top_k(vectors, drawn, k, "cosine", None, id_col, vector_col, query_col).select("query_id", "id").persist()
    wanted = exact.count()
    for width in BEAMS:
        hit = graph_search(vectors, drawn, k, width, id_col, vector_col, query_col, shard).join(exact, ["query_id", "id"]).count()
        if hit >= recall * wanted:
            break
    exact.unpersist()
    return width
