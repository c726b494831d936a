"""Approximate nearest neighbours on product-quantised vectors in the cells of an inverted file, rescored exactly."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .vector import ASKED, PLACES, RECALL, cosine, matrix, top_k

#: Vectors of which codebooks and cells are learnt, at most; every vector is coded.
SAMPLE, ROUNDS = 16384, 8
#: Entries of a codebook: one byte each.
ENTRIES = 256
#: Candidates for each of the k asked for that are rescored.
FACTOR = 20
#: Rows of one cell that one task scores, and queries that it scores at once.
PART, ROWS = 8192, 256
SEED = 3


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of the rows by squared distance, fewer if there are fewer rows; an empty one takes the row that is farthest off."""
    rng = np.random.default_rng(SEED)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near, d = closest(x, c)
        count = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        empty = np.flatnonzero(count == 0)
        c[empty] = x[np.argsort(-d, kind="stable")[: len(empty)]]
    return c


def closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * x @ c.T
    near = d.argmin(axis=1)
    return near, d[np.arange(len(x)), near]


class Codebooks:
    """A coarse centre a cell, and for each part of the components a codebook of what the centre leaves.

    A vector is coded as one byte a part. The inner product with a query is that of its centre plus, for each part, a table's entry: the
    query's part times each of the codebook's. Vectors and queries have length one, so it stands for the cosine.
    """

    def __init__(self, sample: np.ndarray, cells: int, parts: int):
        dims = sample.shape[1]
        if not 0 < parts <= dims:
            raise ValueError("a part needs a component")
        x = unit(sample)
        self.bounds = [dims * i // parts for i in range(parts + 1)]
        self.cells = means(x, cells)
        left = x - self.cells[closest(x, self.cells)[0]]
        self.books = [means(left[:, a:b], ENTRIES) for a, b in zip(self.bounds, self.bounds[1:])]

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of each row."""
        x = unit(v)
        cell = closest(x, self.cells)[0]
        left = x - self.cells[cell]
        codes = [closest(left[:, a:b], book)[0] for a, b, book in zip(self.bounds, self.bounds[1:], self.books)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.cells[cell] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """queries x rows of one cell, by tables."""
        out = np.repeat((q @ self.cells[cell])[:, None], len(codes), axis=1)
        for i, (a, b, book) in enumerate(zip(self.bounds, self.bounds[1:], self.books)):
            out += (q[:, a:b] @ book.T)[:, codes[:, i]]
        return out


class QuantisedIndex:
    """Coded vectors by cell: codes (id, cell, code) are a table; the codebooks, of a fixed size, are broadcast.

    Cells grow with the root of the number of vectors, from `cells_of`. The codebooks are learnt of SAMPLE vectors at most, drawn by a hash of the
    id. Null vectors are left out; all others must be equally long; a zero vector has cosine 0.
    """

    def __init__(self, vectors: DataFrame, parts: int = 16, cells: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.id_col, self.vector_col = id_col, vector_col
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
        got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        cells = cells or cells_of(rows.count())
        self.books = Codebooks(np.array([r["v"] for r in got], np.float64), cells, parts) if got else None
        told = rows.sparkSession.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, codes = told.value.encode(matrix(batch.column(1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "cell", "code"])

        self.codes = rows.mapInArrow(run, StructType([rows.schema["id"], StructField("cell", IntegerType()), StructField("code", BinaryType())]))

    def candidates(self, queries: DataFrame, keep: int, probes: int, query_col: str = "query_id") -> DataFrame:
        """query_id, id, score of the `keep` best codes a query in the `probes` cells nearest to it.

        A cell's rows are cut into parts of bounded size; queries go to each part of the cells they probe, and stream past its codes. A part keeps `keep` a query.
        """
        asked = queries.select(F.col(query_col).alias("query"), F.col(self.vector_col).alias("q")).where("q is not null")
        told = asked.sparkSession.sparkContext.broadcast(self.books)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = told.value.cells
                    near = np.argsort(-(unit(matrix(batch.column(1))) @ cells.T), axis=1, kind="stable")[:, :probes]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], ["query", "q", "cell"])

        probed = asked.mapInArrow(probe, StructType([*asked.schema.fields, StructField("cell", IntegerType())]))
        # A row a cell, whose number is bounded by MOST_CELLS.
        parts = F.broadcast(self.codes.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
        nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
        held = self.codes.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "id", "code", nothing(asked, "query"), nothing(asked, "q"))
        each = probed.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), nothing(self.codes, "id"), nothing(self.codes, "code"), "query", "q")
        both = held.unionByName(each).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids, codes = None, [], []
            for batch in batches:
                keys = [batch.column(c).to_numpy() for c in ("cell", "part", "kind")]
                cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
                for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    if begin == end:
                        continue
                    here = (keys[0][begin], keys[1][begin])
                    if here != now:
                        now, ids, codes = here, [], []
                    part = batch.slice(begin, end - begin)
                    if keys[2][begin] == 0:
                        ids.append(part.column("id"))
                        codes += part.column("code").to_pylist()
                        continue
                    if not codes:
                        continue
                    own = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
                    names = pa.concat_arrays(ids)
                    q = unit(matrix(part.column("q")))
                    for at in range(0, len(q), ROWS):
                        s = told.value.scores(q[at : at + ROWS], int(now[0]), own)
                        n = min(keep, s.shape[1])
                        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                        row = np.repeat(np.arange(len(best)), n)
                        yield pa.RecordBatch.from_arrays([part.column("query").slice(at, ROWS).take(pa.array(row)), names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, axis=1).ravel())], ["query_id", "id", "score"])

        kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query"), (self.codes, "id"))]
        found = both.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")

    def top_k(self, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, factor: int = FACTOR, rescored: bool = True, query_col: str = "query_id", recall: float = RECALL) -> DataFrame:
        """query_id, rank (from 1), id, score: as vector.top_k() with cosine, of the `factor` times k best codes; without `rescored` the k best by their codes alone.

        Without `probes` so many cells are probed as probes_for() finds for the recall.
        """
        if self.books is None:
            return top_k(vectors, queries, k, "cosine", None, self.id_col, self.vector_col, query_col)
        if probes is None:
            probes = self.probes_for(vectors, queries, k, recall, factor, query_col)
        found = self.candidates(queries, k * factor if rescored else k, probes, query_col)
        if rescored:
            q = queries.select(F.col(query_col).alias("query_id"), F.col(self.vector_col).alias("q"))
            v = vectors.select(F.col(self.id_col).alias("id"), F.col(self.vector_col).alias("v"))
            found = found.drop("score").join(v, "id").join(q, "query_id").select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("score"))
        found = found.withColumn("score", F.round("score", PLACES))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def probes_for(self, vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, factor: int = FACTOR, query_col: str = "query_id") -> int:
        """The first number of cells, doubled from one, in which the search finds a share `recall` of the true k nearest of ASKED queries, which are drawn by a hash; all if none does."""
        drawn = queries.where(F.col(self.vector_col).isNotNull()).orderBy(F.xxhash64(query_col)).limit(ASKED)
        exact = top_k(vectors, drawn, k, "cosine", None, self.id_col, self.vector_col, query_col).select("query_id", "id").persist()
        wanted, probes, most = exact.count(), 1, len(self.books.cells)
        while probes < most and self.top_k(vectors, drawn, k, probes, factor, True, query_col).join(exact, ["query_id", "id"]).count() < recall * wanted:
            probes *= 2
        exact.unpersist()
        return min(probes, most)

    def bytes_a_vector(self) -> int:
        """A byte a part, and four for the cell."""
        return len(self.books.books) + 4


#: Cells at most; beyond, they grow and are cut into parts.
MOST_CELLS = 4096


def cells_of(n: int) -> int:
    """About the root of the number of vectors."""
    return max(1, min(MOST_CELLS, ceil(sqrt(n) / 2)))
