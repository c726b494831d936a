"""Vector search, in numpy blocks over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import same_place_similarity

#: Queries that are sent to all vectors; more meet the vectors in shards of so many.
QUERY_BLOCK = 4096
SHARD = 16384
#: Queries that are scored at once, at most, and scores that are held at once.
BLOCK, PRODUCT = 1024, 1 << 21
THRESHOLD = 0.2
#: The share of true neighbours that cells must find, and queries of which that is measured.
RECALL, ASKED = 0.95, 200
PLACES = 9


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix; all must be equally long and without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """a x b similarities, higher is nearer: cosine, ip (inner product) or l2 (minus the distance). A zero vector has cosine 0."""
    if metric == "ip":
        return a @ b.T
    if metric == "l2":
        return -np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.divide(a @ b.T, norm, out=np.zeros((len(a), len(b))), where=norm > 0)


def against_shards(rows: DataFrame, asked: DataFrame, size: int, make: Callable, ask: Callable, schema: str) -> DataFrame:
    """What every query finds in every shard of the rows: both have columns id and v, rows are dealt into shards of about `size`.

    A shard moves once, and its make(ids, column of v) is made once; then the queries stream past it in Arrow batches, and
    ask(what was made, ids, column of v) yields batches. A task holds a shard and a batch, whatever the numbers of rows and queries.
    """
    shards = ceil(rows.count() / size) or 1
    held = rows.select(F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "v")
    return within_shards(held, each, shards, make, ask, schema)


def within_shards(rows: DataFrame, asked: DataFrame, shards: int, make: Callable, ask: Callable, schema: str) -> DataFrame:
    """As against_shards(), where both have the shard that they are in: shard, id and v."""
    row_kind, query_kind = rows.schema["id"].dataType, asked.schema["id"].dataType
    held = rows.select("shard", F.lit(0).alias("kind"), F.col("id").alias("row"), F.lit(None).cast(query_kind).alias("query"), "v")
    each = asked.select("shard", F.lit(1).alias("kind"), F.lit(None).cast(row_kind).alias("row"), F.col("id").alias("query"), "v")
    both = held.unionByName(each).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, made = None, [], None
        for batch in batches:
            own, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if end == begin:
                    continue
                if own[begin] != shard:
                    shard, parts, made = own[begin], [], None
                part = batch.slice(begin, end - begin)
                if kind[begin] == 0:
                    parts.append(part)
                elif parts:
                    if made is None:
                        table = pa.Table.from_batches(parts).combine_chunks()
                        made = make(table.column("row"), table.column("v"))
                    yield from ask(made, part.column("query"), part.column("v"))

    return both.mapInArrow(run, schema)


def best(names: pa.Array, q: np.ndarray, ids: pa.Array, v: np.ndarray, metric: str, k: int, least: float | None = None) -> Iterator[pa.RecordBatch]:
    """query_id, id, score: each query's k best of the vectors and those that tie with the last, at `least` or more; PRODUCT scores are held at once."""
    n = min(k, len(v))
    for at in range(0, len(q) if n else 0, step := max(1, min(BLOCK, PRODUCT // max(1, len(v))))):
        s = np.round(scores(q[at : at + step], v, metric), PLACES)
        cut = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
        row, col = np.nonzero(s >= (cut if least is None else np.maximum(cut, least)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(row + at)), ids.take(pa.array(col)), pa.array(s[row, col])], ["query_id", "id", "score"])


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", least: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", skip_self: bool = False) -> DataFrame:
    """query_id, rank (from 1), id, score of each query's k nearest vectors at `least` or more.

    Filters on `vectors` come first, so k is of what may be seen. Each batch keeps k a query; ties
    go to the smaller id. Up to QUERY_BLOCK queries go to all batches of vectors, which don't move; more meet the
    vectors in shards.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    qkind = queries.schema[query_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    asked = queries.select(F.col(query_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    first = asked.limit(QUERY_BLOCK + 1).collect()

    schema = f"query_id {qkind}, id {kind}, score double"
    if len(first) <= QUERY_BLOCK:
        told = spark.sparkContext.broadcast((pa.array([r["id"] for r in first], to_arrow_type(asked.schema["id"].dataType)), np.array([r["v"] for r in first], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = told.value
            for batch in batches:
                if batch.num_rows and len(names):
                    yield from best(names, q, batch.column(0), matrix(batch.column(1)), metric, k + skip_self, least)

        out = rows.mapInArrow(run, schema)
    else:
        def ask(made: tuple, names: pa.Array, v: pa.Array) -> Iterator[pa.RecordBatch]:
            yield from best(names, matrix(v), *made, metric, k + skip_self, least)

        out = against_shards(rows, asked, SHARD, lambda ids, v: (flat(ids), matrix(v)), ask, schema)
    if skip_self:
        out = out.where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (len a + len b), of lower-cased texts; two empty ones are equal. Rows run in Arrow batches."""
    def common(x: str, y: str) -> int:
        # Bits of `rows` are places of x where the longest common subsequence grows.
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        rows = full
        for c in y:
            hit = rows & at.get(c, 0)
            rows = (rows + hit | rows - hit) & full
        return len(x) - rows.bit_count()

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left.fillna("").str.lower(), right.fillna("").str.lower(), strict=True):
                out.append(2 * common(x, y) / (len(x) + len(y)) if x or y else 1.0)
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


class Cells:
    """An inverted file: k-means cells over a bounded sample, every vector in its nearest cell, queries probing the nearest few.

    Unless `cells` says how many, there are a quarter of the root of the number of vectors, 20 at least.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0, rounds: int = 8):
        self.id_col, self.vector_col = id_col, vector_col
        if cells is None:
            cells = max(20, ceil(vectors.count() ** 0.5 / 4))
        got = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(sample).select(vector_col).collect()
        x = np.array([r[0] for r in got], np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        c = x[rng.permutation(len(x))[: min(cells, len(x))]]
        for _ in range(rounds):
            near = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
        self.centroids = c

    def assign(self, rows: DataFrame, probes: int = 1) -> DataFrame:
        """rows with a row for each of the nearest `probes` cells: place (from 0, nearest first) and cell."""
        told = rows.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                near = np.argsort(-(np.stack(s.to_numpy()) @ told.value.T), axis=1, kind="stable")[:, :probes]
                yield pd.Series(list(near.astype(np.int32)))

        return rows.where(F.col(self.vector_col).isNotNull()).select("*", F.posexplode(F.pandas_udf(run, "array<int>")(self.vector_col)).alias("place", "cell"))

    def probes_for(self, vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, query_col: str = "query_id") -> int:
        """The fewest cells to probe that hold a share `recall` of the true k nearest of ASKED queries, drawn by a hash: their exact
        neighbours are searched, and the place of each one's cell in its query's order is counted."""
        drawn = queries.where(F.col(self.vector_col).isNotNull()).orderBy(F.xxhash64(query_col)).limit(ASKED).select(F.col(query_col).alias("query_id"), self.vector_col)
        exact = top_k(vectors, drawn, k, "cosine", None, self.id_col, self.vector_col)
        cells = self.assign(vectors.select(F.col(self.id_col).alias("id"), self.vector_col)).select("id", "cell")
        order = self.assign(drawn, len(self.centroids)).select("query_id", "place", "cell")
        got = exact.join(cells, "id").join(order, ["query_id", "cell"]).groupBy("place").count().collect()
        held = np.zeros(len(self.centroids), np.int64)
        for r in got:
            held[r["place"]] = r["count"]
        return int(np.searchsorted(np.cumsum(held), recall * held.sum())) + 1

    def top_k(self, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, query_col: str = "query_id", recall: float = RECALL) -> DataFrame:
        """As top_k() with cosine, over the probed cells, in blocks; each cell keeps k a query. Without `probes`, probes_for() `recall` are taken.

        A cell moves once, in shards of SHARD vectors if it is larger, and the queries that probe it stream past.
        """
        if probes is None:
            probes = self.probes_for(vectors, queries, k, recall, query_col)
        kind, qkind = vectors.schema[self.id_col].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()
        v = self.assign(vectors.select(F.col(self.id_col).alias("id"), self.vector_col)).select("id", F.col(self.vector_col).alias("v"), "cell")
        q = self.assign(queries.select(F.col(query_col).alias("id"), self.vector_col), probes).select("id", F.col(self.vector_col).alias("v"), "cell")
        sizes = [0] * len(self.centroids)
        for r in v.groupBy("cell").count().collect():
            sizes[r["cell"]] = r["count"]
        parts = [max(1, ceil(n / SHARD)) for n in sizes]
        firsts = [sum(parts[:i]) for i in range(len(parts))]
        of = lambda values: F.get(F.array(*(F.lit(x) for x in values)), F.col("cell")).cast("int")
        rows = v.select((of(firsts) + F.pmod(F.xxhash64("id", F.lit("shard")), of(parts))).cast("int").alias("shard"), "id", "v")
        asked = q.select(F.explode(F.sequence(of(firsts), of(firsts) + of(parts) - 1)).alias("shard"), "id", "v")

        def ask(made: tuple, names: pa.Array, own: pa.Array) -> Iterator[pa.RecordBatch]:
            yield from best(names, matrix(own), *made, "cosine", k)

        out = within_shards(rows, asked, sum(parts) or 1, lambda ids, own: (flat(ids), matrix(own)), ask, f"query_id {qkind}, id {kind}, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine by higher-order functions; epsilon is added to the denominator."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


#: Characters of a block by which near texts of the cache are found: texts that differ in one of twenty places agree in a block.
CACHE_BLOCK = 8


def near_cached(texts: DataFrame, cache: DataFrame, least: float = 0.95, text_col: str = "text") -> DataFrame:
    """text, seq of the cache's row, or null: the equal text's, else that of the first (by seq) whose characters agree with the text's
    in a share of `least` (0.95 or more) of the places of the longer one.

    texts: text_col; cache: text_col, seq. Two such texts agree in a whole block at the same place, as they differ in fewer places than the shorter one has blocks, so an equi-join on
    blocks finds every pair.
    """
    if least < 0.95:
        raise ValueError("blocks find pairs that agree in 0.95 of their places or more")
    asked = texts.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    held = cache.select(F.col(text_col).alias("held"), "seq").groupBy("held").agg(F.min("seq").alias("seq"))
    exact = asked.join(held, F.col("text") == F.col("held")).select("text", "seq")
    missed = asked.join(exact.select("text"), "text", "left_anti")
    blocks = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.length(c) / CACHE_BLOCK).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substr(c, i * CACHE_BLOCK + 1, F.lit(CACHE_BLOCK)).alias("part"))))
    long = lambda rows, c: rows.where(F.length(c) >= CACHE_BLOCK)
    pairs = long(missed, "text").select("text", blocks(F.col("text")).alias("b")).join(long(held, "held").select("held", "seq", blocks(F.col("held")).alias("b")), "b").select("text", "held", "seq").distinct()
    near = pairs.where(same_place_similarity(F.col("text"), F.col("held")) >= least).groupBy("text").agg(F.min("seq").alias("seq"))
    return asked.join(exact.unionByName(near), "text", "left")


def cached_embeddings(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts with the cache's embedding, null on a miss: embed only the misses."""
    return texts.join(cache.select(text_col, "embedding").dropDuplicates([text_col]), text_col, "left")
