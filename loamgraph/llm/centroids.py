"""Exact integer k-means whose distances are screened by segment norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.vector import matrix
from .common import stored

#: Components of a segment, and levels of a compressed component on each side of zero.
SEGMENT = 8
CODES = 127
#: Up to this magnitude squared distances fit 64 bits whatever the dimensions that a vector here has; beyond, Python's integers count.
SMALL = 1 << 27
#: Larger components are refused: their sums over all rows might not fit a decimal of 38 digits.
LARGEST = 1 << 80
#: Vectors that are compared with all centroids at once.
ROWS = 4096


def segment_norms(x: np.ndarray) -> np.ndarray:
    """The norm of each SEGMENT components of every row; the last segment may be shorter."""
    pad = -x.shape[1] % SEGMENT
    x = np.pad(x.astype(np.float64), ((0, 0), (0, pad)))
    return np.sqrt((x * x).reshape(len(x), -1, SEGMENT).sum(axis=2))


class Compressed:
    """Rows as small codes times a power of two each, with segment norms of the rows, of the codes' part and of what the codes leave."""

    def __init__(self, x: np.ndarray):
        most = np.abs(x).max(axis=1, initial=0)
        self.scale = np.exp2(np.ceil(np.log2(np.maximum(most / CODES, 1))))
        codes = np.rint(x / self.scale[:, None])
        part = codes * self.scale[:, None]
        #: Products of codes are sums of 64 numbers below 2**14, which single precision holds exactly.
        self.codes = codes.astype(np.float32)
        self.square = (x.astype(np.float64) ** 2).sum(axis=1)
        self.norms, self.own, self.left = segment_norms(x), segment_norms(part), segment_norms(x - part)

    def take(self, at: np.ndarray) -> Compressed:
        out = object.__new__(Compressed)
        for name, value in vars(self).items():
            setattr(out, name, value[at])
        return out


def by_norms(x: Compressed, c: Compressed) -> np.ndarray:
    """Lower bounds of all squared distances: in each segment the product is at most the product of the norms."""
    return _below(x.square[:, None] + c.square[None], x.norms @ c.norms.T)


def by_codes(x: Compressed, c: Compressed) -> np.ndarray:
    """Tighter bounds: the codes' product as it is, and Cauchy and Schwarz for what either side's codes leave."""
    product = (x.codes @ c.codes.T).astype(np.float64) * x.scale[:, None] * c.scale[None]
    return _below(x.square[:, None] + c.square[None], product + x.own @ c.left.T + x.left @ c.norms.T)


def _below(squares: np.ndarray, product: np.ndarray) -> np.ndarray:
    """squares less twice the product, less what rounding may have added."""
    return squares - 2 * product - 1e-9 * (squares + np.abs(product)) - 1


def _exact(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    d = x[i] - c[j]
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the nearest of c by squared distance, ties to the smaller number; that distance; three counts) for each row of x.

    x and c hold integers: 64-bit, or Python's where a component is beyond SMALL, which are compared without screening. The counts are of
    all pairs, of those that segment norms leave, and of those compared exactly.
    """
    n, k = len(x), len(c)
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
        d = np.array([_exact(np.broadcast_to(row, c.shape), c, np.arange(k), np.arange(k)) for row in x], object).reshape(n, k)
        best = np.array([min(range(k), key=row.__getitem__) for row in d], np.int64)
        return best, d[np.arange(n), best], np.array([n * k] * 3)
    own, cc = Compressed(x), Compressed(c)
    rows = np.arange(n)
    bound = by_norms(own, cc)
    first = bound.argmin(axis=1)
    most = _exact(x, c, rows, first)
    open_ = bound <= most[:, None]
    by_norm = int(open_.sum())
    bound = np.where(open_, by_codes(own, cc), np.inf)
    second = bound.argmin(axis=1)
    most = np.minimum(most, _exact(x, c, rows, second))
    i, j = np.nonzero(bound <= most[:, None])
    d = np.full((n, k), np.iinfo(np.int64).max)
    d[i, j] = _exact(x, c, i, j)
    best = d.argmin(axis=1)
    return best, d[rows, best], np.array([n * k, by_norm, len(i) + 2 * n])


def integers(v: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64-bit, or Python's if one is beyond SMALL."""
    top = np.abs(v).max(initial=0)
    if top > LARGEST:
        raise ValueError(f"a scaled component of {top:g} is beyond 2**80")
    if top > SMALL:
        return np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)
    return v.astype(np.int64)


def _usable(vector: Column, dims: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dims) & fine


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), integers(matrix(part.column(1)))


def _sums(kept: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Of each non-empty cluster its size and sums of components, combined in each task; what comes back is one row a cluster."""
    told = kept.sparkSession.sparkContext.broadcast(centroids)
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = integers(np.array(told.value, np.float64)) if max(map(abs, sum(told.value, []))) <= SMALL else np.array(told.value, object)
        total: dict[int, tuple[int, list[int]]] = {}
        for _, x in _batches(batches):
            best = nearest(x, c)[0]
            for cluster in np.unique(best).tolist():
                own = x[best == cluster]
                n, sums = total.get(cluster, (0, [0] * dims))
                total[cluster] = n + len(own), [a + int(b) for a, b in zip(sums, own.sum(axis=0), strict=True)]
        kind = pa.list_(pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([[Decimal(s) for s in sums] for _, sums in total.values()], kind)], ["cluster", "n", "sums"])

    parts = kept.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    each = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims))).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dims)]) for r in each}


def assign(kept: DataFrame, centroids: list[list[int]], counts: bool = False) -> DataFrame:
    """id, cluster, distance of kept (id, v); with `counts` instead pairs, by_norms, exact of each batch: pairs in all, left by segment norms, and compared."""
    told = kept.sparkSession.sparkContext.broadcast(centroids)
    kind = kept.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(told.value, object)
        c = c.astype(np.int64) if np.abs(c).max() <= SMALL else c
        for ids, x in _batches(batches):
            best, distance, counted = nearest(x, c)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counted[i : i + 1]) for i in range(3)], ["pairs", "by_norms", "exact"])
                continue
            if max(distance.tolist()) > np.iinfo(np.int64).max:
                raise ValueError("a squared distance does not fit a long")
            yield pa.RecordBatch.from_arrays([ids.cast(to_arrow_type(kind)), pa.array(best, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["id", "cluster", "distance"])

    return kept.mapInArrow(run, "pairs long, by_norms long, exact long" if counts else f"id {kind.simpleString()}, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance of every usable vector; the final centroids as integers).

    Components x become floor(scale * x). The first centroids are the k vectors with the smallest lower-case hex SHA-256 of `seed:id`; each round assigns every
    vector to the nearest one and replaces each non-empty centroid by the floor of its vectors' mean, in exact integers.
    Only the k centroids are on the driver and broadcast; a round's sums are combined in tasks, a row a cluster.

    Left out are vectors that are null, of another length than `dims`, or that hold a null or non-finite component.
    Equal ids tie in the first choice by their components; null ids come after all others. Repeated rows each count and each get their row. With fewer
    than k vectors there are fewer centroids; an empty table gives no rows and no centroids. A component beyond 2**80 after scaling, or a distance
    beyond a long, is an error. Other columns are ignored.
    """
    used = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(_usable(F.col("v"), dims))
    kept = stored(used.select("id", F.transform("v", lambda x: x.cast("double") * scale).alias("v")))
    # Spark's floor() of a double saturates at a long's end; a double's floor is a double.
    floor = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    kept = kept.select("id", F.transform("v", floor).alias("v"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(name), "v").limit(k).collect()
    centroids = [[int(x) for x in r["v"]] for r in first]
    for _ in range(rounds if centroids else 0):
        for cluster, (n, sums) in _sums(kept, centroids).items():
            centroids[cluster] = [s // n for s in sums]
    if not centroids:
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    return assign(kept, centroids), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector, as centroid_clusters() takes them.

    The inertias are a row a cluster, broadcast; a sum beyond a long is an error.
    """
    found, centroids = centroid_clusters(vectors, **options)
    found = stored(found)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    spark = vectors.sparkSession
    digests = spark.createDataFrame([(i, centroid_digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    each = sums.join(digests, "cluster").crossJoin(total)
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
