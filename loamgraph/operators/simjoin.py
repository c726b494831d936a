"""Exact similarity joins of vectors: pivots cut the space, and the triangle inequality tells which blocks never need to meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..plans.durable import stored
from .vector import PLACES, matrix

#: Vectors that a cell has on average at least. There are LEAST_PIVOTS cells, or the fourth root of the number of vectors, as a row may visit half of them, and PIVOTS at most.
CELL, LEAST_PIVOTS, PIVOTS = 2048, 8, 1024
#: Rows of a block: one part in BLOCKS of all, between these bounds. Its visitors are dealt to PARTS tasks.
LEAST_BLOCK, BLOCK, BLOCKS, PARTS = 1024, 65536, 32, 4
#: Products at once, pairs scored in double precision at once, and pairs from which on a block keeps k a row.
PRODUCT, SCORED, HELD = 1 << 21, 1 << 16, 1 << 20
#: Vectors among which pivots are sought, at most; any pivots give the same pairs.
SAMPLE, ROUNDS = 16384, 6
#: What rounding may have taken from a distance.
SLACK = 1e-6
ROWS = 1024


def reach(least: float) -> float:
    """The distance of two unit vectors whose cosine is `least`."""
    return sqrt(max(0.0, 2 - 2 * least)) + SLACK


def unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T))


def choose_pivots(x: np.ndarray, m: int) -> np.ndarray:
    """m centres of the rows: every so-manieth row, then means of the nearest ones; a centre that attracts none stays."""
    p = x[np.linspace(0, len(x) - 1, m).astype(int)].copy()
    for _ in range(ROUNDS if m > 1 else 0):
        near = (x @ p.T - (p * p).sum(axis=1)[None] / 2).argmax(axis=1)
        count = np.bincount(near, minlength=m)
        sums = np.zeros_like(p)
        np.add.at(sums, near, x)
        p = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], p)
    return p


class Meeting:
    """A block's rows in the order of their distance from the pivot, and what of them may be near rows that come by in the same order: windows within reach."""

    def __init__(self, parts: list[pa.RecordBatch], r: float):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.reach, self.type = r, table.schema.field("id").type
        self.ids, self.distance = table.column("id").to_numpy(), table.column("distance").to_numpy()
        self.x = unit_rows(matrix(table.column("v")))

    def windows(self, distance: np.ndarray, own: bool) -> Iterator[tuple[int, int, int, int]]:
        """(s, e, lo, hi): rows s to e, and the block's rows lo to hi, among which are all in reach of any of them; of the block's own, those from s on."""
        step = max(1, PRODUCT // len(self.ids))
        for s in range(0, len(distance), step):
            e = min(len(distance), s + step)
            lo = s if own else int(np.searchsorted(self.distance, distance[s] - self.reach, "left"))
            yield s, e, lo, int(np.searchsorted(self.distance, distance[e - 1] + self.reach, "right"))


class Counted(Meeting):
    """n: pairs that meet."""

    def met(self, ids: np.ndarray, x: np.ndarray, distance: np.ndarray, own: bool = False) -> Iterator[pa.RecordBatch]:
        n = sum((e - s) * (hi - lo) - ((e - s) * (e - s + 1) // 2 if own else 0) for s, e, lo, hi in self.windows(distance, own))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def best_of(x: np.ndarray, y: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each x's k best y; ties to the smaller y."""
    group, place = (np.unique(c, return_inverse=True)[1] for c in (x, y))
    order = np.lexsort((place, -score, group))
    start = np.r_[True, group[order][1:] != group[order][:-1]][: len(order)]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < k]


class Matched(Meeting):
    """x, y, score of pairs in reach, once; with k, of the k best of each row, both ways round: of a visitor in a window, of the block's rows among all that came by."""

    def __init__(self, parts: list[pa.RecordBatch], r: float, least: float, k: int | None):
        super().__init__(parts, r)
        self.least, self.k, self.held, self.many = least, k, [], 0
        self.narrow = self.x.astype(np.float32)
        #: What single precision may take from a product of unit vectors.
        self.loose = np.float32(least - 1e-6 - 1.2e-7 * self.x.shape[1])

    def _batch(self, x: np.ndarray, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x).cast(self.type), pa.array(y).cast(self.type), pa.array(score, pa.float64())], ["x", "y", "score"])

    def met(self, ids: np.ndarray, x: np.ndarray, distance: np.ndarray, own: bool = False) -> Iterator[pa.RecordBatch]:
        narrow = self.narrow if own else x.astype(np.float32)
        for s, e, lo, hi in self.windows(distance, own):
            i, j = np.nonzero(narrow[s:e] @ self.narrow[lo:hi].T >= self.loose)
            i, j = i + s, j + lo
            if own:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), SCORED):
                a, b = i[at : at + SCORED], j[at : at + SCORED]
                score = np.einsum("nd,nd->n", x[a], self.x[b])
                score = score if self.k is None else np.round(score, PLACES)
                fits = (score >= self.least) & (ids[a] != self.ids[b])
                if fits.any():
                    yield from self._found(ids[a[fits]], self.ids[b[fits]], score[fits], own)

    def _found(self, x: np.ndarray, y: np.ndarray, score: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        if self.k is None:
            yield self._batch(x, y, score)
            return
        if own:
            self.held.append((x, y, score))
        else:
            best = best_of(x, y, score, self.k)
            yield self._batch(x[best], y[best], score[best])
        self.held.append((y, x, score))
        self.many += len(x)
        if self.many > HELD:
            self._prune()

    def _prune(self) -> None:
        x, y, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        best = best_of(x, y, score, self.k)
        self.held, self.many = [(x[best], y[best], score[best])], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._prune()
            yield self._batch(*self.held[0])


class PivotJoin:
    """The blocks of vectors in which pairs of a cosine of `least` or more must lie.

    Each vector lives in the cell of its nearest pivot. It visits the cell of an earlier pivot only if the plane halfway between the two pivots is within
    reach, as a partner there lies beyond that plane. Cells are cut into blocks of bounded size by a hash; a row of a later block visits the earlier ones of its own cell. A block is held
    by a task, and its visitors stream past it in the order of their distance from the pivot: rows whose distances differ by more than the reach don't meet. Visitors are dealt to
    PARTS tasks. So a row moves once for a block that it visits, whatever that block's size, and every pair of vectors in reach meets in exactly one task.

    Null vectors and those of length zero are left out; all others must be equally long and without nulls. What the driver holds is PIVOTS centres
    at most, and three numbers of each.
    """

    def __init__(self, vectors: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", cell: int | None = None, block: int | None = None):
        if not 0 < least <= 1:
            raise ValueError("a pivot join needs a cosine above 0")
        self.least, self.reach = least, reach(least)
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        self.rows = rows.where("v is not null and exists(v, x -> x <> 0)").withColumn("h", F.xxhash64("id"))
        self.n = self.rows.count()
        m = min(ceil(self.n / CELL), max(LEAST_PIVOTS, ceil(self.n**0.25))) if cell is None else ceil(self.n / cell)
        m = min(PIVOTS, m) or 1
        self.block = min(BLOCK, max(LEAST_BLOCK, ceil(self.n / BLOCKS))) if block is None else block
        got = self.rows.orderBy("h", "id").limit(min(SAMPLE, 64 * m)).select("v").collect() if m > 1 else []
        self.pivots = choose_pivots(unit_rows(np.array([r["v"] for r in got], np.float64)), m) if m > 1 else np.zeros((1, 1))
        self.kind = vectors.schema[id_col].dataType

    def tiles(self) -> DataFrame:
        """tile, part, visitor, distance, id, v: the rows of every block, once a part, and its visitors; sorted within partitions, a tile's part in one of them."""
        sc, pivots, r = self.rows.sparkSession.sparkContext, self.pivots, self.reach
        told = sc.broadcast(pivots)

        def homes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            every = distances(x, told.value) if len(told.value) > 1 else np.zeros((len(x), 1))
            home = every.argmin(axis=1)
            return every, home, every[np.arange(len(x)), home]

        def lives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    _, home, own = homes(unit_rows(matrix(whole.column(0).slice(at, ROWS))))
                    yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(own)], ["cell", "distance"])

        held = self.rows.select("v").mapInArrow(lives, "cell int, distance double")
        count, lo, hi = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for row in held.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).collect():
            count[row["cell"]], lo[row["cell"]], hi[row["cell"]] = row["n"], row["lo"], row["hi"]
        blocks = -(-count // self.block)
        first = np.r_[0, np.cumsum(blocks)]
        tiles = int(first[-1])
        parts = PARTS if tiles > 1 else 1
        bounds = sc.broadcast((blocks, first, lo, hi))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, first, lo, hi = bounds.value
            pivots = told.value
            apart = 2 * np.maximum(distances(pivots, pivots), 1e-12)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    h = batch.column(2).to_numpy().view(np.uint64)
                    every, home, own = homes(unit_rows(matrix(batch.column(1))))
                    block = ((h >> np.uint64(8)) % blocks[home].astype(np.uint64)).astype(np.int64)
                    n = len(home)
                    # The distance of a row from the plane halfway between its pivot and another.
                    plane = (every**2 - (own**2)[:, None]) / apart[home]
                    goes = (plane <= r) & (every - r <= hi) & (every + r >= lo) & (np.arange(len(pivots)) < home[:, None])
                    row, cell = np.nonzero(goes)
                    some = [(np.repeat(np.arange(n), parts), np.repeat(first[home] + block, parts), np.tile(np.arange(parts), n), 0, np.repeat(own, parts))]
                    for who, to, many, d in ((np.arange(n), home, block, own), (row, cell, blocks[cell], every[row, cell])):
                        copies = np.repeat(np.arange(len(who)), many)
                        nth = np.arange(len(copies)) - np.repeat(np.cumsum(many) - many, many)
                        some.append((who[copies], first[to[copies]] + nth, (h[who[copies]] % np.uint64(parts)).astype(np.int64), 1, d[copies]))
                    for who, tile, part, visitor, d in some:
                        for s in range(0, len(who), ROWS):
                            w = pa.array(who[s : s + ROWS])
                            numbers = [pa.array(c.astype(np.int32)) for c in (tile[s : s + ROWS], part[s : s + ROWS], np.full(len(w), visitor))]
                            yield pa.RecordBatch.from_arrays([*numbers, pa.array(d[s : s + ROWS]), batch.column(0).take(w), batch.column(1).take(w)], ["tile", "part", "visitor", "distance", "id", "v"])

        ints = [StructField(c, IntegerType()) for c in ("tile", "part", "visitor")]
        dealt = self.rows.mapInArrow(run, StructType([*ints, StructField("distance", DoubleType()), *self.rows.schema.fields[:2]]))
        return dealt.repartition(max(1, tiles * parts), "tile", "part").sortWithinPartitions("tile", "part", "visitor", "distance")

    def _met(self, make: Callable[[list[pa.RecordBatch]], Meeting], schema: str) -> DataFrame:
        """What make(a block's rows) says of each block's own pairs, which meet in the first part, and of its visitors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, now = None, [], None

            def opened() -> Iterator[pa.RecordBatch]:
                nonlocal held, now
                now, held = make(held), []
                if at[1] == 0:
                    yield from now.met(now.ids, now.x, now.distance, True)

            def closed() -> Iterator[pa.RecordBatch]:
                if held:
                    yield from opened()
                if now is not None:
                    yield from now.rest()

            for batch in batches:
                tile, part, visitor = (batch.column(c).to_numpy() for c in ("tile", "part", "visitor"))
                cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in (tile, part, visitor)])) + 1
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    if s == e:
                        continue
                    rows = batch.slice(s, e - s)
                    if (tile[s], part[s]) != at:
                        yield from closed()
                        at, held, now = (tile[s], part[s]), [], None
                    if visitor[s] == 0:
                        held.append(rows)
                        continue
                    if now is None and held:
                        yield from opened()
                    if now is None:
                        # A hash may leave a block without rows.
                        continue
                    x = unit_rows(matrix(rows.column("v")))
                    yield from now.met(rows.column("id").to_numpy(zero_copy_only=False), x, rows.column("distance").to_numpy())
            yield from closed()

        return self.tiles().mapInArrow(run, schema)

    def compared(self) -> int:
        """How many pairs of vectors meet."""
        r = self.reach
        return self._met(lambda held: Counted(held, r), "n long").agg(F.sum("n")).first()[0] or 0

    def matched(self, k: int | None = None) -> DataFrame:
        """x, y, score of every pair in reach, once; with k, of each row's k best in each block, both ways round."""
        kind, least, r = self.kind.simpleString(), self.least, self.reach
        return self._met(lambda held: Matched(held, r, least, k), f"x {kind}, y {kind}, score double")


def similar_pairs(vectors: DataFrame, least: float = 0.88, id_col: str = "vec_id", vector_col: str = "embedding", cell: int | None = None, block: int | None = None) -> DataFrame:
    """a, b, similarity (4 places) of every pair a < b whose cosine is `least` (above 0) or more, by PivotJoin. Rows that repeat an id don't pair with each other."""
    found = PivotJoin(vectors, least, id_col, vector_col, cell, block).matched()
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("score", 4).alias("similarity"))


def neighbor_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85, id_col: str = "vec_id", vector_col: str = "embedding", cell: int | None = None, block: int | None = None) -> DataFrame:
    """a, b, similarity: each vector's k nearest of a cosine of `least` (above 0) or more, a pair once; ties to the smaller id. Blocks keep k a row.

    Of equal vectors the k + 1 smallest ids meet the others, as no further one is among anyone's nearest; what the smallest finds holds for all of them.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        best = _nearest_of_distinct(rows, k, least, cell, block)
    else:
        # Rows that repeat an id may have several vectors; all of them meet.
        rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "y"))
        best = PivotJoin(rows, least, "id", "v", cell, block).matched(k).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("score").alias("similarity")).dropDuplicates(["a", "b"])


def _nearest_of_distinct(rows: DataFrame, k: int, least: float, cell: int | None, block: int | None) -> DataFrame:
    """x, y, score of each row's k nearest; rows (id, v) have an id each."""
    # Other vectors have no cosine with any.
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf"))).drop("norm")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = stored(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1))
    one = first.where("nth = 1").select(F.col("id").alias("one"), "v")
    found = PivotJoin(first, least, "id", "v", cell, block).matched(k)
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "y"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    near = F.struct((-F.col("score")).alias("far"), F.col("y"))
    lists = found.groupBy(F.col("x").alias("one")).agg(F.collect_list(near).alias("near"))
    # A vector is as near as can be to its equals.
    own = F.array(F.struct(F.lit(-1.0).alias("far"), F.col("one").alias("y")))
    lists = one.join(lists, "one", "left").select("v", F.array_sort(F.concat(own, F.coalesce("near", F.array().cast(lists.schema["near"].dataType)))).alias("near"))
    each = rows.join(lists, "v").select(F.col("id").alias("x"), F.explode(F.slice(F.filter("near", lambda n: n["y"] != F.col("id")), 1, k)).alias("n"))
    return each.select("x", F.col("n.y").alias("y"), (-F.col("n.far")).alias("score"))
