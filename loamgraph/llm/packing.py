"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import cut, stored

CAPACITY = 4096
#: Pieces of one island's problem, islands that evolve it, and rounds of migration between them.
ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 24
POPULATION = 4
#: Loose pieces that a bin with room is offered in exchange.
SWAPS = 24
#: Characters tokenised at once.
CHARS = 1 << 21

PIECE = "item long, doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole documents' ids, cut where longer than capacity."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < batch.num_rows:
                part, chars, to = [], 0, at
                while to < batch.num_rows and (not part or chars < CHARS):
                    part.append(texts[to].as_py() or "")
                    chars += len(part[-1])
                    to += 1
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(bpe.encode(part)):
                    ids += end
                    for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[s : s + 4 * capacity]
                        row.append(at + i)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])
                at = to

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


class Island:
    """Evolves bins of one problem. A solution's genes are its bins."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.size = lengths.tolist()
        self.capacity = capacity
        self.rng = np.random.default_rng(seed)
        total = sum(self.size)
        self.bound = max(ceil(total / capacity), sum(2 * x > capacity for x in self.size))

    def fill(self, one: list[int]) -> int:
        return sum(map(self.size.__getitem__, one))

    def best_fit(self, bins: Bins, items: list[int]) -> Bins:
        """Adds items, longest first, each to the fullest bin that still holds it."""
        free = sorted((self.capacity - self.fill(b), i) for i, b in enumerate(bins))
        for item in sorted(items, key=lambda x: -self.size[x]):
            size = self.size[item]
            at = bisect_left(free, (size, -1))
            if at == len(free):
                bins.append([item])
                insort(free, (self.capacity - size, len(bins) - 1))
            else:
                room, i = free.pop(at)
                bins[i].append(item)
                insort(free, (room - size, i))
        return bins

    def fitness(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins, then fuller ones: the mean squared fill."""
        return -len(bins), sum((self.fill(b) / self.capacity) ** 2 for b in bins) / max(1, len(bins))

    def cross(self, a: Bins, b: Bins) -> Bins:
        """Injects whole well-filled bins of b into a, drops a's bins that hold their items, and best-fits what was displaced."""
        ranked = sorted(b, key=self.fill, reverse=True)
        ranked = ranked[: max(1, len(ranked) // 2)]
        chosen = [ranked[i] for i in np.flatnonzero(self.rng.random(len(ranked)) < 0.3)] or ranked[:1]
        taken = {x for one in chosen for x in one}
        kept = [list(one) for one in chosen]
        displaced = []
        for one in a:
            if taken.isdisjoint(one):
                kept.append(list(one))
            else:
                displaced += [x for x in one if x not in taken]
        return self.best_fit(*self.swap(kept, displaced))

    def swap(self, bins: Bins, loose: list[int]) -> tuple[Bins, list[int]]:
        """Trades a bin's piece for a longer loose one, or two for one, where that fills the bin better; what comes out is smaller and easier to place."""
        loose = sorted(loose, key=lambda x: -self.size[x])
        for one in bins:
            room = self.capacity - self.fill(one)
            if not room or not loose:
                continue
            best = None
            out = [(self.size[x], (i,)) for i, x in enumerate(one)]
            if len(one) <= 8:
                out += [(self.size[x] + self.size[y], (i, j)) for i, x in enumerate(one) for j, y in enumerate(one[:i])]
            for k, item in enumerate(loose[:SWAPS]):
                for size, at in out:
                    gain = self.size[item] - size
                    if 0 < gain <= room and (best is None or gain > best[0]):
                        best = gain, k, at
            if best:
                _, k, at = best
                item = loose.pop(k)
                loose += [one[i] for i in at]
                loose.sort(key=lambda x: -self.size[x])
                one[:] = [x for i, x in enumerate(one) if i not in at] + [item]
        return bins, loose

    def mutate(self, a: Bins) -> Bins:
        """Empties the emptiest bins and a few others, and best-fits their items."""
        order = sorted(range(len(a)), key=lambda i: self.fill(a[i]))
        gone = set(order[: max(1, len(a) // 50)]) | set(self.rng.integers(0, len(a), max(1, len(a) // 20)).tolist())
        return self.best_fit(*self.swap([list(b) for i, b in enumerate(a) if i not in gone], [x for i in gone for x in a[i]]))

    def evolve(self, given: list[Bins], gains: dict[str, int] | None = None) -> Bins:
        """The best of the given solutions after GENERATIONS; a solution of as few bins as can be ends the search, for none is better.

        gains, if given, counts the children of each kind that were better than all before.
        """
        people = [p for p in given if p] or [self.best_fit([], list(range(len(self.size))))]
        best = max(people, key=self.fitness)
        if not self.size or len(best) <= self.bound:
            return best
        while len(people) < POPULATION:
            people.append(self.mutate(people[int(self.rng.integers(len(people)))]))
        for _ in range(GENERATIONS):
            people.sort(key=self.fitness, reverse=True)
            best = people[0]
            if len(best) <= self.bound:
                break
            half = people[: max(2, POPULATION // 2)]
            i, j = self.rng.permutation(len(half))[:2]
            children = {"cross": self.cross(half[i], half[j]), "mutate": self.mutate(half[j])}
            if gains is not None:
                for kind, child in children.items():
                    gains[kind] = gains.get(kind, 0) + (self.fitness(child) > self.fitness(best))
            people = [*half, *children.values()]
            people = sorted(people, key=self.fitness, reverse=True)[:POPULATION]
        return max(people, key=self.fitness)


def _solutions(bins: np.ndarray) -> Bins:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(bins.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def _evolve(rows: DataFrame, schema: str, capacity: int, level: int, epoch: int) -> DataFrame:
    """Each (shard, island) evolves from the elites that `origin` tells apart, and returns its own."""

    def run(table: pa.Table) -> pa.Table:
        origins = table.column("origin").to_numpy()
        shard, island = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
        table = table.append_column("at", pa.array(np.arange(len(origins))))
        own = None
        given: list[Bins] = []
        for o in np.unique(origins):
            part = table.filter(pa.array(origins == o)).sort_by([("length", "descending"), ("item", "ascending")])
            own = part if own is None else own
            bins = part.column("bin").to_numpy()
            given.append(_solutions(bins) if len(bins) and bins[0] >= 0 else [])
        world = Island(own.column("length").to_numpy(), capacity, hash((shard, island, level, epoch)) & 0x7FFFFFFF)
        best = world.evolve(given)
        number = np.zeros(own.num_rows, np.int32)
        for i, one in enumerate(best):
            number[one] = i
        own = own.drop(["at", "bin", "origin"]).append_column("bin", pa.array(number)).append_column("origin", pa.array(np.full(own.num_rows, island, np.int32)))
        return own.select([c.split()[0] for c in schema.split(", ")])

    return rows.groupBy("shard", "island").applyInArrow(run, schema)


def _settle(rows: DataFrame, schema: str, capacity: int, last: bool) -> DataFrame:
    """Takes each shard's best island. Bins that lack over a fiftieth of their capacity, up to a quarter of the pieces, are open."""

    def run(table: pa.Table) -> pa.Table:
        island = table.column("island").to_numpy()
        parts = {int(i): table.filter(pa.array(island == i)).sort_by([("bin", "ascending"), ("item", "ascending")]) for i in np.unique(island)}

        def rank(i: int) -> tuple[int, float, int]:
            fills = np.bincount(parts[i].column("bin").to_numpy(), weights=parts[i].column("length").to_numpy())
            return len(fills), -float((fills**2).sum()), i

        best = parts[min(parts, key=rank)]
        bins, lengths = best.column("bin").to_numpy(), best.column("length").to_numpy()
        fills, sizes = np.bincount(bins, weights=lengths), np.bincount(bins)
        emptiest = np.argsort(fills, kind="stable")
        loose = np.zeros(len(fills), bool)
        if not last:
            few = np.cumsum(sizes[emptiest]) <= max(len(bins) // 4, sizes[emptiest[0]])
            loose[emptiest[few]] = True
            loose &= fills < capacity * 49 // 50
        begins = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        before = np.cumsum(lengths) - lengths
        offset = before - np.repeat(before[begins], np.diff(np.r_[begins, len(bins)]))
        out = best.drop(["island", "origin"]).append_column("offset", pa.array(offset.astype(np.int64))).append_column("open", pa.array(loose[bins]))
        return out.select([c.split()[0] for c in schema.split(", ")])

    return rows.groupBy("shard").applyInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Full pieces are sequences. The others are dealt into problems of about
    ITEMS pieces; ISLANDS islands evolve each problem and between epochs
    send their elite to the next island. A problem's emptiest bins are opened
    again and their pieces pooled into fewer, mixed problems, until one problem is left
    or a level closes no bin, so that what is lost doesn't grow with the number of problems.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = PIECE.format(id=kind)
    state = f"shard long, island int, {columns}, bin int, origin int"
    settled = f"shard long, {columns}, bin int, offset long, open boolean"
    names = [c.split()[0] for c in columns.split(", ")]
    pieces = stored(pieces.withColumn("item", F.monotonically_increasing_id()).select(*names))
    full = pieces.where(F.col("length") >= capacity)
    done = [full.select(*names, (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.where(F.col("length") < capacity)
    first = level = before = 0
    while n := left.count():
        shards = ceil(n / ITEMS)
        # A level that closed no bin would be followed by others like it: this one closes all.
        last = shards == 1 or n == before
        rows = left.select(*names).withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
        rows = rows.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
        rows = rows.select("shard", "island", *names, F.lit(-1).alias("bin"), F.lit(0).alias("origin"))
        for epoch in range(EPOCHS):
            if epoch:
                # The elite goes to its own island and to the next one.
                rows = rows.withColumn("island", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))))
            rows = _evolve(rows, state, capacity, level, epoch)
        bins = cut(_settle(rows, settled, capacity, last))
        number = F.lit(first).cast("long") + F.col("shard") * (1 << 16) + F.col("bin")
        done.append(bins.where(~F.col("open")).select(*names, number.alias("sequence_id"), "offset"))
        first += shards << 16
        if last:
            break
        left, before, level = bins.where("open"), n, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("item")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id alone. Null ids and repeated
    rows are packed like others; other columns are ignored; an empty table gives no rows.
    """
    return pack(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), capacity)
