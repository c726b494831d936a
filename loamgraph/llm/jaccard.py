"""Exact Jaccard join of texts' shingle sets: prefixes of token combinations, then sketches, then the sets themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import byte_values, connected_components, shared_folder, stored, whole_groups
from .similar import repeated, span_similar
from .simhash import span_groups

WIDTH = 3
#: Two sets are alike when OUT_OF times what they share is at least LEAST times what they hold together.
LEAST, OUT_OF = 90, 100
#: Counters of shingles over all sets. A shingle is frequent, or very frequent, when its counter is at least this large, and this many times the mean.
COUNTERS = 1 << 18
FREQUENT, VERY = (16, 4), (64, 32)
#: From this class of sets on, of 2**PAIRED to twice as many shingles, rare shingles are indexed as pairs too.
PAIRED = 10
#: Words of a sketch, and sets and shingles that one task compares with each other.
WORDS = 8
TILE, PART = 1024, 1 << 20
#: Shingles from which on a sketch's bits rule little out, so a set has COUNTS counters too; sets of a cluster that one task compares by them, and pairs at once.
LARGE, COUNTS = 2048, 512
WIDE, AT_ONCE = 4096, 4096
#: Rounds in which each set meets others under one of its keys, so that dense groups are one class before all keys are compared.
SEEDS = 2
#: A key that holds over one part in HOT of all rows, and over HOT_LEAST of them, is dealt to several tasks.
HOT, HOT_LEAST = 2000, 1000
#: Of so many sets one is drawn to find keys that over HOT_LEAST of them hold.
DRAWN = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# A number for each byte, A-Z as a-z, and powers of an odd multiplier and of its inverse.
_LETTERS = np.random.default_rng(12).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[65:91] = _LETTERS[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes of a text that are hashed at once; only a longer word makes it more.
RUN = 1 << 18
_UP, _DOWN = _powers(_MULTIPLIER, RUN), _powers(pow(_MULTIPLIER, -1, 1 << 64), RUN)


def _word_hashes(b: np.ndarray) -> np.ndarray:
    gap = _SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    edge = np.concatenate([[0] * (not gap[0]), edge, [len(b)] * (not gap[-1])]).astype(np.int64)
    begin, end = edge[::2], edge[1::2]
    up, down = (_UP, _DOWN) if len(b) <= RUN else (_powers(_MULTIPLIER, len(b)), _powers(pow(_MULTIPLIER, -1, 1 << 64), len(b)))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTERS[b] * up[: len(b)], out=total[1:])
    return (total[end] - total[begin]) * down[begin]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order: a polynomial of its bytes modulo 2**64, from one sum over all bytes."""
    parts, at = [], 0
    while at < len(text):
        to = at + RUN
        if to < len(text):
            # After the last white space that fits, or the next.
            back = max(text.rfind(c, at, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            ahead = min((i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(c, to)) >= 0), default=len(text) - 1) if back < 0 else back
            to = ahead + 1
        parts.append(_word_hashes(np.frombuffer(text[at:to], np.uint8)))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    h = word_hashes(text or b"")
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i])
    out.sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    return out[fresh]


def sketch(h: np.ndarray) -> np.ndarray:
    """A bit for the parity of the shingles that fall on it: sets that differ by d shingles differ by d bits at most."""
    bits = np.bincount((mix(h + np.uint64(1)) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def counts(h: np.ndarray) -> bytes | None:
    """How many shingles of a large set fall on each of COUNTS counters, modulo 256: sets that differ by d shingles differ by d at most, summed around the circle."""
    if len(h) < LARGE:
        return None
    return np.bincount((mix(h + np.uint64(2)) % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS).astype(np.uint8).tobytes()


def level_of(n: int) -> int:
    return max(0, n.bit_length() - 1)


def needed(n: int, least: int = LEAST) -> int:
    """What a set of n shingles shares with any alike one, at least."""
    return -(-least * n // OUT_OF)


#: For each class of frequency: shingles in a combination, and buckets of combinations in a set of 2**level.
def scheme(level: int) -> list[tuple[int, int]]:
    return [(2, (1 << level) >> 3) if level >= PAIRED else (1, 0), (2, (1 << level) >> 3), (3, (1 << level) >> 4)]


def least_size(least: int) -> int:
    """The smallest set that can be alike to another one: one shingle less than the other, or one of each exchanged."""
    n = 1
    while least * (n + 1) > OUT_OF * n:
        n += 1
    return n


def combinations_of(tokens: np.ndarray, bucket: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k tokens of one bucket; tokens come in one order."""
    order = np.argsort(bucket, kind="stable")
    tokens, bucket = tokens[order], bucket[order]
    at = [np.arange(len(tokens))]
    for _ in range(k - 1):
        first, last = at[0], at[-1]
        picked = []
        step = 1
        while True:
            nxt = last + step
            fits = nxt < len(tokens)
            fits[fits] = bucket[nxt[fits]] == bucket[first[fits]]
            if not fits.any():
                break
            picked.append(np.vstack([*(x[fits] for x in at), nxt[fits]]))
            step += 1
        at = list(np.hstack(picked)) if picked else [np.zeros(0, np.int64)] * (len(at) + 1)
    return reduce(lambda h, x: mix(h + tokens[x]), at, np.full(len(at[0]), k, np.uint64))


def combination_keys(h: np.ndarray, frequency: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The keys of a set: combinations of its first shingles in one order of all shingles, rare ones first.

    Shingles of a class of frequency are dealt to buckets; k of one bucket make a key (k is 1 for rare ones: each is a key). The prefix is as long as it takes that
    an alike set can't hold fewer than k of every bucket's: when a set may miss d shingles of this one, the shingles beyond the first k - 1 of each
    bucket must be d + 1. Of two alike sets take the one whose prefix ends first: what they share of it is in the other's prefix as well, so they have a key in common.
    Buckets depend on the smaller one's size class, so a set near a power of two has the keys of two classes.
    """
    n = len(h)
    must = needed(n, least)
    if n < 1 << PAIRED:
        # Enough rare ones, each a key: the prefix is the first of them, whatever the size class.
        rare = h[frequency == 0]
        if len(rare) > n - must:
            return np.sort(mix(rare[: n - must + 1] + np.uint64(3)))
    order = np.lexsort((h, frequency))
    h, frequency = h[order], frequency[order]
    out = []
    for level in range(level_of(must), level_of(n) + 1):
        plan = scheme(level)
        bucket = np.zeros(n, np.int64)
        counts = np.ones(n, bool)
        for kind, (k, buckets) in enumerate(plan):
            own = np.flatnonzero(frequency == kind)
            if k > 1 and buckets and len(own):
                dealt = (mix(h[own] + np.uint64(level)) % np.uint64(buckets)).astype(np.int64)
                bucket[own] = dealt
                by = np.argsort(dealt, kind="stable")
                first = np.r_[True, dealt[by][1:] != dealt[by][:-1]]
                rank = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
                counts[own[by]] = rank >= k - 1
        end = int(np.searchsorted(np.cumsum(counts), n - must + 1)) + 1
        for kind, (k, buckets) in enumerate(plan):
            own = np.flatnonzero(frequency[:end] == kind)
            if k == 1 or not buckets:
                out.append(mix(h[own] + np.uint64(3)))
            else:
                out.append(combinations_of(h[own], bucket[own], k) + np.uint64(level * 3 + kind))
    return np.unique(np.concatenate(out))


def frequency_classes(counters: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each counter: its shingles are rare, frequent or very frequent."""
    mean = counters.sum() / COUNTERS
    return (counters >= max(FREQUENT[0], FREQUENT[1] * mean)).astype(np.int8) + (counters >= max(VERY[0], VERY[1] * mean))


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def near(values: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether sets may be alike: by size, and by the distance of their sketches and, where both have them, counters, which no alike pair exceeds."""
    a, b = values["size"][i], values["size"][j]
    hit = OUT_OF * np.minimum(a, b) >= least * np.maximum(a, b)
    at = np.flatnonzero(hit)
    bits = np.zeros(len(at), np.int64)
    for w in range(WORDS):
        word = values[f"w{w}"]
        bits += np.bitwise_count((word[i[at]] ^ word[j[at]]).view(np.uint64))
    # Of a + b shingles, alike sets have (OUT_OF - least) / (OUT_OF + least) on one side only.
    hit[at] = (OUT_OF + least) * bits <= (OUT_OF - least) * (a[at] + b[at])
    if "counts" in values:
        rows, place = values["counts"], values["place"]
        at = np.flatnonzero(hit)
        at = at[(place[i[at]] >= 0) & (place[j[at]] >= 0)]
        for s in range(0, len(at), AT_ONCE):
            part = at[s : s + AT_ONCE]
            apart = np.abs((rows[place[i[part]]] - rows[place[j[part]]]).view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
            hit[part] = (OUT_OF + least) * apart <= (OUT_OF - least) * (a[part] + b[part])
    return hit


def compared(table: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    """The columns that near() compares, with the others named; counts as a matrix, and place as each row's row of it, or -1."""
    values = {c: table.column(c).to_numpy() for c in (*names, "size", *SKETCH)}
    if "counts" in table.column_names:
        each = table.column("counts").to_pylist()
        has = np.array([c is not None for c in each], bool)
        values["counts"] = np.frombuffer(b"".join(c for c in each if c is not None), np.uint8).reshape(-1, COUNTS)
        values["place"] = np.where(has, np.cumsum(has) - 1, -1)
    return values


def packed(text: bytes) -> bytes:
    """A text as it moves and is stored: its length in 8 bytes, then its bytes compressed."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked(column: pa.Array) -> Iterator[bytes]:
    for c in column:
        held = c.as_buffer()
        yield pa.decompress(held.slice(8), int.from_bytes(held.slice(0, 8).to_pybytes(), "little"), codec="zstd", asbytes=True)


NAME = ["h1", "h2", "size"]
SKETCH = [f"w{i}" for i in range(WORDS)]


def _told(docs: DataFrame, id_col: str, text_col: str, width: int, full: bool) -> DataFrame:
    """none, id, text (packed), sketch and counts (if `full`), and NAME of each document's set: 128 bits and its size."""
    rows = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = ["none", "id", "text"] if full else ["id"]
    names = [*own, *NAME, *(SKETCH if full else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves, sizes, texts, words, large = [], [], [], [], []
            for text in byte_values(batch.column("text")):
                h = shingles(text, width)
                halves.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                if full:
                    texts.append(packed(text or b""))
                    words.append(sketch(h))
                    large.append(counts(h))
            name = np.frombuffer(b"".join(halves), ">i8").astype(np.int64).reshape(-1, 2)
            columns = [*(pa.array(texts, pa.binary()) if c == "text" else batch.column(c) for c in own), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(sizes, pa.int64())]
            columns += [*(pa.array(c) for c in np.array(words, np.int64).reshape(-1, WORDS).T), pa.array(large, pa.binary())] if full else []
            yield pa.RecordBatch.from_arrays(columns, [*names, "counts"] if full else names)

    told = [StructField(c, LongType()) for c in names[len(own) :]] + ([StructField("counts", BinaryType())] if full else [])
    kept = [StructField(c, BinaryType()) if c == "text" else rows.schema[c] for c in own]
    return rows.mapInArrow(run, StructType(kept + told))


def _bucketed(base: DataFrame) -> DataFrame:
    """base as a table in buckets by NAME, which it is dealt by already: joins by NAME leave the texts in place."""
    spark = base.sparkSession
    name = f"loam_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base.write.option("compression", "zstd").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").bucketBy(buckets, *NAME).saveAsTable(name)
    return spark.table(name)


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], held: str, how: str = "inner") -> DataFrame:
    """rows joined to the table, one row a key, `held` of which say how many rows have the key: hot keys are dealt to several tasks.

    Fewer than HOT keys hold over one part in HOT of all, so these alone are broadcast.
    """
    share = max(HOT_LEAST, (table.agg(F.sum(held)).first()[0] or 0) // HOT)
    parts = F.ceil(F.col(held) / share).cast("int")
    hot = table.where(F.col(held) > share).select(*on, parts.alias("_parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_parts")
    return dealt.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))), [*on, "_salt"], how).drop("_salt")


def _count_shingles(base: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all sets fall on each of COUNTERS counters; a task's are summed before they move, and the result has one fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in unpacked(batch.column(0)):
                np.add.at(total, counter_of(shingles(text, width)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    got = base.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _keys(base: DataFrame, width: int, least: int) -> DataFrame:
    """key, sid: the combinations of every set that may be alike to another one."""
    classes = base.sparkSession.sparkContext.broadcast(frequency_classes(_count_shingles(base, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sids = [], []
            for sid, text in zip(batch.column(0).to_numpy(), unpacked(batch.column(1)), strict=True):
                h = shingles(text, width)
                keys.append(combination_keys(h, classes.value[counter_of(h)], least).view(np.int64))
                sids.append(np.full(len(keys[-1]), sid))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (keys, sids)], ["key", "sid"])

    return base.where(F.col("size") >= least_size(least)).select("sid", "text").mapInArrow(run, "key long, sid long")


def _groups(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of its group for each row, bounds of groups) of a sorted table."""
    start = np.ones(table.num_rows, bool)
    start[1:] = np.logical_or.reduce([(v := table.column(c).to_numpy())[1:] != v[:-1] for c in keys])
    return np.cumsum(start) - 1, np.r_[np.flatnonzero(start), table.num_rows]


def _by_task(rows: DataFrame, keys: list[str], make: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """make() of tables of whole groups, sorted by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield make(table.combine_chunks())

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _sets(table: pa.Table, width: int) -> list[np.ndarray]:
    return [shingles(t, width) for t in unpacked(table.column("text").combine_chunks())]


def _texts(rows: DataFrame, base: DataFrame) -> DataFrame:
    """rows (sid, the rest) with each set's text: the rows are brought to where the texts are."""
    named = rows.join(base.select("sid", *NAME), "sid")
    return named.join(base.select(*NAME, "text"), NAME).select(*rows.columns, "text")


def _facts(base: DataFrame, counted: bool = False) -> DataFrame:
    return base.select("sid", "size", *SKETCH, *(["counts"] if counted else []))


def _seed_edges(open_: DataFrame, base: DataFrame, turn: int, width: int, least: int) -> DataFrame:
    """a, b: alike sets that meet under the one key that each set takes this turn.

    A key's sets are cut into parts of bounded size; the first set of all is in each part, so the parts of a dense group hang together.
    """
    pick = stored(open_.groupBy("sid").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key"))["key"].alias("key")).join(_facts(base, True), "sid"))
    parts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / PART)).cast("int")
    held = stored(pick.groupBy("key").agg(F.count("*").alias("n"), parts.alias("parts"), F.min("sid").alias("first")).where("n > 1"))
    dealt = spread_join(pick, held, ["key"], "n").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    firsts = held.where("parts > 1").select("key", F.col("first").alias("sid"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(_facts(base, True), "sid")
    columns = ["sid", "key", "part", "size", *SKETCH, "counts"]
    light = dealt.select(columns).unionByName(firsts.select(columns)).distinct()

    def meet(table: pa.Table) -> pa.RecordBatch:
        values = compared(table, [])
        a, b = span_groups(_groups(table, ["key", "part"])[0], lambda i, j: near(values, i, j, least))
        return table.select(["sid", "key", "part"]).take(pa.array(np.unique(np.r_[a, b]).astype(np.int64))).combine_chunks().to_batches()[0] if len(a) else pa.RecordBatch.from_pylist([], table.select(["sid", "key", "part"]).schema)

    met = _by_task(light, ["key", "part"], meet, "sid long, key long, part int")
    texts = _texts(met, base)

    def span(table: pa.Table) -> pa.RecordBatch:
        sids, bounds = table.column("sid").to_numpy(), _groups(table, ["key", "part"])[1]
        edges: list[tuple[int, int]] = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            edges += [(s + a, s + b) for a, b in span_similar(_sets(table.slice(s, e - s), width), least / OUT_OF)]
        at = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(sids[at[:, i]]) for i in (0, 1)], ["a", "b"])

    return _by_task(texts, ["key", "part"], span, "a long, b long")


def _tiles(rows: DataFrame, group: str, weight: Column, unit: int) -> DataFrame:
    """rows (group, comp, the rest) as tiles (group, lo, hi), a `part` each: those that compare every two rows of a group that differ in comp.

    The rows of a group's largest comp aren't compared with each other. They and the others are cut into parts of about `unit` in weight; each part
    of the others meets each part of both, so what moves grows with the others' number, not with the square of the group's size.
    """
    each = rows.groupBy(group, "comp").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    top = each.groupBy(group).agg(F.sum("n").alias("n"), F.sum("w").alias("all"), F.max(F.struct("w", F.col("comp").alias("comp"))).alias("most"))
    many = lambda c: F.greatest(F.ceil(c / unit), F.lit(1)).cast("int")
    small = F.col("all") <= unit
    top = stored(top.select(group, "n", F.col("most.comp").alias("top"), F.when(small, 0).otherwise(many(F.col("most.w"))).alias("p"), many(F.col("all") - F.col("most.w")).alias("q")))
    dealt = spread_join(rows, top, [group], "n")
    # A small group is the one part 0.
    resident = (F.col("comp") == F.col("top")) & (F.col("p") > 0)
    hash_ = F.xxhash64("sid")
    part = F.when(F.col("p") == 0, 0).when(resident, F.pmod(hash_, F.col("p"))).otherwise(F.col("p") + F.pmod(hash_, F.col("q"))).cast("int")
    others = F.when(F.col("p") == 0, F.array(F.lit(0))).when(resident, F.sequence(F.col("p"), F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1))
    dealt = dealt.withColumn("part", part).withColumn("other", F.explode(others))
    return dealt.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "n", "p", "q")


def _far_edges(rows: DataFrame, base: DataFrame, least: int, group: str = "key", unit: int = TILE, counted: bool = False) -> DataFrame:
    """a, b: comps that sets near by their sketches, and if `counted` by their counters, join, of rows (group, sid, comp)."""
    tiles = _tiles(rows, group, F.lit(1), unit).join(_facts(base, counted), "sid")

    def meet(table: pa.Table) -> pa.RecordBatch:
        values = compared(table, ["comp", "part", "lo", "hi"])
        comp, part, whole = values["comp"], values["part"], values["lo"] == values["hi"]
        apart = lambda i, j: (comp[i] != comp[j]) & (whole[i] | (part[i] != part[j]))

        def hit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = apart(i, j)
            out[out] = near(values, i[out], j[out], least)
            return out

        a, b = span_groups(_groups(table, [group, "lo", "hi"])[0], hit)
        pairs = np.unique(np.sort(np.stack([comp[a], comp[b]], axis=1), axis=1), axis=0).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in (0, 1)], ["a", "b"])

    return _by_task(tiles, [group, "lo", "hi"], meet, "a long, b long")


def span_across(sets: list[np.ndarray], comp: np.ndarray, asks: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Edges between sets of different comps that span the comps' components: each set that `asks` is compared with all those not joined to it yet."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(codes, np.cumsum(sizes)[:-1])
    order = np.argsort(codes, kind="stable")
    docs = owner[order]
    bounds = np.searchsorted(codes[order], np.arange(int(codes.max()) + 2))
    class_ = np.unique(comp, return_inverse=True)[1]
    edges = []
    for i in np.flatnonzero(asks).tolist():
        if (class_ == class_[i]).all():
            continue
        begin, count = bounds[own[i]], np.diff(bounds)[own[i]]
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        shared = np.bincount(docs[at], minlength=n)
        hit = np.flatnonzero((class_ != class_[i]) & (OUT_OF * shared >= least * (sizes + sizes[i] - shared)))
        for c in np.unique(class_[hit]).tolist():
            edges.append((i, int(hit[class_[hit] == c][0])))
            class_[class_ == c] = class_[i]
    return edges


def _confirmed(rows: DataFrame, base: DataFrame, width: int, least: int) -> DataFrame:
    """a, b: comps that alike sets join, of rows (cluster, comp, sid, size)."""
    tiles = _texts(_tiles(rows, "cluster", F.col("size"), PART).drop("size"), base)

    def meet(table: pa.Table) -> pa.RecordBatch:
        comp, top, bounds = table.column("comp").to_numpy(), table.column("top").to_numpy(), _groups(table, ["cluster", "lo", "hi"])[1]
        edges: list[tuple[int, int]] = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            edges += [(s + a, s + b) for a, b in span_across(_sets(table.slice(s, e - s), width), comp[s:e], (comp != top)[s:e], least)]
        at = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(comp[at[:, i]]) for i in (0, 1)], ["a", "b"])

    return _by_task(tiles, ["cluster", "lo", "hi"], meet, "a long, b long")


def _with_comps(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (sid, the rest) with comp, the set's own number where it was joined to none."""
    found = comps.select(F.col("node").alias("sid"), "root")
    return rows.join(found, "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")


def _still_open(rows: DataFrame) -> DataFrame:
    """rows (key, sid, comp) of keys whose sets are of several comps."""
    keys = stored(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"))
    return stored(spread_join(rows, keys, ["key"], "n").drop("n"))


def _shared(keys: DataFrame) -> DataFrame:
    """The rows (key, sid) of keys that several sets hold.

    A sample tells keys that many hold, whose rows stay where they are; the others' rows move once, to neighbours of the same key.
    """
    drawn = keys.where(F.pmod(F.xxhash64("sid"), F.lit(DRAWN)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    hot = F.broadcast(stored(drawn.where(F.col("n") > max(1, HOT_LEAST // DRAWN)).select("key")))
    rest = keys.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: repeated(batches, ["key", "sid"]), "key long, sid long")
    return keys.join(hot, "key", "left_semi").unionByName(rest)


def _joined(base: DataFrame, width: int, least: int) -> DataFrame:
    """(node, root) of the sets that links join, node and root being sids."""
    keys = stored(_keys(base, width, least))
    open_ = stored(_shared(keys).withColumn("comp", F.col("sid")))
    edges, comps = None, base.sparkSession.createDataFrame([], "node long, root long")
    for turn in range(SEEDS):
        found = stored(_seed_edges(open_, base, turn, width, least))
        edges = found if edges is None else edges.unionByName(found)
        comps = stored(connected_components(edges))
        open_ = _still_open(_with_comps(open_.drop("comp"), comps))
    sets = stored(_with_comps(base.select("sid", "size"), comps))
    members = lambda found: stored(sets.join(stored(found).select(F.col("node").alias("comp"), F.col("root").alias("cluster")), "comp"))
    clusters = members(connected_components(_far_edges(open_, base, least)))
    # Large sets that share any key hang together here; counters part them before texts move.
    clusters = members(connected_components(_far_edges(clusters.drop("size"), base, least, "cluster", WIDE, True)))
    links = _confirmed(clusters, base, width, least)
    return connected_components(edges.unionByName(links))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of `width` words (A-Z lower-cased, white space between); fewer words are one shingle. Two
    documents link when OUT_OF * intersection >= least * union; component_id is the smallest id that links reach. Null and empty texts and those without words
    have an empty set, link with nothing, and stand alone. A null id keeps its row; its component is the smallest non-null id reached, or null. Repeated
    rows each get theirs. Other columns are ignored; an empty table gives no rows.

    Documents with equal sets meet as one (told by 128 bits and the size). No link between different sets is lost: alike ones share a key (combination_keys()),
    and no bound that rules a pair out is ever wrong. Shingles are told by 64 bits. First each set meets others under one key a
    turn, so dense groups become one class; the keys that still hold several classes are then compared in full, and what may join two classes is settled on the sets.
    """
    own = _told(docs, id_col, text_col, width, True).where("size > 0")
    base = own.groupBy(*NAME).agg(F.min(F.struct("none", "id", "text")).alias("row"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in [*SKETCH, "counts"]))
    base = _bucketed(base.select(*NAME, "row.id", "row.text", "copies", *SKETCH, "counts").withColumn("sid", F.monotonically_increasing_id()))
    roots = stored(_with_comps(base.select("sid", "id"), _joined(base, width, least)))
    classes = stored(roots.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("n")))
    named = spread_join(roots.select("sid", "comp"), classes, ["comp"], "n").select("sid", "component_id")
    sets = stored(base.select("sid", *NAME, "copies").join(named, "sid").drop("sid"))
    told = stored(_told(docs, id_col, text_col, width, False))
    out = spread_join(told.where("size > 0"), sets, NAME, "copies").select("id", "size", "component_id")
    alone = told.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")
