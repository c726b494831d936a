"""Texts whose sets of word shingles are alike, without losing a link: pigeonhole keys, then Hamming distance, then the sets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_values, connected_components, shared_folder, stored, whole_groups
from .simhash import TILE, near_links, shingle_hashes

WIDTH = 5
LEAST = 0.8
#: Texts of which shingles are counted to tell which are common, and how many are told. They only change the order in which
#: shingles are taken as keys, which any order does exactly.
SAMPLE = 8192
COMMON = 4096
#: A sketch's bits, and the class of sets, of 2**WHOLE up to twice as many shingles, from which on a part of the shingles is sketched.
SKETCH = 256
WHOLE = 7
#: Standard deviations by which a sketched part may differ from its share of all differences.
SLACK = 6.0
#: Shingles of a cluster's part, whose texts are compared at once.
PART = 1 << 20
SHORT = 1e-9


def shingle_set(text: bytes | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    each = list(shingle_hashes(text or b"", width, seed))
    return np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)


def set_hash(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)


def prefix(h: np.ndarray, common: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The keys of a set: its first shingles in one order of all shingles, common ones last.

    Two sets of which n shingles each must share m hold one shared shingle among the first n - m + 1: were all those
    left out of the other, too few would be left to share.
    """
    n = len(h)
    if not n:
        return h
    many = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(n, bool)
    return np.concatenate([h[~many], h[many]])[: n - ceil(least * n - SHORT) + 1]


def sketch(h: np.ndarray, level: int) -> tuple[int, np.ndarray]:
    """(shingles sketched, four words): a bit is the parity of the shingles that fall on it, so sets that differ by d shingles differ by d bits at most.

    Beyond WHOLE, one in 2**(level - WHOLE) shingles is sketched.
    """
    m = h * np.uint64(0x9E3779B97F4A7C15)
    m ^= m >> np.uint64(32)
    m *= np.uint64(0xD6E8FEB86659FD93)
    if level > WHOLE:
        m = m[m >> np.uint64(64 - (level - WHOLE)) == 0]
    bits = np.bincount((m & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return len(m), np.packbits(bits.astype(np.uint8)).view(np.int64)


#: What a set is known by: sets of different sizes are told apart even if their hashes are equal.
SET = ["same", "size"]
#: What is known of a set: its size, its class, and sketches for its own class and the one below.
FACTS = ["size", "level", "n", "w0", "w1", "w2", "w3", "below", "b0", "b1", "b2", "b3"]


def facts(h: np.ndarray) -> tuple[int, ...]:
    level = max(0, len(h).bit_length() - 1)
    own, low = sketch(h, level), sketch(h, level - 1)
    return (len(h), level, own[0], *own[1].tolist(), low[0], *low[1].tolist())


def near(values: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Whether sets may be alike: by size, and by the Hamming distance of their sketches.

    Sets of a and b shingles that are alike differ by (1 - least) / (1 + least) * (a + b) shingles at most. That is certain while
    all shingles are sketched; of larger sets, a part of the differences is drawn, which may exceed its share by SLACK deviations.
    """
    size, level = values["size"], values["level"]
    fits = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - SHORT
    i, j = i[fits], j[fits]
    lower = np.minimum(level[i], level[j])
    bits, n = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    words = {}
    for side in (i, j):
        own = level[side] == lower
        n += np.where(own, values["n"][side], values["below"][side])
        for k in range(4):
            word = np.where(own, values[f"w{k}"][side], values[f"b{k}"][side])
            if side is i:
                words[k] = word
            else:
                bits += np.bitwise_count((words[k] ^ word).view(np.uint64))
    most = (1 - least) / (1 + least) * n
    most = np.where(lower > WHOLE, most + SLACK * np.sqrt(most), most)
    hit = fits
    hit[np.flatnonzero(fits)] = bits <= most + SHORT
    return hit


def span_similar(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges spanning the graph of sets whose Jaccard similarity is `least` or more.

    An inverted index gives what a set shares with those not reached yet; as they
    get fewer it is cut down to them, so a dense group's members are cheap once most are reached.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    blank = np.flatnonzero(sizes == 0).tolist()
    edges = [(blank[0], i) for i in blank[1:]]
    owner = np.repeat(np.arange(n), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if owner.size else np.zeros(0, np.int64)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    left = sizes > 0
    order = np.argsort(codes, kind="stable")
    docs, code = owner[order], codes[order]
    top, held = int(codes.max(initial=-1)) + 1, int(left.sum())
    bounds = np.searchsorted(code, np.arange(top + 1))
    for first in np.flatnonzero(left).tolist():
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo:
            pivot = todo.pop()
            remain = int(left.sum())
            if not remain:
                break
            if 2 * remain < held:
                keep = left[docs]
                docs, code, held = docs[keep], code[keep], remain
                bounds = np.searchsorted(code, np.arange(top + 1))
            begin, count = bounds[own[pivot]], np.diff(bounds)[own[pivot]]
            at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            shared = np.bincount(docs[at], minlength=n)
            hit = np.flatnonzero(left & (shared > 0) & (shared >= least * (sizes + sizes[pivot] - shared) - SHORT))
            left[hit] = False
            edges += [(pivot, i) for i in hit.tolist()]
            todo += hit.tolist()
    return edges


def _told(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """docs (none, id, text, the rest) with `same` (a hash of the set of shingles) and FACTS."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, each = [], []
            for text in byte_values(batch.column(2)):
                h = shingle_set(text, width, seed)
                same.append(set_hash(h))
                each.append(facts(h))
            columns = zip(*each, strict=True) if each else [()] * len(FACTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], [*names, "same", *FACTS])

    longs = [StructField(c, LongType()) for c in ("same", *FACTS)]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *longs]))


def _distinct(docs: DataFrame, id_col: str, text_col: str, keep: list[str], width: int, seed: int) -> DataFrame:
    """A row for each set of shingles, bucketed by SET: row (the first of its documents, by id, then text, then the rest), same and FACTS.

    Documents with equal sets meet here, combined before the shuffle; it's the only time that texts move.
    """
    spark = docs.sparkSession
    rest = [c for c in keep if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)))
    told = _told(rows, width, seed)
    base = told.groupBy(*SET).agg(F.min(F.struct(*rows.columns)).alias("row"), *(F.first(c).alias(c) for c in FACTS if c != "size"))
    name = f"loam_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base.select("row", "same", *FACTS).write.option("compression", "zstd").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").bucketBy(buckets, *SET).saveAsTable(name)
    return spark.table(name)


def _common(base: DataFrame, width: int, seed: int) -> np.ndarray:
    """The shingles that most of SAMPLE texts hold, COMMON at most, sorted."""
    n = base.count()
    drawn = base.where(F.pmod(F.xxhash64("same", F.lit("drawn")), F.lit(1 << 20)) < F.lit(max(1, ceil((1 << 20) * SAMPLE / max(n, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in byte_values(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, width, seed).view(np.int64))], ["h"])

    counts = drawn.select("row.text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 3")
    got = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return np.sort(np.array([r["h"] for r in got], np.int64).view(np.uint64))


def repeated(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of longs, sorted by the first, a key, whose key a neighbour has too."""
    # The last row so far, and whether it was told.
    last, told = [np.zeros(0, np.int64)] * len(names), False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.r_[old, new.to_numpy()] for old, new in zip(last, batch.columns, strict=True)]
        again = columns[0][1:] == columns[0][:-1]
        hit = np.r_[again, False] | np.r_[False, again]
        hit[0] &= not told
        told = bool(again[-1]) if len(again) else False
        last = [c[-1:] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in columns], names)


def _node(prefix: str = "") -> Column:
    """A set as a node: in the order of the ids of its first documents, null ids last."""
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("none", "id", *SET)))


def _links(base: DataFrame, width: int, least: float, seed: int) -> DataFrame:
    """Edges a-b of nodes that span the clusters of sets that share a key and whose sketches are near."""
    common = base.sparkSession.sparkContext.broadcast(_common(base, width, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, size, text in zip(*(batch.column(i).to_numpy() for i in (0, 1)), byte_values(batch.column(2)), strict=True):
                keys = prefix(shingle_set(text, width, seed), common.value, least)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(np.full(len(keys), v)) for v in (same, size))], ["key", *SET])

    schema = "key long, same long, size long"
    keys = base.select(*SET, "row.text").mapInArrow(run, schema)
    met = stored(keys.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: repeated(batches, ["key", *SET]), schema))
    hot = met.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > TILE)
    sets = base.select("same", "row.none", "row.id", *FACTS)
    keyed = met.join(sets, SET).select("key", _node().alias("node"), *FACTS)
    return near_links(keyed, hot, lambda values, i, j: near(values, i, j, least))


def _confirmed(base: DataFrame, clusters: DataFrame, width: int, least: float, seed: int) -> DataFrame:
    """Edges a-b that span each cluster's sets of a similarity of `least` or more.

    A cluster (node, root) is cut in parts of about PART shingles, each pair of which is one group, so none is too large for a task.
    """
    members = stored(clusters.select("node.same", "node.size", F.col("root.same").alias("root")))
    large = members.groupBy("root").agg(F.ceil(F.sum("size") / PART).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = members.join(large, "root", "left").select(*SET, "root", parts.alias("parts"), F.pmod(F.xxhash64("same"), parts).cast("int").alias("part"))
    held = base.select(*SET, "row.none", "row.id", "row.text").join(dealt, SET)
    tiles = held.select("root", _node().alias("node"), "text", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "text")
    tiles = tiles.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["root", "lo", "hi"]):
            table = table.combine_chunks()
            columns = [table.column(c).to_numpy() for c in ("root", "lo", "hi")]
            start = np.ones(len(columns[0]), bool)
            start[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            bounds = np.r_[np.flatnonzero(start), len(start)]
            edges: list[tuple[int, int]] = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = [shingle_set(t, width, seed) for t in byte_values(table.column("text").slice(s, e - s).combine_chunks())]
                edges += [(s + a, s + b) for a, b in span_similar(sets, least)]
            at = np.array(edges, np.int64).reshape(-1, 2)
            node = table.column("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(at[:, i])).combine_chunks() for i in (0, 1)], ["a", "b"])

    kind = tiles.schema["node"].dataType.simpleString()
    return tiles.mapInArrow(run, f"a {kind}, b {kind}")


def _classes(base: DataFrame, width: int, least: float, seed: int) -> DataFrame:
    """(node, root) of every set that is linked to another."""
    clusters = connected_components(_links(base, width, least, seed))
    return connected_components(_confirmed(base, stored(clusters), width, least, seed))


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, seed: int = 42) -> DataFrame:
    """The documents, one of each class of texts linked by a Jaccard similarity of `least` or more of their sets of `width`-word shingles.

    The one that stays has the class's smallest id; null ids come after all others, and equal ids are
    told apart by their texts, then by the other columns. So rows with one id are one document only if their texts are alike, a
    repeated row stays once, and rows with null ids are compared like others. Null and empty texts and
    those without words are alike. Texts of fewer words than `width` are one shingle. An empty table gives no rows.

    Three steps, none of which loses a link but by the chance that near() states: sets that are alike share one of few
    keys (prefix()); of those that share a key, sketches within the Hamming distance that similarity allows
    make clusters; within these the sets themselves are compared. Columns need an order (no maps).
    """
    base = _distinct(docs, id_col, text_col, docs.columns, width, seed)
    lost = _classes(base, width, least, seed).where("node <> root").select("node.same", "node.size")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    place = {id_col: "row.id", text_col: "row.text"} | {c: f"row.c{i}" for i, c in enumerate(rest)}
    return base.join(lost, SET, "left_anti").select(*(F.col(place[c]).alias(c) for c in docs.columns))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, seed: int = 42) -> DataFrame:
    """Per row: doc_id, class_id: the smallest id of the texts that are alike as in one_of_similar(), null if none has an id."""
    base = _distinct(docs, id_col, text_col, [], width, seed)
    classes = _classes(base, width, least, seed).select("node.same", "node.size", F.struct("root.id").alias("root"))
    classes = base.select(*SET, "row.id").join(classes, SET, "left").select(*SET, F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("root.id")).alias("class_id"))
    told = _told(docs.select(F.lit(False).alias("none"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), width, seed)
    return told.select(F.col("id").alias("doc_id"), *SET).join(classes, SET).select("doc_id", "class_id")
