"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_values, connected_components, local_components, shared_folder, stored, whole_groups

BITS = 64
#: Fingerprints of a block's tile that are compared with each other at once.
TILE = 1024
#: Of so many nodes one is drawn to find keys held by many.
SAMPLE = 64
SHINGLES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of `width` words, in runs of bounded length."""
    words = text.lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    width = min(width, len(words))
    for at in range(0, n, SHINGLES_AT_ONCE):
        to = min(n, at + SHINGLES_AT_ONCE)
        yield np.fromiter((digest(line[s : e - 1], seed) for s, e in zip(ends[at:to], ends[at + width : to + width], strict=True)), np.uint64, to - at)


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Majority vote of the shingles' hash bits, as an unsigned integer; 0 without words."""
    count, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text or b"", width, seed):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width, seed) for t in byte_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """Every choice of blocks - distance blocks: two fingerprints within the distance agree in one choice."""
    base, extra = divmod(BITS, blocks)
    sizes = [base + (i < extra) for i in range(blocks)]
    starts = list(accumulate(sizes, initial=0))
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(n).cast("long")
        for b in chosen:
            part = F.shiftrightunsigned(fp, starts[b]).bitwiseAND(F.lit((1 << sizes[b]) - 1).cast("long"))
            key = F.shiftleft(key, sizes[b]).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


#: Keys have about as many bits as the number of fingerprints, so that chance meetings per fingerprint stay few.
BLOCKS = (6, 7, 8)


def blocks_for(n: int, distance: int = 4) -> int:
    """The fewest blocks whose keys, of all but `distance` of them, tell n fingerprints apart but for a few. Any number finds the same links."""
    for blocks in BLOCKS:
        blocks += distance - 4
        if n >> (BITS * (blocks - distance) // blocks) < 4:
            break
    return blocks


def hot_keys(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, held: about how many nodes hold each key that a sample of one in SAMPLE shows in more than TILE of them."""
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"))
    return drawn.groupBy("key").agg((F.count("*") * SAMPLE).alias("held")).where(F.col("held") > TILE)


Near = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def near_links(keyed: DataFrame, hot: DataFrame, near: Near) -> DataFrame:
    """Edges a-b that span the graph of nodes that share a key and that near() tells are near.

    keyed: key (long), node (of any type) and numbers that near() compares: it gets them by name, and the rows' places in pairs.
    hot: key, held (their number) of keys with over TILE nodes. Such a key is cut in parts, and each pair of parts is a
    tile of bounded size, so no group is too large for a task and no pair is lost (hot decides how work is dealt,
    not what is compared). A tile returns edges to its components' first members only, never its pairs.
    """
    payload = [c for c in keyed.columns if c not in ("key", "node")]
    parts = F.coalesce(F.ceil(F.col("held") / TILE).cast("int"), F.lit(1))
    dealt = keyed.join(stored(hot), "key", "left").select("key", "node", *payload, parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    tiles = dealt.select("key", "node", *payload, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", *payload)
    tiles = tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "lo", "hi"]):
            table = table.combine_chunks()
            key, lo, hi, part = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "part"))
            values = {c: table.column(c).to_numpy() for c in payload}
            start = np.zeros(len(key), bool)
            for c in (key, lo, hi):
                start[1:] |= c[1:] != c[:-1]
            # A tile of two parts compares across them: each part has a tile of its own.
            whole = lo == hi
            a, b = span_groups(np.cumsum(start), lambda i, j: (whole[i] | (part[i] != part[j])) & near(values, i, j))  # noqa: B023
            node = table.column("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(x)).combine_chunks() for x in (a, b)], ["a", "b"])

    kind = keyed.schema["node"].dataType.simpleString()
    return tiles.mapInArrow(run, f"a {kind}, b {kind}")


def span_groups(group: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of edges spanning each sorted group's components of rows that near() tells are near."""
    n = len(group)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = np.arange(max(0, n - 1)), 1
    while True:
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        hit = at[near(at, at + step)]
        a, b = np.concatenate([a, hit]), np.concatenate([b, hit + step])
        step += 1
        if len(a) > 8 * n:
            label = local_components(n, a, b)
            a = np.flatnonzero(label != np.arange(n))
            b = label[a]
    label = local_components(n, a, b)
    a = np.flatnonzero(label != np.arange(n))
    return a, label[a]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Rows with equal fingerprints meet as one before blocks are joined; a fingerprint is a node named
    by its smallest id, so that a component's smallest node is its smallest id. Null text counts as
    empty; texts without words share fingerprint zero and link like any
    other; a row with a null id keeps its row, and its component's smallest
    non-null id. Repeated rows each get theirs. Other columns are ignored. `blocks` is
    chosen by the number of fingerprints where it isn't given, which changes no result.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width, seed))
    firsts = stored(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = _roots(firsts, distance, blocks)
    classes = roots.select(F.col("node.fp").alias("fp"), F.col("root.id").alias("component_id"))
    classes = firsts.join(classes.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _roots(firsts: DataFrame, distance: int, blocks: int | None = None) -> DataFrame:
    """(node, root) of every fingerprint that is linked to another, of distinct ones (fp, first: the smallest id, or null)."""
    if blocks is None:
        blocks = blocks_for(firsts.count(), distance)
    if not 1 <= distance < blocks:
        raise ValueError("blocks must outnumber the distance")
    # Nulls after all ids; equal ids are told apart by their fingerprints.
    node = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("fp").alias("fp"))
    nodes = firsts.select(node.alias("node"), F.col("fp").alias("word"), block_keys(F.col("fp"), distance, blocks).alias("keys"))
    keyed = nodes.select("node", "word", F.explode("keys").alias("key"))

    def near(values: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        word = values["word"].view(np.uint64)
        return np.bitwise_count(word[i] ^ word[j]) <= distance

    return connected_components(near_links(keyed, hot_keys(keyed, nodes), near))


def one_of_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """The documents, one of each component that near_duplicates() finds: that with the smallest id.

    Null ids come after all others, and equal ids are told apart by their texts, then by the other columns: rows of one id are one document
    only if their fingerprints are linked, a repeated row stays once, and rows with null ids are compared like others. Texts without words
    are one component. Columns need an order (no maps). An empty table gives no rows.

    Texts move once, to where the rows of their fingerprint meet, combined before the shuffle; what is lost is looked up there.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    place = {id_col: "id", text_col: "text"} | {c: f"c{i}" for i, c in enumerate(rest)}
    rows = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(place[c]) for c in rest))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width, seed) for t in byte_values(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*names, "fp"])

    told = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fp", LongType())]))
    name = f"loam_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = told.groupBy("fp").agg(F.min(F.struct(*names)).alias("row"))
    held.write.option("compression", "zstd").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").bucketBy(buckets, "fp").saveAsTable(name)
    base = spark.table(name)
    roots = _roots(stored(base.select("fp", F.col("row.id").alias("first"))), distance)
    lost = roots.where("node <> root").select(F.col("node.fp").alias("fp"))
    return base.join(lost, "fp", "left_anti").select(*(F.col(f"row.{place[c]}").alias(c) for c in docs.columns))
