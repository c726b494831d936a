"""Repeated multi-line passages: chunks with boundaries chosen by content, or the pairs of neighbouring lines at every offset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, stored

#: A boundary's rolling hash spans this many lines and falls once in EVERY lines.
WINDOW = 2
EVERY = 4
#: A chunk that can be removed has this many lines with text, at least.
LINES = 2
#: A pair that holds over one part in HOT of all repeated places, and over HOT_LEAST of them, is dealt to several tasks.
HOT, HOT_LEAST = 2000, 1000
MULTIPLIER = 0x100000001B3
MASK = (1 << 64) - 1


def chunk_lines(lines: list[bytes], window: int = WINDOW, every: int = EVERY) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk.

    A polynomial hash rolls over the last `window` line hashes; a chunk ends where it is 0 modulo
    `every`. A chunk's inner boundaries depend on its own lines alone, so lines added
    elsewhere move none of them.
    """
    out, begin, rolling = [], 0, 0
    drop = pow(MULTIPLIER, window, 1 << 64)
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    for i, h in enumerate(hashes):
        rolling = (rolling * MULTIPLIER + h - (hashes[i - window] * drop if i >= window else 0)) & MASK
        if i + 1 >= window and (rolling ^ rolling >> 29) % every == 0:
            out.append((begin, i + 1))
            begin = i + 1
    if begin < len(lines):
        out.append((begin, len(lines)))
    return out


#: Internal columns; documents' own columns can't clash with them.
ID, TAG, GONE = "_loam_id", "_loam_tag", "_loam_gone"


def _chunk_rows(rows: DataFrame, window: int, every: int, least_lines: int, with_body: bool) -> DataFrame:
    """id, tag, chunk (its number), hash (128 bits in two longs), and the bytes if asked, of every chunk that can go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, digests, number, bodies = [], [], [], []
            for i, text in enumerate(byte_values(batch.column(2))):
                lines = text.split(b"\n") if text else []
                for n, (a, b) in enumerate(chunk_lines(lines, window, every)):
                    if sum(1 for line in lines[a:b] if line.strip()) < least_lines:
                        continue
                    body = b"\n".join(lines[a:b])
                    at.append(i)
                    number.append(n)
                    digests.append(xxhash.xxh3_128_digest(body))
                    if with_body:
                        bodies.append(body)
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(at, pa.int32())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(bodies, pa.binary())] if with_body else [])], ["id", "tag", "chunk", "h1", "h2", "body"][: len(columns) + with_body])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "tag", "text").mapInArrow(run, f"id {kind}, tag long, chunk int, h1 long, h2 long" + ", body binary" * with_body)


def repeated_chunks(rows: DataFrame, window: int = WINDOW, every: int = EVERY, least_lines: int = LINES) -> DataFrame:
    """id, tag, chunk of every chunk that an earlier place holds byte for byte, in the order (id, tag, chunk).

    Bytes are grouped by hash and content, combined before the shuffle, so a chunk that is
    everywhere moves once a task. A hash with one content is that content wherever it stands; a hash with
    two contents (a collision) removes nothing. Places carry hashes only.
    """
    contents = _chunk_rows(rows, window, every, least_lines, True).groupBy("h1", "h2", "body").agg(F.count("*").alias("n"), F.min(F.struct("id", "tag", "chunk")).alias("first"))
    many = contents.groupBy("h1", "h2").agg(F.count("*").alias("bodies"), F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1 and bodies = 1").select("h1", "h2", "first")
    places = _chunk_rows(rows, window, every, least_lines, False)
    return places.join(many, ["h1", "h2"]).where(~F.struct("id", "tag", "chunk").eqNullSafe(F.col("first"))).select("id", "tag", "chunk")


def line_pairs(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each line with text and the next one, with the blank lines between them."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    return [(a, b + 1) for a, b in zip(full, full[1:])]


#: A pair's key: two line hashes of 128 bits, and the blank lines between as they are.
PAIR = ["a1", "a2", "gap", "b1", "b2"]


def _halves(lines: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").astype(np.int64).reshape(-1, 2)


def _pair_rows(rows: DataFrame) -> DataFrame:
    """id, tag, chunk (the pair's number) and PAIR of every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, a, b, gaps = [], [], [], [], []
            for i, text in enumerate(byte_values(batch.column(2))):
                lines = text.split(b"\n") if text else []
                for n, (begin, end) in enumerate(line_pairs(lines)):
                    at.append(i)
                    number.append(n)
                    a.append(lines[begin])
                    b.append(lines[end - 1])
                    gaps.append(b"\n".join([b"", *lines[begin + 1 : end - 1]]))
            at, first, second = pa.array(at, pa.int32()), _halves(a), _halves(b)
            halves = [pa.array(h[:, i]) for h in (first, second) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), *halves[:2], pa.array(gaps, pa.binary()), *halves[2:]], ["id", "tag", "chunk", *PAIR])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "tag", "text").mapInArrow(run, f"id {kind}, tag long, chunk int, a1 long, a2 long, gap binary, b1 long, b2 long")


def _line_rows(rows: DataFrame) -> DataFrame:
    """h1, h2, body of every line that stands in a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for text in byte_values(batch.column(0)):
                full = [line for line in text.split(b"\n") if line.strip()] if text else []
                bodies += full if len(full) > 1 else []
            halves = _halves(bodies)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bodies, pa.binary())], ["h1", "h2", "body"])

    return rows.select("text").mapInArrow(run, "h1 long, h2 long, body binary")


def repeated_pairs(rows: DataFrame) -> DataFrame:
    """id, tag, chunk of every pair that an earlier place holds byte for byte, in the order (id, tag, chunk).

    Lines move once, to be compared byte for byte: a hash with two contents (a collision) removes
    nothing. Pairs overlap, and carry hashes only.
    """
    clash = _line_rows(rows).distinct().groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    many = stored(_pair_rows(rows).groupBy(*PAIR).agg(F.count("*").alias("n"), F.min(F.struct("id", "tag", "chunk")).alias("first")).where("n > 1"))
    # Of all repeated places, a hot pair holds over one part in HOT, so there are fewer than HOT such pairs. Each is dealt to several tasks.
    share = max(HOT_LEAST, (many.agg(F.sum("n")).first()[0] or 0) // HOT)
    parts = F.ceil(F.col("n") / F.lit(share)).cast("int")
    hot = many.where(F.col("n") > share).select(*PAIR, parts.alias("parts"))
    salt = F.coalesce(F.pmod(F.xxhash64("id", "tag", "chunk"), F.col("parts")), F.lit(0)).cast("int")
    places = _pair_rows(rows).join(F.broadcast(hot), PAIR, "left").withColumn("salt", salt)
    again = places.drop("parts").join(many.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))), [*PAIR, "salt"]).where(~F.struct("id", "tag", "chunk").eqNullSafe(F.col("first")))
    for side in "ab":
        again = again.join(F.broadcast(clash), (F.col("h1") == F.col(f"{side}1")) & (F.col("h2") == F.col(f"{side}2")), "left_anti")
    return again.select("id", "tag", "chunk")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, every: int = EVERY, least_lines: int = LINES, pairs: bool = False) -> DataFrame:
    """The documents, text without repeated chunks, plus n_lines, n_chunks, removed_chunks, removed_lines.

    With `pairs`, the chunks are all pairs of neighbouring lines with text, so every passage of two or more
    goes wherever its ends lie; as pairs overlap, what is sure to stay is one copy of each line.

    Of a chunk of at least `least_lines` lines with text that stands in several places, the
    one in the smallest (id, text hash, chunk number) stays. Null texts stay null with no lines;
    an empty text is one empty line. Null ids sort first. Rows that repeat both id and text are
    one place, and keep and lose the same chunks. Other columns pass through;
    those named like a result are replaced.
    """
    rows = docs.withColumn(ID, F.col(id_col)).withColumn(TAG, F.xxhash64(F.col(text_col)))
    told = rows.select(F.col(ID).alias("id"), F.col(TAG).alias("tag"), F.col(text_col).cast("string").alias("text"))
    gone = repeated_pairs(told) if pairs else repeated_chunks(told, window, every, least_lines)
    gone = gone.groupBy("id", "tag").agg(F.collect_set("chunk").alias(GONE)).withColumnsRenamed({"id": "_loam_id2", "tag": "_loam_tag2"})
    results = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    both = rows.drop(*results).join(gone, (F.col(TAG) == F.col("_loam_tag2")) & F.col(ID).eqNullSafe(F.col("_loam_id2")), "left")
    names = [c for c in docs.columns if c not in results]
    both = both.select(*(F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in names), GONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            out, counts = [], []
            for text, removed in zip(byte_values(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                lines = text.split(b"\n") if text is not None else []
                chunks = line_pairs(lines) if pairs else chunk_lines(lines, window, every)
                removed = set(removed or ())
                lost = {i for n in removed for i in range(*chunks[n])}
                kept = [line for i, line in enumerate(lines) if i not in lost]
                out.append(None if text is None else b"\n".join(kept).decode("utf-8"))
                counts.append((len(lines), len(chunks), len(removed), len(lines) - len(kept)))
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(out, pa.string())
            numbers = zip(*counts, strict=True) if counts else [()] * 4
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in numbers)], [*names, *results])

    schema = both.drop(GONE).schema
    for c in results:
        schema = schema.add(c, "long")
    return both.mapInArrow(run, schema)
