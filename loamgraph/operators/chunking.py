"""Documents to chunks. Every function returns a row a chunk, with its place in chunk_order_index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions.text import empty_if_null, sentences, strip, tokens

SIZE, OVERLAP = 1200, 100
RERANK_SIZE = 4096
#: Sentences of a document that are embedded at once.
SENTENCES = 256


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """First tokens of windows that overlap; none is inside the one before. An overlap as large as the window is none."""
    step = size - overlap if overlap < size else size
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int") * step
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def by_tokens(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separator: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of tokens. A separator is taken out before, and joins what it parted."""
    text = empty_if_null(F.col(text_col))
    if separator:
        text = F.replace(text, F.lit(separator), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(text).alias("toks"))
    rows = rows.select("doc_id", "toks", F.posexplode(window_starts(F.size("toks"), size, overlap)).alias("chunk_order_index", "start"))
    rows = rows.select("doc_id", "chunk_order_index", F.slice("toks", F.col("start") + 1, F.lit(size)).alias("own"))
    return rows.select("doc_id", "chunk_order_index", F.size("own").alias("tokens"), F.array_join("own", " ").alias("content"))


def _pieces(docs: DataFrame, pieces: Column, id_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("chunk_order_index", "content"))
    return rows.where("content <> ''").select("doc_id", "chunk_order_index", F.size(tokens(F.col("content"))).alias("tokens"), "content")


def by_separator(docs: DataFrame, separator: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stripped pieces between separators; empty ones are left out and leave a gap in the order."""
    return _pieces(docs, F.transform(F.split(empty_if_null(F.col(text_col)), f"\\Q{separator}\\E"), strip), id_col)


def by_sentence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _pieces(docs, sentences(F.col(text_col)), id_col)


def for_rerank(docs: DataFrame, size: int = RERANK_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts of a fixed number of characters: doc_id, chunk_idx, content."""
    n = F.greatest(F.ceil(F.length(empty_if_null(F.col(text_col))) / size).cast("int"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(F.col(text_col)).alias("text"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx"))
    return rows.select("doc_id", "chunk_idx", F.substr("text", F.col("chunk_idx") * size + 1, F.lit(size)).alias("content"))


def _joined(items: Column, goes_on: Callable[[Column, Column], Column]) -> Column:
    """Texts of items (text, and what goes_on() asks), each put after the one before, with a space, where goes_on(text so far, item) says so."""

    def put(out: Column, item: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit(" "), item["text"])))
        return F.when((F.size(out) > 0) & goes_on(last, item), longer).otherwise(F.concat(out, F.array(item["text"])))

    return F.aggregate(items, F.array().cast("array<string>"), put)


def semantic(docs: DataFrame, drift: float = 0.5, least: int = 100, most: int = 2000, embedder: models.Embedder | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences parted where neighbouring embeddings drift, then packed: pieces join while they fit `most`
    characters, longer ones are cut, ones under `least` join the piece before. Only the embedding runs in Python, which returns
    no vectors but whether neighbours are near.
    """
    model = embedder or models.hashing_embedder()

    def near(parts: list[str]) -> np.ndarray:
        """Whether each sentence is near the one before; SENTENCES are embedded at once, with the last one before them."""
        out = np.zeros(len(parts), bool)
        for at in range(1, len(parts), SENTENCES):
            e = np.asarray(model(list(parts[at - 1 : at + SENTENCES])), np.float64)
            # Sums in the order of the components.
            dot = lambda a, b: np.cumsum(a * b, axis=1)[:, -1]
            norm = np.sqrt(dot(e, e))
            out[at : at + SENTENCES] = 1 - dot(e[1:], e[:-1]) / (norm[1:] * norm[:-1] + 1e-10) <= drift
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(near)

    rows = docs.select(F.col(id_col).alias("doc_id"), sentences(F.col(text_col)).alias("parts"))
    rows = rows.withColumn("near", F.pandas_udf(run, "array<boolean>")("parts"))
    pieces = _joined(F.transform("parts", lambda s, i: F.struct(s.alias("text"), F.get("near", i).alias("near"))), lambda _, item: item["near"])
    packed = _joined(F.transform(pieces, lambda p: F.struct(p.alias("text"))), lambda text, item: F.length(text) + F.length(item["text"]) <= most)

    def cuts(p: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int"))
        each = F.transform(places, lambda i: strip(F.substr(p, i * most + 1, F.lit(most))))
        return F.transform(F.filter(each, lambda x: x != ""), lambda x: F.struct(x.alias("text"), F.lit(False).alias("short")))

    kept = F.transform(packed, lambda p: F.when(F.length(p) > most, cuts(p)).otherwise(F.array(F.struct(p.alias("text"), (F.length(p) < least).alias("short")))))
    chunks = _joined(F.flatten(kept), lambda _, item: item["short"])
    rows = rows.select("doc_id", F.posexplode(chunks).alias("chunk_order_index", "content"))
    return rows.select("doc_id", "chunk_order_index", F.size(tokens(F.col("content"))).alias("tokens"), "content")


def by_structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Markdown sections with their headings' path, or paragraphs where a text has no heading.

    A fold over the lines keeps the open headings (a heading closes those of its level
    and below), the section being read and the sections with a body.
    """
    text = empty_if_null(F.col(text_col))
    state = "struct<stack:array<struct<level:int,title:string>>,body:array<string>,done:array<struct<section_path:string,content:string>>>"
    path = lambda s: F.array_join(F.transform(s["stack"], lambda h: h["title"]), " > ")

    def close(s: Column) -> Column:
        content = strip(F.array_join(s["body"], "\n"))
        section = F.struct(F.when(F.size(s["stack"]) > 0, path(s)).alias("section_path"), content.alias("content"))
        return F.when(content != "", F.concat(s["done"], F.array(section))).otherwise(s["done"])

    def read(s: Column, line: Column) -> Column:
        marks = F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 1)
        title = strip(F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 2))
        level = F.length(marks)
        stack = F.concat(F.filter(s["stack"], lambda h: h["level"] < level), F.array(F.struct(level.cast("int").alias("level"), title.alias("title"))))
        opened = F.struct(stack.alias("stack"), F.array().cast("array<string>").alias("body"), close(s).alias("done"))
        added = F.struct(s["stack"].alias("stack"), F.concat(s["body"], F.array(line)).alias("body"), s["done"].alias("done"))
        return F.when(level > 0, opened).otherwise(added)

    empty = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("stack"), F.array().cast("array<string>").alias("body"), F.array().cast("array<struct<section_path:string,content:string>>").alias("done")).cast(state)
    sections = F.aggregate(F.split(text, "\n"), empty, lambda s, line: read(s, line).cast(state), close)
    paragraphs = F.transform(F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != ""), lambda p: F.struct(F.lit(None).cast("string").alias("section_path"), p.alias("content")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.when(text.rlike(r"(?m)^#{1,6}\s"), sections).otherwise(paragraphs)).alias("chunk_order_index", "c"))
    return rows.select("doc_id", "chunk_order_index", F.col("c.section_path").alias("section_path"), F.col("c.content").alias("content"), F.size(tokens(F.col("c.content"))).alias("tokens"))
