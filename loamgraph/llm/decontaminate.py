"""Benchmark passages in documents: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values

#: Words in a seed, and the run of an item's seeds of which the rarest is used.
SEED = 3
SPREAD = 4
#: An n-gram is rare if one document in RARE holds it at most, or FEW do.
RARE, FEW = 1000, 100
#: Share of the item's own score that an alignment must reach.
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items held by a task at once; more items are further blocks, each a pass over the documents.
BLOCK_WORDS = 1_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other than ASCII characters, A-Z lowered."""
    return WORD.findall(text.lower()) if text else []


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(score, end in b) of the best local alignment of word numbers a and b; the end is one past the last word."""
    best, end = 0, 0
    line = np.zeros(len(b) + 1, np.int32)
    slope = np.arange(len(b) + 1, dtype=np.int32) * -GAP
    for x in a.tolist():
        new = np.maximum(line + GAP, 0)
        new[1:] = np.maximum(new[1:], line[:-1] + np.where(b == x, MATCH, MISMATCH))
        # A gap in a: the best start to the left, less its distance.
        line = np.maximum.accumulate(new + slope) - slope
        top = int(line.max())
        if top > best:
            best, end = top, int(line.argmax())
    return best, end


class Items:
    """A block of test items: its vocabulary, its n-grams and their places."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        #: Items of fewer words than a seed has, by their word numbers.
        self.short: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            own = words(text)
            if own:
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own], np.int64))
            if 0 < len(own) < SEED:
                self.short.setdefault(tuple(self.words[-1].tolist()), []).append(len(self.ids) - 1)
        every = [self.keys(w) for w in self.words]
        self.grams = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
        self.places = [np.searchsorted(self.grams, k) for k in every]

    def numbers(self, own: list[bytes]) -> np.ndarray:
        """Word numbers; -1 for words that no item has."""
        return np.array(list(map(self.vocabulary.get, own, repeat(-1))), np.int64)

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """A key for each place's n-gram, -1 where an item can't have it."""
        n = len(numbers) - SEED + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        base = len(self.vocabulary) + 1
        key, fits = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(SEED):
            part = numbers[j : j + n]
            fits &= part >= 0
            # Up to BLOCK_WORDS distinct words, three to a key: less than 2**60.
            key = key * base + part
        return np.where(fits, key, -1)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, gram numbers) of the items' n-grams."""
        key = self.keys(numbers)
        at = np.searchsorted(self.grams, key)
        hit = np.flatnonzero(self.grams[np.minimum(at, max(0, len(self.grams) - 1))] == key) if len(self.grams) else np.zeros(0, np.int64)
        return hit, at[hit]

    def rare(self, df: dict[int, int], docs: int) -> dict[int, list[tuple[int, int]]]:
        """Seeds as gram -> (item index, place): an item's n-grams that one document in RARE holds at most (or FEW), and, so that
        no stretch is without, of each SPREAD n-grams in a row the one that fewest hold."""
        out: dict[int, list[tuple[int, int]]] = {}
        most = max(FEW, docs // RARE)
        for i, grams in enumerate(self.places):
            if not len(grams):
                continue
            counts = [df.get(int(g), 0) for g in grams]
            chosen = {min(range(s, min(s + SPREAD, len(counts))), key=lambda j: (counts[j], j)) for s in range(max(1, len(counts) - SPREAD + 1))}
            chosen |= {j for j, n in enumerate(counts) if n <= most}
            for j in sorted(chosen):
                out.setdefault(int(grams[j]), []).append((i, j))
        return out


def _passages(numbers: np.ndarray, items: Items, seeds: dict[int, list[tuple[int, int]]], flags: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(item index, score, first word, past the last word, seeds) of each item's best alignment that reaches `least`."""
    for run, found in items.short.items():
        fits = numbers[: max(0, len(numbers) - len(run) + 1)] == run[0]
        for k, word in enumerate(run[1:], 1):
            fits &= numbers[k : k + len(fits)] == word
        if fits.any():
            first = int(fits.argmax())
            for i in found:
                yield i, MATCH * len(run), first, first + len(run), 1
    at, grams = items.hits(numbers)
    hit = flags[grams] if len(grams) else np.zeros(0, bool)
    diagonals: dict[int, list[tuple[int, int]]] = {}
    for p, g in zip(at[hit].tolist(), grams[hit].tolist(), strict=True):
        for i, j in seeds[g]:
            diagonals.setdefault(i, []).append((p - j, p))
    for i, found in diagonals.items():
        item = items.words[i]
        found.sort()
        slack = max(4, len(item) // 4)
        best = None
        a = 0
        while a < len(found):
            b = a + 1
            while b < len(found) and found[b][0] - found[b - 1][0] <= slack:
                b += 1
            low, high = max(0, found[a][0] - slack), found[b - 1][0] + len(item) + slack
            window = numbers[low:high]
            # No alignment scores more than the words that the two share.
            size = len(items.vocabulary)
            shared = np.minimum(np.bincount(item, minlength=size)[item], np.bincount(window[window >= 0], minlength=size)[item]) / np.bincount(item, minlength=size)[item]
            if MATCH * shared.sum() >= least * MATCH * len(item):
                score, end = smith_waterman(item, window)
                if score >= least * MATCH * len(item) and (best is None or score > best[0]):
                    back, start = smith_waterman(item[::-1], window[:end][::-1])
                    best = (score, low + end - start, low + end, b - a)
            a = b
        if best:
            yield i, *best


#: What is known of a passage, in the order of _passages().
PASSAGE = ["item_id", "score", "first_word", "end_word", "n_seeds"]


class _Block:
    """A block of items with its seeds, told to the workers."""

    def __init__(self, texts: DataFrame, items: list[tuple[int, bytes]], least: float):
        held, sc = Items(items), texts.sparkSession.sparkContext
        told = sc.broadcast(held)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = told.value
            n, docs = np.zeros(len(block.grams), np.int64), 0
            for batch in batches:
                docs += batch.num_rows
                for text in byte_values(batch.column(0)):
                    n[np.unique(block.hits(block.numbers(words(text)))[1])] += 1
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[n[some], docs])], ["gram", "n"])

        # A row for each of the block's n-grams at most, and one for the number of documents.
        df = {r["gram"]: r["n"] for r in texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()} if len(held.grams) else {}
        seeds = held.rare(df, df.get(-1, 0))
        flags = np.zeros(len(held.grams), bool)
        flags[list(seeds)] = True
        extra = sc.broadcast((seeds, flags))

        def passages(text: bytes | None) -> list[tuple[int, float, int, int, int]]:
            """PASSAGE of each item's best alignment."""
            block, (seeds, flags) = told.value, extra.value
            found = _passages(block.numbers(words(text)), block, seeds, flags, least)
            return [(block.ids[item], score / (MATCH * len(block.words[item])), first, end, n) for item, score, first, end, n in found]

        self.passages = passages


def _blocks(texts: DataFrame, items: DataFrame, item_col: str, item_text_col: str, least: float, block_words: int) -> Iterator[_Block]:
    tests = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    size = tests.agg(F.sum(F.size(F.split("text", r"\s+")) + 1)).first()[0] or 0
    blocks = ceil(size / block_words) or 1
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for block in range(blocks):
        got = tests.where(F.col("block") == block).orderBy("item", "text").collect()
        yield _Block(texts, [(r["item"], r["text"].encode("utf-8")) for r in got], least)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word, n_seeds: an item's best passage in a document.

    score is the alignment's share of what the item scores against itself, `least` or more; words
    are numbered from 0. Items are taken in blocks of about block_words words, so what a task
    holds is bounded; for a block one pass counts in how many documents each
    n-gram of its items stands, the next joins the rare ones and aligns. Within
    a document the seeds of an item are split where diagonals are further apart than
    a quarter of the item.

    An item of fewer than SEED words is found where its words stand in a row. Items without words and null texts match nothing; a repeated item is
    reported under each id, a repeated id with several texts at its best; a row with a null doc_id is
    reported with it; repeated documents each count. No items or no documents: no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(rows.select("text"), items, item_col, item_text_col, least, block_words):

        def align(batches: Iterator[pa.RecordBatch], passages=block.passages) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, *told) for i, text in enumerate(byte_values(batch.column(1))) for told in passages(text)]
                at, *columns = zip(*found, strict=True) if found else [()] * 6
                kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *PASSAGE])

        part = rows.mapInArrow(align, f"doc_id {kind}, item_id long, score double, first_word long, end_word long, n_seeds long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a passage that contaminated() would report, each row judged by its own text; no row moves.

    Ids play no part, so rows with null or repeated ids and repeated rows go or stay by their text. Null and empty texts stay. No items: all stay.
    """
    place = docs.columns.index(text_col)
    out = docs
    for block in _blocks(docs.select(F.col(text_col).cast("string")), items, item_col, item_text_col, least, block_words):

        def clean(batches: Iterator[pa.RecordBatch], passages=block.passages) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not passages(t) for t in byte_values(batch.column(place))], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
