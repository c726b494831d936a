"""Word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values

#: The symbol after a word's last byte.
END = 256
#: Words kept with their counts in each Python worker.
WORDS_KEPT = 500_000


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_pieces(path: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a byte-level tokenizer file as symbol tuples; the suffix becomes END."""
    of = byte_alphabet()
    out = []
    with open(path, encoding="utf-8") as f:
        for piece in json.load(f)["model"]["vocab"]:
            ends = piece.endswith(suffix) and len(piece) > len(suffix)
            body = piece[: -len(suffix)] if ends else piece
            if all(c in of for c in body):
                out.append((*(of[c] for c in body), *([END] if ends else [])))
    return out


class LongestMatch:
    """Counts the pieces of greedy longest-match-first splitting in time linear in the word.

    A trie over the pieces; node v that can't go on fails to `fail[v]` after
    `pops[v]` pieces, both computed once, breadth first: a node that is a
    piece pops itself and fails to the root, any other follows its parent's failure
    chain. Words that no split covers count as `unknown` pieces.
    """

    def __init__(self, pieces: Iterable[tuple[int, ...]], unknown: int = 1):
        self.unknown = unknown
        self.go: dict[int, int] = {}
        is_piece = [False]
        depth_first: list[tuple[int, int, int]] = []
        for piece in pieces:
            node = 0
            for c in piece:
                key = node * 512 + c
                to = self.go.get(key)
                if to is None:
                    to = self.go[key] = len(is_piece)
                    is_piece.append(False)
                    depth_first.append((node, c, to))
                node = to
            is_piece[node] = node != 0
        n = len(is_piece)
        depth = [0] * n
        for parent, _, node in depth_first:
            depth[node] = depth[parent] + 1
        self.fail, self.pops = [-1] * n, [0] * n
        for parent, c, node in sorted(depth_first, key=lambda x: depth[x[2]]):
            if is_piece[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            count, z = self.pops[parent], self.fail[parent]
            while z >= 0 and z * 512 + c not in self.go:
                count += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[node], self.pops[node] = self.go[z * 512 + c], count
        self.moves: dict[int, tuple[int, int]] = {}

    def step(self, node: int, c: int) -> tuple[int, int]:
        """The node after symbol c and the pieces popped on the way; node -1 if none fits."""
        count, at = 0, node
        while (to := self.go.get(at * 512 + c)) is None:
            count += self.pops[at]
            at = self.fail[at]
            if at < 0:
                break
        found = self.moves[node * 512 + c] = (-1 if to is None else to, count)
        return found

    def count(self, word: bytes) -> int:
        node, total, moves = 0, 0, self.moves
        for c in (*word, END):
            node, popped = moves.get(node * 512 + c) or self.step(node, c)
            if node < 0:
                return self.unknown
            total += popped
        while node:
            total += self.pops[node]
            node = self.fail[node]
            if node < 0:
                return self.unknown
        return total


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens, longest_word_tokens.

    Words are the whole text's runs of bytes other than ASCII white space, with A-Z lowered; each
    is split greedily into the vocabulary's longest pieces, its end being a
    symbol of its own. Null and empty texts count 0; null ids and repeated
    rows keep their rows; other columns are ignored. The automaton is built once on the driver
    (its size is the vocabulary's) and broadcast.
    """
    kept = docs.sparkSession.sparkContext.broadcast(LongestMatch(read_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(kept.value)
        of = counts.__getitem__
        for batch in batches:
            words, tokens, most = [], [], []
            for text in byte_values(batch.column(1)):
                each = list(map(of, text.lower().split())) if text else []
                words.append(len(each))
                tokens.append(sum(each))
                most.append(max(each, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, most))], ["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, longest_word_tokens long")
