"""Ids of a byte-level BPE tokenizer with word ends, for many texts at once."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from os.path import commonprefix
from struct import pack

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .tokencount import byte_alphabet

#: Pieces remembered by each Python worker.
PIECES_KEPT = 300_000
#: Longer ones aren't.
LONGEST = 64
#: Characters from which on a chunk goes through the whole library.
PLAIN = 0x130
#: What a byte belongs to: white space that ends a chunk, a letter, a number, any other sign, or an odd one.
WHITE, LETTER, NUMBER, SIGN, ODD = range(5)


class WordBpe:
    """encode(texts) for the tokenizer file's whole pipeline.

    The file's splitting pattern never matches white space, so a text's ids are its chunks' ids joined, and those of a chunk its pieces':
    runs of letters, single numbers, runs of other signs. A batch of texts is cut into pieces by its bytes, all at once, equal pieces are
    told together, and ids are gathered. Chunks with an apostrophe, a special token's beginning, controls or characters from PLAIN on are
    not cut: the library encodes them. Unseen pieces go to the library's model.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # What all special tokens begin with; empty if there are none.
        self.mark = commonprefix([t["content"] for t in spec["added_tokens"]]).encode("utf-8")
        self.kind, self.low = np.full(256, ODD, np.int8), np.arange(256, dtype=np.uint8)
        self.kind2, self.low2 = np.full(192, ODD, np.int8), np.arange(192, dtype=np.uint8) & 63 | 128
        for c in range(PLAIN):
            sort = unicodedata.category(chr(c))[0]
            kind = WHITE if chr(c) in " \t\n\r" else ODD if sort in "CZ" or chr(c) == "'" else LETTER if sort == "L" else NUMBER if sort == "N" else SIGN
            if c < 128:
                self.kind[c], self.low[c] = kind, ord(chr(c).lower())
            else:
                self.kind2[c - 128], self.low2[c - 128] = kind, chr(c).lower().encode("utf-8")[1]
        signs = {b: c for c, b in byte_alphabet().items()}
        self.signs = [signs[b] for b in range(256)]
        self.pieces: dict[bytes, bytes] = {}

    def _learn(self, values: list[bytes], odd: list[bool]) -> list[bytes]:
        """Ids of values not seen so far."""
        out, merge, signs = [], self.library.model.tokenize, self.signs
        for v, o in zip(values, odd, strict=True):
            if o:
                ids = self.library.encode(v.decode("utf-8"), add_special_tokens=False).ids
            else:
                ids = [t.id for t in merge(v.decode("latin-1").translate(signs))]
            out.append(pack(f"<{len(ids)}I", *ids))
        if len(self.pieces) + len(values) > PIECES_KEPT:
            self.pieces = {}
        self.pieces.update((v, ids) for v, ids in zip(values, out, strict=True) if len(v) <= LONGEST)
        return out

    def _split(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places at which pieces begin, which of them are whole odd chunks, the bytes of all pieces, where each begins in those)."""
        kind, low = self.kind[raw], self.low[raw]
        lead = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC4))
        if len(lead):
            code = (raw[lead].astype(np.int64) - 0xC2) * 64 + (raw[lead + 1] & 63)
            kind[lead] = kind[lead + 1] = self.kind2[code]
            low[lead + 1] = self.low2[code]
        strange = kind == ODD
        if self.mark:
            n = len(raw) - len(self.mark) + 1
            begins = np.logical_and.reduce([raw[k : n + k] == b for k, b in enumerate(self.mark)]) if n > 0 else np.zeros(0, bool)
            strange[np.flatnonzero(begins)] = True
        if strange.any():
            white = kind == WHITE
            chunk = np.cumsum(white)
            whole = np.isin(chunk, chunk[strange]) & ~white
            kind[whole] = ODD
            low[whole] = raw[whole]
        inside = kind != WHITE
        begin = inside.copy()
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) & (raw[1:] & 0xC0 != 0x80)
        at = np.flatnonzero(begin)
        return at, kind[at] == ODD, low[inside], np.flatnonzero(begin[inside])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        blobs = [t.encode("utf-8") for t in texts]
        raw = np.frombuffer(b" ".join(blobs), np.uint8)
        at, odd, data, place = self._split(raw)
        if not len(at):
            return [b""] * len(texts)
        offsets = np.append(place, len(data)).astype(np.int32)
        each = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes = each.indices.to_numpy()
        _, begins, blob = each.dictionary.buffers()
        begins, blob = np.frombuffer(begins, np.int32)[: len(each.dictionary) + 1].tolist(), blob.to_pybytes()
        values = [blob[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
        own = list(map(self.pieces.get, values))
        new = [i for i, ids in enumerate(own) if ids is None]
        if new:
            strange = np.zeros(len(values), bool)
            strange[codes[odd]] = True
            for i, ids in zip(new, self._learn([values[i] for i in new], strange[new].tolist()), strict=True):
                own[i] = ids
        # The ids of every piece, one after the other.
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), "<u4")
        ends = np.append(0, np.cumsum(size[codes]))
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], size[codes]) + np.arange(ends[-1])]
        bounds = np.cumsum([0] + [len(b) + 1 for b in blobs])
        bounds = ends[np.searchsorted(at, bounds)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One encoder for each file in a Python worker: what a task has learnt serves the next."""
    return WordBpe(path)
