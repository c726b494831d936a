"""Removal of long repeated substrings with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values

#: Matches are this long at least.
MATCH = 50
#: Each match-long window belongs to the least hash of its seeds, which two equal windows share.
SEED = 19
SEEDS = MATCH - SEED + 1
#: Bytes scanned at once; longer texts are scanned in segments that overlap by MATCH - 1.
SEGMENT = 2 << 20
#: Bytes of text in a group, and entries in a bucket, on average.
GROUP_BYTES = 6 << 20
BUCKET_SEEDS = 384 << 10
BUCKET_BYTES = 4 << 20
#: Suffixes of a new batch.
BATCH = 1 << 16
LOW48 = np.uint64((1 << 48) - 1)


def words8(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as an integer; past the end they're zeros."""
    return np.ndarray((len(data) + 1,), np.uint64, data + b"\0" * 8, 0, (1,))


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(by)
    h ^= h >> np.uint64(29)
    return h


def hashes(data: bytes, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on."""
    n = len(data) - size + 1
    w = words8(data)
    h = np.full(n, 0x9E3779B97F4A7C15 + 2 * seed, np.uint64)
    for at in [*range(0, size - 8, 8), size - 8]:
        h += w[at : at + n]
        h = _mix(h, 0xBF58476D1CE4E5B9)
    return _mix(h, 0x94D049BB133111EB)


def segments(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of about SEGMENT bytes: (data, text number, begin in data, offset in the text) of each part."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - MATCH + 1), SEGMENT):
            part = t[at : at + SEGMENT + MATCH - 1]
            if len(part) < MATCH:
                continue
            parts.append((i, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    begin = np.cumsum([0, *(len(p[2]) for p in parts)])
    return b"".join(p[2] for p in parts), np.array([p[0] for p in parts]), begin, np.array([p[1] for p in parts])


def runs(data: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows in one part with the same least seed: (seed hash, part, first window, windows)."""
    least = hashes(data, SEED)
    step = 1
    while step < SEEDS:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    n = len(least)
    fresh = np.ones(n, bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[begin[1:-1][begin[1:-1] < n]] = True
    # Windows that cross a part's end begin a run of their own, left out below.
    cross = begin[1:-1] - MATCH + 1
    fresh[cross[(cross >= 0) & (cross < n)]] = True
    first = np.flatnonzero(fresh)
    count = np.diff(np.r_[first, n])
    part = np.searchsorted(begin, first, side="right") - 1
    inside = first + count - 1 + MATCH <= begin[part + 1]
    first, count, part = first[inside], count[inside], part[inside]
    return _mix(least[first], 0xD6E8FEB86659FD93), part, first, count


def _pack(*arrays: np.ndarray, raw: bytes = b"") -> bytes:
    """Arrays and bytes as one compressed value."""
    body = b"".join(a.tobytes() for a in arrays)
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + body + raw)


def _unpack(data: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    body = zstandard.ZstdDecompressor().decompress(data)
    at = 8 * len(kinds)
    out = []
    for size, kind in zip(np.frombuffer(body, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out, body[at:]


def _six(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].copy()


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _by_key(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices) of each distinct key, indices ascending."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(key[at[0]]), at


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Every text's seeds by bucket, each seed once a batch; where a batch shows that a seed repeats, that's said."""
    for batch in batches:
        ids_all, groups_all = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = 0
        while at < batch.num_rows:
            texts, size, to = [], 0, at
            while to < batch.num_rows and (not texts or size < 4 * SEGMENT):
                texts.append(batch.column(2)[to].as_py().encode("utf-8"))
                size += len(texts[-1])
                to += 1
            ids, groups = ids_all[at:to], groups_all[at:to]
            at = to
            seeds, owner = [], []
            for data, number, begin, _ in segments(texts):
                h, part, _, _ = runs(data, begin)
                seeds.append(h)
                owner.append(number[part])
            if not seeds:
                continue
            h, own = np.concatenate(seeds), np.concatenate(owner)
            order = np.lexsort((ids[own], h))
            h, own = h[order], own[order]
            new = np.r_[True, h[1:] != h[:-1]]
            which = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            mixed = ids[own[starts]] < ids[own[np.r_[starts[1:], len(h)] - 1]]
            rows = []
            keep = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
            known = np.flatnonzero(mixed[which] & keep)
            if len(known):
                rows.append((int(h[known[0]] % np.uint64(buckets)), True, known))
            rows += [(b, False, starts[i]) for b, i in _by_key((h[starts] % np.uint64(buckets)).astype(np.int64))]
            data = []
            for _, _, i in rows:
                i = i[np.argsort(own[i], kind="stable")]
                docs, counts = np.unique(own[i], return_counts=True)
                data.append(_pack(ids[docs], groups[docs].astype(np.int32), counts.astype(np.int32), _six(h[i] >> np.uint64(16))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array(data, pa.binary())], ["bucket", "known", "data"])


def _answered(table: pa.Table) -> pa.Table:
    """A bucket's seeds that two texts hold, by the texts' groups."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for known, data in zip(table.column("known").to_pylist(), table.column("data"), strict=True):
        (ids, groups, counts, raw), _ = _unpack(data.as_py(), "i8", "i4", "i4", "u1")
        (out if known else asked).append((np.repeat(ids, counts), np.repeat(groups, counts), _from_six(raw)))
    if asked:
        ids, groups, h = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.argsort(h)
        s = h[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        low, high = np.minimum.reduceat(ids[order], starts), np.maximum.reduceat(ids[order], starts)
        hit = order[np.repeat(low < high, np.diff(np.r_[starts, len(s)]))]
        out.append((ids[hit], groups[hit], h[hit]))
    ids, groups, h = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "u8"))
    rows = []
    for g, at in _by_key(groups):
        docs, of, counts = np.unique(ids[at], return_inverse=True, return_counts=True)
        rows.append((g, _pack(docs, counts.astype(np.int32), _six(h[at[np.argsort(of, kind="stable")]]))))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["grp", "data"])


def _ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """A group's rows by doc_id, then text: the same order each time, for rows are known by their place in it."""
    ids, texts = table.column("doc_id").to_pylist(), byte_values(table.column("text").combine_chunks())
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]


def _strings(texts: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The stretches of a group's texts whose seeds repeat, by bucket; equal ones once, with all their places."""
    names = ["bucket", "data"]
    none = pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=names)
    if not texts.num_rows or not answers.num_rows:
        return none
    grp = answers.column("grp")[0].as_py()
    ids, whole = _ordered(texts)
    flags = []
    for data in answers.column("data"):
        (docs, counts, raw), _ = _unpack(data.as_py(), "i8", "i4", "u1")
        flags.append(np.repeat(np.searchsorted(ids, docs), counts).astype(np.uint64) << np.uint64(48) | _from_six(raw))
    # Rows that share a doc_id are flagged alike, at the first one's number.
    flagged = np.unique(np.concatenate(flags))
    first_of = np.searchsorted(ids, ids).astype(np.uint64)
    rows = []
    for data, number, begin, offset in segments(whole):
        h, part, first, count = runs(data, begin)
        key = first_of[number[part]] << np.uint64(48) | h >> np.uint64(16)
        at = np.searchsorted(flagged, key)
        hit = flagged[np.minimum(at, len(flagged) - 1)] == key
        h, part, first, count = h[hit], part[hit], first[hit], count[hit]
        if not len(h):
            continue
        size = count + MATCH - 1
        window = hashes(data, MATCH)
        head, tail = window[first], window[first + count - 1]
        # A stretch of up to two windows' bytes is told by its first and last window.
        tag = np.where(size <= 2 * MATCH, _mix(head ^ (tail * np.uint64(0x9E3779B97F4A7C15)), 0xBF58476D1CE4E5B9), np.arange(len(h), dtype=np.uint64))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        buf = np.frombuffer(data, np.uint8)
        doc = ids[number[part]]
        start = offset[part] + first - begin[part]
        for b, i in _by_key(bucket):
            i = i[np.lexsort((doc[i], size[i], tag[i]))]
            new = np.r_[True, (tag[i][1:] != tag[i][:-1]) | (size[i][1:] != size[i][:-1])]
            one = i[new]
            sizes = size[one]
            at = np.repeat(first[one] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            places = np.diff(np.r_[np.flatnonzero(new), len(i)])
            rows.append((b, _pack(sizes.astype(np.int32), places.astype(np.int32), doc[i], number[part[i]].astype(np.int32), start[i], np.array([grp]), raw=buf[at].tobytes())))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=names) if rows else none


class Family:
    """Suffix arrays of geometrically growing sizes over one buffer.

    An array holds suffixes in alphabetical order of their first MATCH bytes, each such prefix once in the whole family, with the least
    document that has it. A new batch gets a suffix array, which is merge-scanned against every level for matches of MATCH
    bytes; what no level has becomes the smallest level, and two levels of one rank merge into one of the next.
    """

    def __init__(self, data: bytes):
        self.words = words8(data)
        raw = np.frombuffer(data, np.uint8)
        self.grid = np.lib.stride_tricks.as_strided(raw, (max(0, len(raw) - MATCH + 1), MATCH), (1, 1), writeable=False)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []

    def same(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the prefixes at a and b are equal byte for byte."""
        return all(np.array_equal(self.words[a + o], self.words[b + o]) for o in [*range(0, MATCH - 8, 8), MATCH - 8])

    def suffix_array(self, h: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prefixes in order, their least documents, each input's place among them). Equal prefixes meet by their hashes first, so only distinct ones are sorted."""
        order = np.lexsort((doc, h))
        s = h[order]
        new = np.r_[True, s[1:] != s[:-1]]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        if not self.same(at, at[first][which]):
            raise Collision
        prefixes = self.grid[at[first]].view(f"S{MATCH}").ravel()
        sorted_ = np.argsort(prefixes)
        place = np.empty(len(first), np.int64)
        place[sorted_] = np.arange(len(first))
        return prefixes[sorted_], doc[first][sorted_], place[which]

    def add(self, h: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Each suffix's least document so far, itself included; then the batch is part of the family."""
        keys, least, place = self.suffix_array(h, at, doc)
        fresh = np.ones(len(keys), bool)
        for _, level, docs in self.levels:
            left = np.flatnonzero(fresh)
            i = np.minimum(np.searchsorted(level, keys[left]), len(level) - 1)
            hit = level[i] == keys[left]
            left, i = left[hit], i[hit]
            docs[i] = least[left] = np.minimum(least[left], docs[i])
            fresh[left] = False
        if fresh.any():
            rank, keys_, docs = 0, keys[fresh], least[fresh]
            while self.levels and self.levels[-1][0] == rank:
                _, level, old = self.levels.pop()
                to = np.searchsorted(level, keys_) + np.arange(len(keys_))
                merged, both = np.empty(len(level) + len(keys_), level.dtype), np.empty(len(level) + len(keys_), np.int64)
                rest = np.ones(len(merged), bool)
                rest[to] = False
                merged[to], merged[rest], both[to], both[rest] = keys_, level, docs, old
                rank, keys_, docs = rank + 1, merged, both
            self.levels.append((rank, keys_, docs))
        return least[place]


class Collision(Exception):
    """Two prefixes share a hash; another seed tells them apart."""


def _matched(table: pa.Table) -> pa.Table:
    """A bucket's removed spans by group: windows that also begin in a smaller document."""
    sizes, places, docs, rows, starts, groups, raw = [], [], [], [], [], [], []
    for data in table.column("data"):
        (s, p, d, r, t, g), body = _unpack(data.as_py(), "i4", "i4", "i8", "i4", "i8", "i8")
        sizes.append(s.astype(np.int64))
        places.append(p.astype(np.int64))
        docs.append(d)
        rows.append(r)
        starts.append(t)
        groups.append(np.full(len(d), g[0]))
        raw.append(body)
    size, place, doc, row, start, group = map(np.concatenate, (sizes, places, docs, rows, starts, groups))
    data = b"".join(raw)
    of = np.repeat(np.arange(len(size)), place)
    first_place = np.cumsum(place) - place
    # Places of a string are in the order of documents.
    least_doc = doc[first_place]
    begin = np.cumsum(size) - size
    windows = size - MATCH + 1
    order = np.argsort(least_doc, kind="stable")
    for seed in range(64):
        try:
            found = _least(data, begin, windows, least_doc, order, seed)
            break
        except Collision:
            continue
    else:
        raise RuntimeError("equal hashes of unequal strings under 64 seeds")
    # Places in larger documents than the string's first lose the whole string.
    later = doc > least_doc[of]
    spans = [(group[later], row[later], start[later], start[later] + size[of[later]])]
    # In the first document, windows that a smaller document has.
    base = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(size)), windows)
    gone = found < least_doc[owner]
    edge = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | (owner[1:] != owner[:-1])])
    stop = np.flatnonzero(gone & np.r_[~gone[1:] | (owner[1:] != owner[:-1]), True])
    if len(edge):
        string = owner[edge]
        low, high = edge - base[string], stop - base[string] + MATCH
        own = np.flatnonzero(~later)
        # A string's places in its first document come first.
        count = np.bincount(of[own], minlength=len(size))[string]
        which = np.repeat(np.arange(len(edge)), count)
        place_at = first_place[string[which]] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        spans.append((group[place_at], row[place_at], start[place_at] + low[which], start[place_at] + high[which]))
    group, row, low, high = (np.concatenate(x) for x in zip(*spans, strict=True))
    out = [(g, _pack(row[i].astype(np.int32), low[i].astype(np.int64), high[i].astype(np.int64))) for g, i in _by_key(group)]
    return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["grp", "data"])


def _least(data: bytes, begin: np.ndarray, windows: np.ndarray, least_doc: np.ndarray, order: np.ndarray, seed: int) -> np.ndarray:
    """For each window of each string the least document with it. Batches come in the order of documents."""
    family = Family(data)
    h = hashes(data, MATCH, seed)
    base = np.cumsum(windows) - windows
    found = np.empty(int(windows.sum()), np.int64)
    load = np.cumsum(windows[order])
    cuts = np.searchsorted(load, np.arange(BATCH, load[-1] + BATCH, BATCH), side="left") + 1
    a = 0
    for b in np.unique(np.minimum(cuts, len(order))):
        part = order[a:b]
        a = b
        if not len(part):
            continue
        n = windows[part]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin[part], n) + within
        found[np.repeat(base[part], n) + within] = family.add(h[at], at, np.repeat(least_doc[part], n))
    return found


def _kept(texts: pa.Table, spans: pa.Table, kind: pa.DataType) -> pa.Table:
    """A group's documents without their spans."""
    ids, whole = _ordered(texts) if texts.num_rows else (np.zeros(0, np.int64), [])
    cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for data in spans.column("data"):
        (row, low, high), _ = _unpack(data.as_py(), "i4", "i8", "i8")
        cuts.append((row, low, high))
    row, low, high = (np.concatenate(x) for x in zip(*cuts, strict=True)) if cuts else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    bounds = np.searchsorted(row, np.arange(len(ids) + 1))
    out = []
    for i, text in enumerate(whole):
        a, b = bounds[i], bounds[i + 1]
        kept, at, removed, n = [], 0, 0, 0
        if a < b:
            reach = np.maximum.accumulate(high[a:b])
            new = np.flatnonzero(np.r_[True, low[a + 1 : b] > reach[:-1]])
            for s, e in zip(low[a:b][new].tolist(), reach[np.r_[new[1:], b - a] - 1].tolist(), strict=True):
                kept.append(text[at:s])
                at, removed, n = e, removed + e - s, n + 1
        kept.append(text[at:])
        rest = b"".join(kept)
        out.append((len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(ids).cast(kind), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A byte goes if a MATCH-long string over it also begins in a document with a smaller
    doc_id. Windows are dealt to buckets by their least seed hash, so equal
    windows meet. First only seeds move, each once a batch of texts; then the stretches of text
    whose seed two documents share, equal ones of a group once; each bucket keeps a
    Family of suffix arrays over them, to which they come in batches in the order of documents. Spans return to their texts. Nothing
    is as large as a group of copies: a bucket gets a repeated string once from each group of texts.

    Null texts are empty. Rows with a null id neither remove nor lose anything. Rows
    that share a doc_id don't match each other, and match smaller ids each
    alone. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    groups = ceil(total / GROUP_BYTES)
    buckets = ceil(total * 0.063 / BUCKET_SEEDS)
    stretches = ceil(total / BUCKET_BYTES)
    known = rows.where(F.col("doc_id").isNotNull()).withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).select("doc_id", "grp", "text")
    asked = known.where(F.octet_length("text") >= MATCH).mapInArrow(lambda b: _asked(b, buckets), "bucket int, known boolean, data binary")
    answers = asked.groupBy("bucket").applyInArrow(_answered, "grp int, data binary")
    strings = known.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(lambda t, a: _strings(t, a, stretches), "bucket int, data binary")
    spans = strings.groupBy("bucket").applyInArrow(_matched, "grp int, data binary")
    kept = known.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(lambda t, s: _kept(t, s, pa.int64()), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    idle = rows.where(F.col("doc_id").isNull()).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "utf-8").alias("kept"))
    return kept.unionByName(idle)
