"""The Jaccard join against a comparison of all pairs, and its parts alone."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loamgraph.llm import jaccard
from loamgraph.llm.jaccard import combination_keys, jaccard_join, least_size, near, shingles, sketch, span_across

SCHEMA = "doc_id long, text string, n_shingles string, key int"


def set_of(text, width=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = least.setdefault(root(i), [])
        if doc is not None:
            ids.append(doc)
    return sorted(((doc, len(s), min(least[root(i)], default=None)) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


def joined(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in jaccard_join(frame).collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [f"w{rng.random()}"] * rng.choice([0, 1])
    return words


def texts(seed, groups=25):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    out = []
    for g in range(groups):
        n = rng.choice([1, 2, 3, 8, 11, 12, 13, 21, 22, 40, 64, 70, 130, 300, 1100])
        base = [rng.choice(common) if rng.random() < 0.4 else f"u{g}_{rng.randrange(500)}" for _ in range(n)]
        for _ in range(rng.choice([1, 2, 5, 9])):
            out.append(" ".join(edited(rng, base, rng.choice([0, 1, 1, 2, max(1, n // 60), n // 30]))))
    return out


@pytest.mark.parametrize("tile", [3, 1024])
def test_join_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "PART", 600 if tile == 3 else 1 << 20)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 20)
    bodies = texts(tile)
    rows = list(enumerate(bodies, 10))
    rows += [(None, bodies[0]), (None, bodies[4].upper()), (7, bodies[5]), (7, bodies[5]), (7, None), (8, ""), (9, " \t\n"), (9, None), (400, "Ä b c"), (401, "ä b c"), (402, "one"), (403, "ONE"), (404, "one two"), (405, "two  one")]
    # A dense group of near copies with rare edits, and many texts that hold one passage.
    rng = random.Random(9)
    base = [f"g{i}" for i in range(150)]
    rows += [(1000 + i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4])))) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, f"{passage} " + " ".join(f"q{i}_{j}" for j in range(rng.choice([3, 6, 40])))) for i in range(30)]
    assert joined(spark, rows) == brute(rows)


def test_empty_table_and_one_very_long_text(spark):
    assert joined(spark, []) == []
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " more words here"), (3, "word1 word2 word3")]
    assert joined(spark, rows) == [(1, 199_998, 1), (2, 200_001, 1), (3, 1, 3)]


def test_alike_sets_share_a_key_whatever_the_frequencies():
    rng = np.random.default_rng(3)
    for n in (9, 10, 11, 19, 20, 31, 33, 63, 65, 127, 130, 500, 1023, 1030, 2047, 2100):
        for kinds in ([0], [1], [2], [0, 1, 2], [1, 2], [0, 2]):
            for _ in range(12):
                # As few in common as the threshold allows, in either size.
                lost = rng.integers(0, n // 10 + 1)
                shared = rng.integers(0, 1 << 63, n - lost).astype(np.uint64)
                most = int(len(shared) / 0.9)
                extra = min(max(0, most - n), 400)
                a = np.unique(np.r_[shared, rng.integers(0, 1 << 63, lost).astype(np.uint64)])
                b = np.unique(np.r_[shared, rng.integers(0, 1 << 63, extra).astype(np.uint64)])
                assert 100 * len(shared) >= 90 * (len(a) + len(b) - len(shared))
                frequency = lambda h: np.array(kinds)[(h % np.uint64(len(kinds))).astype(int)]  # noqa: B023, E731
                keys = [combination_keys(h, frequency(h)) for h in (a, b)]
                if min(len(a), len(b)) >= least_size(90) and not np.array_equal(a, b):
                    assert len(np.intersect1d(*keys))
                values = {"size": np.array([len(a), len(b)])} | dict(zip(jaccard.SKETCH, np.stack([sketch(a), sketch(b)]).T))
                assert near(values, np.array([0]), np.array([1]))[0]


def test_word_hashes_tell_words_apart_and_nothing_else(monkeypatch):
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abAB\xc3\xa9!") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + [b"x" * 300, b"y" * 90]
    text = b"".join(w + rng.choice([b" ", b"\n ", b"\t\x0b", b"\r\x0c"]) for w in words)
    want = {}
    for run in (1 << 18, 64):
        monkeypatch.setattr(jaccard, "RUN", run)
        for t in (text, b" " + text.strip(), text.upper().lower()):
            got = jaccard.word_hashes(t).tolist()
            assert len(got) == len(words) and all(want.setdefault(w.lower(), h) == h for w, h in zip(words, got))
    assert len(set(want.values())) == len(want)
    assert len(jaccard.word_hashes(b"")) == len(jaccard.word_hashes(b" \n")) == 0


def test_combinations_are_fewer_than_all_pairs():
    rng = np.random.default_rng(5)
    for n in (100, 1000, 5000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for kind in (0, 1, 2):
            assert len(combination_keys(h, np.full(len(h), kind))) < 1.7 * n


def test_smallest_set_that_can_be_alike():
    assert least_size(90) == 9 and least_size(80) == 4


def test_edges_across_classes_span_what_all_pairs_join():
    rng = random.Random(4)
    bodies = texts(11, 12)
    sets = [shingles(t.encode()) for t in bodies if t]
    for _ in range(5):
        comp = np.array([rng.randrange(6) for _ in sets])
        asks = comp != 0
        groups = {c: {c} for c in range(6)}

        def merge(pairs):
            out = {c: {c} for c in range(6)}  # noqa: B023
            for i, j in pairs:
                both = out[comp[i]] | out[comp[j]]  # noqa: B023
                for c in both:
                    out[c] = both
            return out

        alike = lambda i, j: 10 * (s := len(np.intersect1d(sets[i], sets[j]))) >= 9 * (len(sets[i]) + len(sets[j]) - s)
        every = [(i, j) for i in range(len(sets)) for j in range(i) if comp[i] != comp[j] and alike(i, j)]
        found = span_across(sets, comp, asks)
        assert all(alike(i, j) for i, j in found)
        assert merge(found) == merge(every) and groups
