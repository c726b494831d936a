"""Large sets: counters rule out what a sketch's bits can't, and never an alike pair; texts of unlike sets don't move."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from loamgraph.llm import jaccard


def values(sets):
    table = pa.table({"size": [len(h) for h in sets], **{c: x for c, x in zip(jaccard.SKETCH, np.stack([jaccard.sketch(h) for h in sets]).T)}, "counts": pa.array([jaccard.counts(h) for h in sets], pa.binary())})
    return jaccard.compared(table, [])


@pytest.mark.parametrize("n", [1500, 2047, 2048, 2300, 6000, 20000, 60000])
def test_alike_sets_are_near_by_their_counters_and_others_are_not(n):
    r = np.random.default_rng(n)
    pool = np.unique(r.integers(0, 1 << 63, 2 * n + 200).astype(np.uint64))
    r.shuffle(pool)
    a = np.sort(pool[:n])
    # The farthest alike sets: some of `a` exchanged for others, some left out, some put to it.
    d = n * (100 - jaccard.LEAST) // (100 + jaccard.LEAST)
    alike = [np.sort(np.r_[pool[: n - d], pool[n : n + d]]), np.sort(pool[: -(-n * jaccard.LEAST // 100)]), np.sort(pool[: n * 100 // jaccard.LEAST])]
    zero = lambda k: np.zeros(k, np.int64)
    assert jaccard.near(values([a, *alike]), zero(3), np.arange(1, 4)).all()
    if jaccard.LARGE <= n <= 20000:
        assert not jaccard.near(values([a, np.sort(pool[n : 2 * n])]), zero(1), np.ones(1, np.int64)).any()


def test_texts_of_unlike_large_sets_stay(spark, monkeypatch):
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    # Every text holds one passage of all, so all meet under its keys.
    text = lambda: " ".join([*r.choice(words, 3000), "the one passage that all of them hold"])
    texts = [text() for _ in range(40)]
    texts.append(" ".join([*texts[7].split()[:-60], *r.choice(words, 60)]))
    moved = []
    inner = jaccard._texts
    monkeypatch.setattr(jaccard, "_texts", lambda rows, base: (moved.append(rows.count()), inner(rows, base))[1])
    got = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: 7 if i == 40 else i for i in range(41)}
    assert sum(moved) <= 4


def test_packed_texts_come_back_and_are_smaller():
    texts = [b"", b"a", "ein Wört ".encode() * 500]
    held = [jaccard.packed(t) for t in texts]
    assert list(jaccard.unpacked(pa.array([b"before", *held], pa.binary()).slice(1))) == texts
    assert len(held[2]) < len(texts[2]) / 10
