"""Similarity joins and approximate searches against exact scores of all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgraph.operators import graphindex, quantise, simjoin, vector

SCHEMA = "vec_id long, embedding array<double>, x string, cell int, ring int"


def clustered(n, dims, groups, spread, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    return centres[r.integers(0, groups, n)] + spread * r.normal(size=(n, dims))


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v], "x", 1, 2) for i, v in zip(ids, x)], SCHEMA)


def cosines(x):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return u @ u.T


@pytest.mark.parametrize(("spread", "least", "cell", "block"), [(0.15, 0.88, 20, 7), (0.3, 0.88, 40, 1000), (1.0, 0.5, 30, 16), (0.02, 0.999, 25, 9), (0.3, 0.1, 50, 20), (0.3, 0.88, 10_000, 30)])
def test_pivot_join_equals_all_pairs(spark, spread, least, cell, block):
    x = clustered(260, 12, 9, spread, 3)
    x[7] = 0
    x[20] = x[21] = x[22] * 3
    ids = list(range(260))
    ids[30] = 31
    s = cosines(x)
    keep = np.linalg.norm(x, axis=1) > 0
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j]), round(float(s[i, j]), 4)) for i in range(260) for j in range(i) if keep[i] and keep[j] and ids[i] != ids[j] and s[i, j] >= least)
    got = sorted(tuple(r) for r in simjoin.similar_pairs(frame(spark, [*x, None], [*ids, 900]), least, cell=cell, block=block).collect())
    assert [p[:2] for p in got] == [p[:2] for p in want] and np.allclose([p[2] for p in got], [p[2] for p in want], atol=1.1e-4)


@pytest.mark.parametrize("cell", [25, 10_000])
def test_nearest_pairs_keep_k_and_break_ties_by_id(spark, cell):
    x = clustered(200, 8, 6, 0.25, 5)
    x[50:60] = x[50]
    s = np.round(cosines(x), 9)
    want = set()
    for i in range(200):
        near = sorted((j for j in range(200) if j != i and s[i, j] >= 0.85), key=lambda j: (-s[i, j], j))[:5]
        want |= {(min(i, j), max(i, j)) for j in near}
    got = [(r.a, r.b) for r in simjoin.neighbor_pairs(frame(spark, x), cell=cell, block=13).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pivots_skip_most_pairs_of_clustered_vectors(spark):
    x = clustered(3000, 16, 40, 0.1, 8)
    rows = frame(spark, x)
    met = simjoin.PivotJoin(rows, 0.88, cell=75).compared()
    assert met < 0.15 * 3000 * 2999 / 2
    # Without clusters all pairs may meet, but each once.
    flat = simjoin.PivotJoin(frame(spark, np.random.default_rng(1).normal(size=(400, 32))), 0.5, cell=40)
    assert flat.compared() <= 400 * 399 // 2
    with pytest.raises(ValueError, match="above 0"):
        simjoin.PivotJoin(rows, 0.0)


def test_rows_of_a_pivot_join_move_once_a_block(spark):
    rows = frame(spark, np.random.default_rng(3).normal(size=(6000, 8)))
    join = simjoin.PivotJoin(rows, 0.5)
    # Four copies of each row at home, and one a block that it visits: at most all blocks of earlier cells and of its own.
    assert join.tiles().count() <= 10 * 6000


def test_blocks_without_rows_and_rows_that_only_visit(spark):
    x = clustered(30, 6, 3, 0.5, 4)
    s = cosines(x)
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if s[i, j] >= 0.3}
    assert {(r.a, r.b) for r in simjoin.similar_pairs(frame(spark, x), 0.3, cell=4, block=1).collect()} == want


def test_pivot_join_of_few_rows(spark):
    assert simjoin.similar_pairs(frame(spark, [])).collect() == []
    assert simjoin.similar_pairs(frame(spark, [[1.0, 0.0], None, [0.0, 0.0]])).collect() == []
    assert [tuple(r) for r in simjoin.similar_pairs(frame(spark, [[1.0, 0.0], [2.0, 0.0]])).collect()] == [(0, 1, 1.0)]


def recall_of(spark, rows, queries, found, k=10):
    exact = {(r.query_id, r.id) for r in vector.top_k(rows, queries, k).collect()}
    return len(exact & {(r.query_id, r.id) for r in found}) / len(exact)


def questions(rows):
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def test_graph_finds_neighbours_with_fewer_scores_than_a_flat_search(spark):
    x = np.random.default_rng(2).normal(size=(3000, 24))
    x[100] = 0
    rows = frame(spark, [*x, None])
    q = questions(rows)
    width = graphindex.width_for(rows, q, shard=1000)
    found = graphindex.graph_search(rows, q, width=width, shard=1000).collect()
    assert recall_of(spark, rows, q, found) >= 0.95
    assert len(found) == 10 * 150 and {r["rank"] for r in found} == set(range(1, 11))
    assert np.mean([r.scored for r in found]) < 0.7 * 3000
    exact = {(r.query_id, r.id): r.score for r in vector.top_k(rows, q, 30).collect()}
    assert all(abs(exact[r.query_id, r.id] - r.score) < 1e-5 for r in found if (r.query_id, r.id) in exact)


def test_graph_saves_more_the_larger_a_shard_is():
    x = np.random.default_rng(4).normal(size=(6000, 16))
    shares = []
    for n in (1500, 6000):
        graph = graphindex.LayeredGraph(pa.array(range(n)), x[:n])
        places, score, scored = graph.search(x[:n:20], 10, 64)
        exact = np.argsort(-cosines(x[:n])[::20], axis=1, kind="stable")[:, :10]
        assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(places.tolist(), exact.tolist())]) >= 0.95
        assert (np.diff(score, axis=1) <= 0).all()
        shares.append(scored.mean() / n)
    assert shares[1] < shares[0] / 1.8 and shares[1] < 0.25


def test_graph_of_few_rows_and_of_copies(spark):
    rows = frame(spark, [[1.0, 0.0]])
    ask = lambda r, k: [(x["rank"], x.id) for x in graphindex.graph_search(r, r.limit(1).select(F.col("vec_id").alias("query_id"), "embedding"), k).orderBy("rank").collect()]
    assert ask(rows, 3) == [(1, 0)]
    assert ask(frame(spark, [[1.0, 0.0]] * 200), 5) != [] and graphindex.graph_search(frame(spark, []), questions(rows)).collect() == []


def test_codes_are_small_and_rescoring_restores_the_recall(spark):
    x = clustered(2500, 32, 60, 0.6, 6)
    rows = frame(spark, [*x, None])
    q = questions(rows)
    index = quantise.QuantisedIndex(rows, parts=8)
    assert index.bytes_a_vector() == 12 < 32 * 4 / 10
    plain = index.top_k(rows, q, probes=20, rescored=False).collect()
    better = index.top_k(rows, q, probes=20).collect()
    assert recall_of(spark, rows, q, better) >= 0.95 and recall_of(spark, rows, q, better) > recall_of(spark, rows, q, plain) + 0.05
    exact = {(r.query_id, r.id): r.score for r in vector.top_k(rows, q, 10).collect()}
    assert all(exact[r.query_id, r.id] == pytest.approx(r.score, abs=2e-9) for r in better if (r.query_id, r.id) in exact)
    few = index.probes_for(rows, q)
    assert few < len(index.books.cells)
    assert recall_of(spark, rows, q, index.top_k(rows, q).collect()) >= 0.93


def test_tables_give_the_product_with_the_decoded_vector():
    x = clustered(600, 10, 5, 0.5, 7)
    books = quantise.Codebooks(x, 4, 3)
    cell, codes = books.encode(x)
    decoded = books.decode(cell, codes)
    q = quantise.unit(x[:7])
    for c in range(4):
        own = np.flatnonzero(cell == c)
        assert np.allclose(books.scores(q, c, codes[own]), q @ decoded[own].T)
    error = lambda parts: (lambda b: ((b.decode(*b.encode(x)) - quantise.unit(x)) ** 2).sum())(quantise.Codebooks(x, 4, parts))
    assert error(10) < error(3) < error(1)
    with pytest.raises(ValueError, match="part"):
        quantise.Codebooks(x, 4, 11)


def test_quantised_search_of_few_rows(spark):
    rows = frame(spark, [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])
    q = rows.limit(1).select(F.col("vec_id").alias("query_id"), "embedding")
    assert [(r.id, r.score) for r in quantise.QuantisedIndex(rows, parts=2).top_k(rows, q, 3, probes=3).orderBy("rank").collect()] == [(0, 1.0), (1, 0.0), (2, 0.0)]
    assert quantise.QuantisedIndex(frame(spark, [None]), parts=2).top_k(frame(spark, [None]), q).collect() == []


def test_equal_vectors_meet_as_a_few(spark, monkeypatch):
    met = []
    tiles = simjoin.PivotJoin.tiles
    monkeypatch.setattr(simjoin.PivotJoin, "tiles", lambda self: met.append(self.n) or tiles(self))
    base = clustered(12, 8, 3, 0.2, 11)
    # Twice as long as another, so as near to it as its equals.
    base[5] = base[4] * 2
    of = np.random.default_rng(2).integers(0, 12, 600)
    x = base[of]
    s = np.round(cosines(x), 9)
    want = set()
    for i in range(600):
        near = sorted((j for j in range(600) if j != i and s[i, j] >= 0.85), key=lambda j: (-s[i, j], j))[:5]
        want |= {(min(i, j), max(i, j)) for j in near}
    rows = [*x, np.zeros(8), np.zeros(8), None, np.full(8, np.nan), np.full(8, np.nan), np.full(8, np.inf), np.full(8, np.inf)]
    got = [(r.a, r.b) for r in simjoin.neighbor_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert met == [12 * 6]


def test_rows_that_repeat_an_id_keep_their_vectors(spark):
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.1]])
    got = sorted((r.a, r.b) for r in simjoin.neighbor_pairs(frame(spark, x, [1, 1, 2, 3, 4])).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 4)]
