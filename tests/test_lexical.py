"""BM25 where the documents are, against joins and for what it moves."""

from __future__ import annotations

import random

import pytest

from loamgraph.operators import lexical


def written(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_a_word_of_all_questions_and_documents_moves_no_pairs(spark):
    docs = spark.range(6000).selectExpr("cast(id as int) as doc_id", "concat('common w', id % 400) as text")
    q = spark.range(200).selectExpr("cast(id as int) as query_id", "concat('common w', id) as text")
    before = written(spark)
    got = lexical.top_k(docs, q, 3).collect()
    assert written(spark) - before < 1_000_000
    assert {(r.query_id, r["rank"], r.id) for r in got} == {(i, n + 1, i + 400 * n) for i in range(200) for n in range(3)}


@pytest.mark.parametrize("positive", [False, True])
def test_scores_in_tasks_are_those_of_joins(spark, monkeypatch, positive):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("The cat, sat on a red mat of gold".split()) for _ in range(n))
    docs = spark.createDataFrame([(i, line(rng.randrange(12))) for i in range(150)] + [(150, None), (151, "  , ")], "doc_id int, text string").repartition(3)
    q = spark.createDataFrame([(0, "cat cat gold"), (1, "the"), (2, ""), (3, None), (4, "none here"), (5, "red mat none")], "query_id int, text string")
    rows = lambda: sorted((r.query_id, r["rank"], r.id, r.score) for r in lexical.top_k(docs, q, 7, positive).collect())
    told = rows()
    monkeypatch.setattr(lexical, "PRODUCT", 30)
    assert rows() == told
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 1)
    joined = rows()
    assert [r[:3] for r in joined] == [r[:3] for r in told] and [r[3] for r in joined] == pytest.approx([r[3] for r in told], abs=1e-8)
