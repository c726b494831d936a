"""What queries hold and move at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loamgraph.operators import chunking, community, traverse


def written(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_semantic_chunks_embed_a_long_document_in_parts(spark, tmp_path):
    def embedder(texts):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write(f"{len(texts)}\n")
        return np.array([[1.0, 0.0] if "even" in t else [0.0, 1.0] for t in texts])

    # Pairs of like sentences, so that every second one goes on.
    text = " ".join(f"Sentence {i} is {'even' if i // 2 % 2 else 'odd'}." for i in range(1001))
    docs = spark.createDataFrame([(1, text), (2, "One."), (3, None)], "doc_id int, text string")
    got = chunking.semantic(docs, drift=0.3, least=1, most=45, embedder=embedder).orderBy("doc_id", "chunk_order_index").collect()
    assert [r.content for r in got if r.doc_id == 2] == ["One."] and not [r for r in got if r.doc_id == 3]
    own = [r.content for r in got if r.doc_id == 1]
    assert " ".join(own) == text and len(own) == 501 and all(c.count("Sentence") == 2 for c in own[:-1])
    assert max(map(int, open(f"{tmp_path}/calls"))) <= chunking.SENTENCES + 1


def test_neighbours_are_told_apart_after_they_are_sought(spark):
    edges = spark.range(200_000).selectExpr("concat('S', id % 1000) as src_id", "concat('P', id) as tgt_id")
    edges = edges.unionByName(spark.createDataFrame([("P5", "S5"), ("S5", "S5")], "src_id string, tgt_id string"))
    before = written(spark)
    got = {(r.name, r.neighbor) for r in traverse.neighbors(edges, F.broadcast(spark.createDataFrame([("S5",), ("P6",), ("S5",)], "name string"))).collect()}
    assert got == {("S5", f"P{i}") for i in range(5, 200_000, 1000)} | {("P6", "S6")}
    assert written(spark) - before < 200_000


def test_keywords_that_all_reports_hold_move_no_pairs(spark):
    reports = spark.range(5000).selectExpr("cast(id as int) as community_id", "'a title' as title", "concat('common x', id % 500, 'x') as summary")
    q = spark.range(200).selectExpr("cast(id as int) as query_id", "concat('common x', id, 'x') as text")
    before = written(spark)
    got = community.keyword_rank(reports, q, 3).select("query_id", "rank", "community_id", "score").collect()
    assert written(spark) - before < 1_000_000
    assert {tuple(r) for r in got} == {(i, n + 1, i + 500 * n, 2) for i in range(200) for n in range(3)}
