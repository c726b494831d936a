"""A part of the registered queries against their SQL at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from loamgraph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
CHECKED = ["chunk_tokens", "chunk_sentences", "acl_visible_docs", "multi_snapshot_counts", "bm25_topk", "vector_topk_cosine", "er_blocking_pairs", "context_refs", "injection_named", "pii_masked", "sanitized_output", "parsed_extraction", "entity_upsert", "relation_merge", "khop_subgraph", "shortest_path", "delete_doc_effects", "latency_p99", "regression_gate", "er_precision_recall"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    rows = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    cur = con.execute(catalog.SQL[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == columns
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_runs_without_the_training_data_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "ref_id", "id"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


@pytest.fixture
def tables(spark, tmp_path):
    """700 vectors and documents, 45 questions."""
    spark.range(700).selectExpr("id as vec_id", "array(cast(id % 7 + 1 as double), cast(id % 11 + 1 as double)) as embedding", "id % 10 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    text = "concat('word', id, repeat(' filler', 40), ' end', id) as text"
    spark.range(700).selectExpr("id as doc_id", text, "'en' as lang", "concat('src', id % 3) as source", "300L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(45).selectExpr("id as item_id", "concat('word', id, ' and end', id) as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_searches_without_sql_ask_their_whole_query_set(spark, tables):
    ids = lambda name: {r.query_id for r in catalog.QUERIES[name](spark, tables).select("query_id").distinct().collect()}
    assert ids("vector_topk_cells") == set(range(0, 700, 20))
    assert ids("context_naive") == ids("grounded_claims") == set(range(45))


def test_corpus_holds_whole_texts_and_all_ids(spark, tables):
    corpus = catalog._corpus(spark, tables)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert {r.name: r.description for r in corpus.entities.collect()} == {f"E{i}": text for i, text in texts.items()}
    assert {r.tgt_id for r in corpus.relations.collect()} >= {f"E{(i * 7 + 1) % 700}" for i in range(700)}
    reports = corpus.communities.collect()
    assert sorted(line for r in reports for line in r.summary.split("\n")) == sorted(texts.values())
    assert len({r.community_id for r in reports}) == len(reports) == 21


def test_similar_documents_equal_all_pairs(spark):
    from loamgraph.models import hashing_embedder

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    v = hashing_embedder()([r.text for r in rows]).astype(float)
    v /= [[max(sum(x * x for x in row) ** 0.5, 1e-12)] for row in v]
    s = v @ v.T
    want = {tuple(sorted((rows[i].doc_id, rows[j].doc_id))) for i in range(len(rows)) for j in range(i) if s[i, j] >= 0.95}
    assert {(r.a, r.b) for r in catalog.QUERIES["similar_documents"](spark, FOLDER).collect()} == want and want


@pytest.mark.parametrize("name", ["vector_topk_graph", "vector_topk_quantised"])
def test_approximate_searches_find_the_neighbours(spark, name):
    ids = lambda n: {(r.query_id, r.id) for r in catalog.QUERIES[n](spark, FOLDER).collect()}
    exact = ids("vector_topk_cosine")
    assert len(exact & ids(name)) >= 0.95 * len(exact)
