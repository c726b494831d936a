"""Small functions that no query shows: names, messages, times, reports, migration, retries, maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loamgraph import models
from loamgraph.functions import text as tx
from loamgraph.operators import chunking, retrieve, store, vector
from loamgraph.plans.build import Built, maintain


def test_workspace_names_messages_and_times(spark):
    row = spark.createDataFrame([("w", "ns", "be brief", "hi", None, "2024-05-06T07:08:09", "soon")], "w string, n string, s string, u string, a string, t string, bad string")
    got = row.select(
        tx.workspace_name(F.col("w"), F.col("n")).alias("full"), tx.workspace_name(F.lit(""), F.col("n")).alias("bare"), tx.as_messages(F.col("s"), F.col("u"), F.col("a")).alias("m"),
        tx.timestamp(F.col("t")).alias("t"), tx.timestamp(F.col("bad")).alias("bad"),
    ).first()
    assert (got.full, got.bare) == ("w/ns", "ns") and [(m.role, m.content) for m in got.m] == [("system", "be brief"), ("user", "hi")]
    assert got.t == dt.datetime(2024, 5, 6, 7, 8, 9) and got.bad is None


def test_a_separator_is_taken_out_and_joins_what_it_parted(spark):
    docs = spark.createDataFrame([(1, "one|two three"), (2, None), (3, "||")], "doc_id int, text string")
    got = [(r.doc_id, r.tokens, r.content) for r in chunking.by_tokens(docs, 5, 1, separator="|").collect()]
    assert got == [(1, 2, "onetwo three")]


def test_reports_and_caches_are_written_and_read_again(spark, tmp_path):
    report = spark.createDataFrame([("recall", 0.5)], "metric string, value double")
    store.save_report(report, f"{tmp_path}/report")
    store.save_report(report, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").select("metric", "value").collect() == report.collect()
    store.migrate(spark, f"{tmp_path}/report", f"{tmp_path}/moved", schema="metric string, value double")
    assert spark.read.parquet(f"{tmp_path}/moved").collect() == report.collect()
    store.migrate(spark, f"{tmp_path}/moved", f"{tmp_path}/back", "parquet", "json")
    assert spark.read.schema("metric string, value double").json(f"{tmp_path}/back").collect() == report.collect()


def test_retries_list_the_claims_that_nothing_bears_out(spark):
    answered = spark.createDataFrame([(1, "ask one"), (2, "ask two")], "query_id int, prompt string")
    checked = spark.createDataFrame([(1, 1, "second", False), (1, 0, "first", False), (1, 2, "third", True), (2, 0, "fine", True)], "query_id int, claim_no int, claim string, supported boolean")
    got = {r.query_id: r.prompt for r in retrieve.retry_prompts(answered, checked).collect()}
    assert got == {1: "ask one\n\nUnsupported claims:\n- first\n- second"}


def test_cached_embeddings_and_calls_at_once(spark):
    texts = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    cache = spark.createDataFrame([("a", [1.0]), ("a", [1.0])], "text string, embedding array<double>")
    assert {r.text: r.embedding for r in vector.cached_embeddings(texts, cache).collect()} == {"a": [1.0], "b": None, None: None}
    assert models.at_most(texts.repartition(5), 2).rdd.getNumPartitions() == 2


def test_maintenance_drops_orphans_that_no_chunk_names(spark):
    ents = spark.createDataFrame([("A", ["c"]), ("B", []), ("C", []), ("D", None)], "name string, source_ids array<string>")
    rels = spark.createDataFrame([("A", "B")], "src_id string, tgt_id string")
    kept = maintain(Built(None, None, ents, rels, None, None))
    assert {r.name for r in kept.entities.collect()} == {"A", "B"}
    assert {(r.community_id, r.name) for r in kept.communities.collect()} == {("A", "A"), ("A", "B")}


def test_entities_merge_by_strategy(spark):
    from loamgraph.operators import graph

    ents = spark.createDataFrame([("A", "person", "one\ntwo", ["c1"], 0.5), ("B", "city", "two\nthree", ["c2"], 0.9), ("C", "river", " ", ["c3"], 0.9), ("D", "lake", "alone", ["c4"], 0.1)], "name string, type string, description string, source_ids array<string>, confidence double")
    rels = spark.createDataFrame([("B", "D", "k", "d", ["c2"], 0.5, None, None)], "src_id string, tgt_id string, keywords string, description string, source_ids array<string>, confidence double, valid_from timestamp, valid_to timestamp")
    aliases = spark.createDataFrame([("B", "A"), ("C", "A")], "alias string, canonical string")
    merged = lambda how: {r.name: (r.type, r.description, r.confidence) for r in graph.merge_entities(ents, rels, aliases, how)[0].collect()}["A"]
    assert merged("concatenate") == ("person", "one\ntwo\ntwo\nthree", 0.9)
    assert merged("confidence_weighted") == ("city", "one\ntwo\ntwo\nthree", 0.9)
    assert merged("keep_first") == ("person", "one\ntwo", 0.9) and merged("join_unique") == ("person", "one\ntwo\nthree", 0.9)
    assert [(r.src_id, r.tgt_id) for r in graph.merge_entities(ents, rels, aliases, "join_unique")[1].collect()] == [("A", "D")]
