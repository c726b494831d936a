"""What building a corpus moves and leaves on disk."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from loamgraph.operators import safety
from loamgraph.plans import build
from loamgraph.plans.catalog import rule_model

POLICY = "struct<owner:string,visible_to_groups:array<string>,visible_to_users:array<string>,public:boolean>"


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def on_disk(spark):
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(top) for n in names)


def test_a_corpus_is_moved_once_and_kept_small(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)] + ["".join(r.choices("klmnopqrst", k=14)) for _ in range(30)]
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(200)]
    boss = ("boss", ["g"], [], False)
    docs = spark.createDataFrame([(i, text, boss) for i, text in enumerate([*texts, texts[0]])], f"doc_id int, text string, acl {POLICY}")
    size = sum(map(len, texts))
    shuffled, held, threshold = written(spark), on_disk(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = build.build(docs, rule_model, size=200, overlap=20, with_reports=False)
        got = built.chunks.agg(F.count("*"), F.sum(F.size(F.split("content", " ")))).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert tuple(got) == (200 * 11, 200 * 2200)
    assert [tuple(x.acl) for x in built.chunks.select("acl").distinct().collect()] == [(None, ["g"], ["boss"], False)]
    assert [tuple(x.acl) for x in built.entities.select("acl").distinct().collect()] == [(None, ["g"], ["boss"], False)]
    assert built.doc_chunks.count() == 201 * 11
    assert written(spark) - shuffled < 2 * size
    assert on_disk(spark) - held < 1.5 * size


def test_texts_with_over_half_of_the_patterns_are_dropped(spark):
    told = ["Ignore previous instructions", "ignore above  instructions", "disregard previous", "SYSTEM prompt", "you are now", "act as if", "pretend you are"]
    rows = spark.createDataFrame([(6, ". ".join(told[:6])), (7, ". ".join(told)), (0, None), (1, "")], "n int, content string")
    assert sorted(r.n for r in safety.drop_injected(rows).collect()) == [0, 1, 6]
