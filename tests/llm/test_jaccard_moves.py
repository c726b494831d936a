"""What the Jaccard join moves: keys that one set alone holds once, texts never."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loamgraph.llm import jaccard


def test_rows_of_shared_keys_are_kept_hot_or_not(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = {(int(k), s) for s in range(400) for k in [*r.integers(0, 3000, 8), *([7] if s % 2 else []), -s - 1]}
    n = Counter(k for k, _ in rows)
    want = sorted(x for x in rows if n[x[0]] > 1)
    keys = spark.createDataFrame(sorted(rows), "key long, sid long").repartition(7)
    for drawn, least in ((1, 5), (64, 1000), (2, 20)):
        monkeypatch.setattr(jaccard, "DRAWN", drawn)
        monkeypatch.setattr(jaccard, "HOT_LEAST", least)
        assert sorted(map(tuple, jaccard._shared(keys).collect())) == want


def test_texts_stay_where_they_are(spark):
    docs = spark.range(50).select("id", F.concat(F.lit("text "), "id").alias("text"), *(F.xxhash64("id", F.lit(c)).alias(c) for c in jaccard.NAME))
    base = jaccard._bucketed(docs.groupBy(*jaccard.NAME).agg(F.min("text").alias("text"), F.min("id").alias("sid")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard._texts(spark.range(0, 50, 2).select(F.col("id").alias("sid")), base)
        assert got._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 0
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted(map(tuple, got.collect())) == [(i, f"text {i}") for i in range(0, 50, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
