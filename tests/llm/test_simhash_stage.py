"""The pipeline's near-duplicate stage keeps one document of each component of op2's links."""

from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "bravo", "carol", "delta", "echo", "hotel"]) + str(r.randrange(300)) for _ in range(n))


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for j in r.sample(range(len(w)), n):
        w[j] = f"edit{seed}x{j}"
    return " ".join(w)


def test_stage_equals_brute_force_by_fingerprints(spark):
    from loamgraph.llm.pipeline import COLUMNS, near_duplicate_stage

    rows = []
    for k, n in enumerate((12, 60, 150, 400, 900)):
        base = prose(n, k)
        rows += [base, base.upper(), *(edited(base, max(1, n * c // 200), 10 * k + c) for c in range(1, 9))]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(rows)] + [(3, prose(30, 77)), (3, prose(30, 78)), (3, prose(30, 78)), (None, None), (None, ""), (None, " \n")]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [fingerprint(t) for _, t in order]
    at = list(range(len(order)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(order)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    # Of a component, one of the rows with its smallest id stays.
    want = sorted((order[i][0] is None, order[i][0] or 0, fps[i]) for i in range(len(order)) if root(i) == i and order[i][0] is not None)
    alone = sum(root(i) == i and order[i][0] is None for i in range(len(order)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    got = near_duplicate_stage(spark, docs.repartition(5), "")
    assert got.columns == COLUMNS
    got = got.collect()
    assert sorted((False, r.doc_id, fingerprint(r.text)) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == alone
    assert len(got) < len(rows) - 10
    assert near_duplicate_stage(spark, docs.limit(0), "").count() == 0
