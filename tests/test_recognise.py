"""Recognisers on planted texts, and the choice among overlapping spans against all choices."""

from __future__ import annotations

import itertools
import random

from loamgraph.operators import recognise

PLANTED = [
    ("write to a.b@mail.org now", [("EMAIL", "a.b@mail.org")]),
    ("card 4111 1111 1111 1111 ok", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("number 4111 1111 1111 1112 ok", []),
    ("my card 4111-1111-1111-1112", [("CREDIT_CARD", "4111-1111-1111-1112")]),
    ("ssn 123-45-6789", [("SSN", "123-45-6789")]),
    ("no ssn 000-45-6789 nor 666-45-6789", []),
    ("host 10.0.0.255 up", [("IP_ADDRESS", "10.0.0.255")]),
    ("version 10.0.0.256", []),
    ("iban DE89 3704 0044 0532 0130 00.", [("IBAN", "DE89 3704 0044 0532 0130 00")]),
    ("ref DE88 3704 0044 0532 0130 00.", []),
    ("call +1 202 555 0100 or mail x@y.io; card 4012888888881881", [("PHONE", "+1 202 555 0100"), ("EMAIL", "x@y.io"), ("CREDIT_CARD", "4012888888881881")]),
    ("é😀 x@y.io 😀", [("EMAIL", "x@y.io")]),
    ("", []),
    (None, []),
]


def test_planted_texts(spark):
    rows = [(i % 9 or None, t, "x") for i, (t, _) in enumerate(PLANTED)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, score string").coalesce(1)
    out = recognise.recognised(frame).withColumn("masked", recognise.spliced(frame.text, recognise.F.col("findings"), "#")).collect()
    got = {r.text: [(f.category, f.text) for f in r.findings] for r in out}
    assert len(out) == len(PLANTED) and got == {t: want for t, want in PLANTED}
    for r in out:
        text, want = r.text or "", r.text or ""
        for f in r.findings:
            # Characters as Spark counts them, code points.
            assert text[f.start : f.end] == f.text
        for f in reversed(r.findings):
            want = want[: f.start] + "#" + want[f.end :]
        assert r.masked == want


def test_context_and_least_scores(spark):
    frame = spark.createDataFrame([(1, "call 44 20 7946 0958"), (2, "id 44 20 7946 0958"), (3, "x" * 60 + " 44 20 7946 0958 " + "y" * 60 + " call")], "doc_id int, text string")
    score = lambda least: {r.doc_id: [f.score for f in r.findings] for r in recognise.recognised(frame, least=least).collect()}
    assert score(0.4) == {1: [0.75], 2: [0.4], 3: [0.4]} and score(0.5) == {1: [0.75], 2: [], 3: []}


def test_own_recognisers_and_categories_as_masks(spark):
    own = {"PART": recognise.Recogniser(r"P-\d+", 0.6), "LONG_PART": recognise.Recogniser(r"P-\d+-\d+", 0.9)}
    frame = spark.createDataFrame([(1, "P-1 and P-22-3, P-4")], "doc_id int, text string")
    row = recognise.recognised(frame, recognisers=own).withColumn("m", recognise.spliced(frame.text, recognise.F.col("findings"), None)).first()
    assert row.m == "[PART] and [LONG_PART], [PART]" and recognise.recognised(frame.where("false"), recognisers=own).count() == 0


def test_choice_among_overlapping_spans_is_the_best():
    rng = random.Random(4)
    for _ in range(300):
        spans = sorted(((s := rng.randrange(12)), s + rng.randrange(1, 6), rng.choice([0.3, 0.5, 0.9])) for _ in range(rng.randrange(0, 7)))
        spans.sort(key=lambda x: (x[1], x[0]))
        kept = recognise.choose([a for a, _, _ in spans], [b for _, b, _ in spans], [v for _, _, v in spans])
        apart = lambda c: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(c, 2))
        best = max((round(sum(v for _, _, v in c), 9), sum(b - a for a, b, _ in c)) for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if apart(c))
        chosen = [spans[i] for i in kept]
        assert apart(chosen) and (round(sum(v for _, _, v in chosen), 9), sum(b - a for a, b, _ in chosen)) == best
