"""Stems of four languages, and cover density against all stretches."""

from __future__ import annotations

import random
import re

import pytest

from loamgraph.functions.stems import stem
from loamgraph.operators import stemmed


def test_english_stems_as_published():
    want = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
        "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv",
        "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "effective": "effect",
        "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "a": "a", "is": "is",
    }
    assert {w: stem(w) for w in want} == want


@pytest.mark.parametrize(("language", "alike", "apart"), [
    ("en", ["connect", "connected", "connecting", "connection", "connections"], ["cat", "dog"]),
    ("fr", ["continuation", "continuations", "continuait", "continuer"], ["maison", "jardin"]),
    ("de", ["freund", "freunde", "freunden", "freundes"], ["haus", "baum"]),
    ("es", ["trabajo", "trabajos", "trabajar", "trabajando", "trabajado"], ["casa", "perro"]),
])
def test_forms_of_a_word_share_a_stem(language, alike, apart):
    assert len({stem(w, language) for w in alike}) == 1
    assert len({stem(w, language) for w in [alike[0], *apart]}) == 3
    assert stem("ab", language) == "ab" and stem("words", "xx") == "words"


def stretches(places, n):
    """All stretches that hold every term and no shorter one that does."""
    spans = [(a, b) for a, _ in places for b, _ in places if a <= b and len({t for p, t in places if a <= p <= b}) == n]
    return sum(n / (b - a + 1) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans))


def test_cover_density_counts_the_shortest_stretches():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 4)
        places = sorted((p, rng.randrange(n)) for p in rng.sample(range(25), rng.randrange(1, 12)))
        assert stemmed.cover_density([p for p, _ in places], [t for _, t in places], n) == pytest.approx(stretches(places, n))


def test_search_by_stems_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["connect", "connected", "connection", "run", "running", "blue", "Blues", "the"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 10)))) for i in range(80)] + [(90, None), (91, "connections, RUN!")]
    questions = ["connecting runs", "blue", "the connections run", "", None, "missing run"]
    toks = lambda t: [stem(w) for w in re.sub(r"[^\w\s]", "", (t or "").lower()).split()]
    want = {}
    for q, text in enumerate(questions):
        asked = sorted(set(toks(text)))
        for i, body in docs:
            places = [(p, asked.index(s)) for p, s in enumerate(toks(body)) if s in asked]
            if asked and len({t for _, t in places}) == len(asked):
                want[q, i] = stretches(places, len(asked))
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id int, text string, stem string")
    got = stemmed.stemmed_search(frame, spark.createDataFrame(list(enumerate(questions)), "query_id int, text string"), None).collect()
    assert {(r.query_id, r.id): r.score for r in got} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    for q in range(len(questions)):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert own == sorted(own, key=lambda r: (-r.score, r.id))


def test_places_of_frequent_words_are_not_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(stemmed, "stored", lambda rows, real=stemmed.stored: kept.append(real(rows)) or kept[-1])
    docs = spark.createDataFrame([(i, "the " * 50 + ("rare find" if i == 7 else "other find")) for i in range(60)], "doc_id int, text string")
    q = spark.createDataFrame([(i, "the rare finds") for i in range(20)], "query_id int, text string")
    assert {(r.query_id, r.id) for r in stemmed.stemmed_search(docs, q, None).collect()} == {(i, 7) for i in range(20)}
    assert max(rows.count() for rows in kept) <= 100
