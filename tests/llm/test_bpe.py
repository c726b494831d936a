"""Ids of whole texts against the library's, and what is learnt anew."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from loamgraph.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_librarys_on_drawn_texts(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 300)
    own = bpe.WordBpe(PATH)
    r = random.Random(9)
    parts = [chr(c) for c in range(1, 0x180)] + ["the", "Word", "ÀÉ", "Įß", "...", "),", "12", "²½", "'s", "'LL", "<|", "<|endoftext|>", "́", "é", "’s", "　", "日本", "\U0001f600", "\r\n"]
    for _ in range(60):
        texts = ["".join(r.choice(parts) + r.choice(["", "", " ", "\n"]) for _ in range(r.randrange(60))) for _ in range(r.randrange(1, 12))]
        for t, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.encode([]) == [] and own.encode(["", " \n"]) == [b"", b""]


def test_words_seen_in_another_case_or_before_another_sign_are_known(monkeypatch):
    own = bpe.WordBpe(PATH)
    own.encode(["some words, and others. (they) say! éa"])
    monkeypatch.setattr(own, "_learn", None)
    assert own.encode(["(Words) THEY, others! and some. ÉA"])[0]
