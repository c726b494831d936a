"""Repair of conversations against a search of all edits, on whole conversations and on ones cut in many pieces."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from loamgraph.llm.conversations import damaged_rows, plain_rows, repair, repair_report, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def search(rows):
    """(cost, letters, role and text pairs), by trying every edit at every place; the accepted roles are told by the pattern itself."""
    allowed = re.compile(r"(s?(ua)+)?\Z")
    prefixes = {"", "s", "u", "ua", "su", "sua", "uau", "suau", "uaua", "suaua"}

    def short(p):
        # What may follow depends on the first letter and the last two alone.
        while len(p) > 5 or (p not in prefixes and len(p) > 4):
            p = p[:-4] + p[-2:]
        return p

    @cache
    def best(i, given, added):
        out = []
        if i == len(rows) and allowed.match(given):
            out.append((0, "", ()))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, letters, kept = best(i + 1, given, 0)
            out.append((cost + 2, "D" + letters, kept))
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                for letter, own, new in [("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")]:
                    after = short(given + new[:1])
                    if new and after in prefixes:
                        cost, letters, kept = best(i + 1, after, 0)
                        out.append((cost + own + late, letter + letters, ((new, text), *kept)))
        if added < 3:
            for new in ("user", "assistant"):
                after = short(given + new[0])
                if after in prefixes:
                    cost, letters, kept = best(i, after, added + 1)
                    out.append((cost + 5, "I" + letters, ((new, ""), *kept)))
        return min(out, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows, damage=True):
    """The report of each conversation, from (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        space = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damage else 19
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, told = set(), []
        for _, role, text in own:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, kept = search(tuple(told))
        faults = [f for _, _, f in told]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def random_rows(n, convs, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "usher"]
    texts = ["Yes.", "No!", "cut off", "", "  \n", None, "Why?  \n", "a.b", "über.", "x" * 9 + "."]
    return [(rng.choice(convs), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.") for _ in range(n)]


def reported(spark, rows, **options):
    out = repair_report(damaged_rows(spark.createDataFrame(rows, SCHEMA)), **options).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


@pytest.mark.parametrize("piece_rows", [2, 1 << 16])
def test_repair_equals_a_search_of_all_edits(spark, piece_rows):
    rows = random_rows(400, [None, 1, 2, 3, *range(4, 60)], 5) + random_rows(120, [1, None], 6)
    rows += [rows[0]] * 7 + [(999, 3, "user", "lost?")]
    assert zlib.crc32(b"999:3") % 20 != 0
    assert reported(spark, rows, piece_rows=piece_rows) == brute(rows)


def test_a_conversation_that_loses_all_rows_stays_with_zeros(spark):
    lost = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert reported(spark, [(*lost, "user", "Hello.")]) == {lost[0]: (0, 0, 0, 0, 0, 0, "", empty)}


def test_an_empty_table_gives_no_rows(spark):
    assert reported(spark, []) == {}


def test_turns_other_columns_and_long_texts(spark):
    long = "w. " * 400_000
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", long), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "Hi."), (2, 1, "user", "Well?")]
    frame = spark.createDataFrame([(*r, 5, True) for r in rows], SCHEMA + ", code int, whole boolean")
    pieces = repair(plain_rows(frame))
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in repaired_turns(pieces).collect()}
    want = {}
    for conv in (1, 2):
        own = [(r, t, "" if t.rstrip()[-1] in ".!?" else "truncated") for c, _, r, t in rows if c == conv]
        want |= {(conv, i): line for i, line in enumerate(search(tuple(own))[2])}
    assert got == want
    assert {r.conv_id: r.gaps for r in pieces.select("conv_id", "gaps").collect()} == {1: 1, 2: 0}
