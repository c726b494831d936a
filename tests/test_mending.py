"""Broken JSON and interval joins."""

from __future__ import annotations

import datetime as dt
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.functions.jsonfix import mend, read_broken
from loamgraph.operators import extract, traverse

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)
BOXES = st.lists(VALUES, max_size=4) | st.dictionaries(st.text(max_size=5), VALUES, max_size=4)


@settings(max_examples=200, deadline=None)
@given(BOXES)
def test_valid_json_is_unchanged_and_read_alike(value):
    text = json.dumps(value, ensure_ascii=False)
    assert mend(text) == text
    assert json.loads(mend("answer: " + text + " and more")) == value


@settings(max_examples=200, deadline=None)
@given(BOXES, st.integers(0, 400))
def test_any_cut_gives_valid_json_of_the_same_kind(value, at):
    text = json.dumps(value)[: max(1, at)]
    got = json.loads(mend(text))
    assert isinstance(got, type(value))


def test_what_models_break():
    assert read_broken('{"a": [1, 2, {"b": "un') == {"a": [1, 2, {"b": "un"}]}
    assert read_broken("{'a': 'it''s', 'b': None, 'c': [True, False,],}") == {"a": "it''s", "b": None, "c": [True, False]}
    assert read_broken('{"said": "he said "no" to it", "n": 1}') == {"said": 'he said "no" to it', "n": 1}
    assert read_broken("{key: value, n: 1e3, \"line\": \"one\ntwo\", }") == {"key": "value", "n": 1000.0, "line": "one\ntwo"}
    assert read_broken('[{"a": 1, {"b": 2}]') == [{"a": 1, "": {"b": 2}}]
    assert read_broken('{"a": [1, 2}, "b": 3}') == {"a": [1, 2]} or read_broken('{"a": [1, 2}, "b": 3}') == {"a": [1, 2], "b": 3}
    assert read_broken('{"a": 1, "b') == {"a": 1} == read_broken('{"a": 1, "b":')
    assert read_broken("no braces") is None and mend(None) is None and mend("") is None
    assert len(read_broken("[" * 50_000)) == 1


def test_answers_are_mended_where_they_are_not_valid(spark):
    rows = [(1, 'x {"a": 1} y'), (2, 'x {"a": 2, '), (3, "nothing"), (4, None), (5, "{'a': 5}"), (6, '{"a": "six')]
    frame = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.r and r.r.a for r in frame.select("id", extract.parse_json(frame.t, "a string").alias("r")).collect()}
    assert got == {1: "1", 2: "2", 3: None, 4: None, 5: "5", 6: "six"}


def test_interval_join_equals_nested_loops(spark):
    rng = random.Random(3)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randrange(40 * 86400))
    rels = [(i, rng.choice([None, day()]), rng.choice([None, day(), day()])) for i in range(300)]
    snaps = [day() for _ in range(200)] + [rels[5][1], rels[6][2], None]
    snaps += snaps[:3]
    for kind in ("timestamp", "timestamp_ntz", "date"):
        as_ = (lambda v: v and v.date()) if kind == "date" else (lambda v: v)
        r = spark.createDataFrame([(i, as_(a), as_(b)) for i, a, b in rels], f"id int, valid_from {kind}, valid_to {kind}")
        s = spark.createDataFrame([(as_(x),) for x in snaps], f"snapshot_at {kind}")
        got = sorted((x.id, x.snapshot_at) for x in traverse.at_snapshots(r, s).collect())
        want = sorted((i, as_(x)) for i, a, b in rels for x in snaps if x is not None and (a is None or as_(a) <= as_(x)) and (b is None or as_(b) >= as_(x)))
        assert got == want
    plan = traverse.at_snapshots(r, s)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert traverse.at_snapshots(r, s.where("false")).count() == 0
    one = spark.createDataFrame([(as_(snaps[0]),)], "snapshot_at date")
    assert traverse.at_snapshots(r, one).count() == len({x[0] for x in got if x[1] == as_(snaps[0])})
