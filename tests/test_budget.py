"""The running budget against batch sums, with a late row, restarts and a listener."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest

from loamgraph.streaming import budget

SCHEMA = "user_id long, ts timestamp, tokens long"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*budget.STORE)
    yield spark
    spark.conf.unset(budget.STORE[0])


def run(spark, folder, place, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    took = budget.daily_budget(stream, 100).writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend((i, *r) for r in df.collect()))
    q = took.queryName("budget").option("checkpointLocation", place).trigger(availableNow=True).start()
    q.awaitTermination(150)


def test_running_totals_equal_batch_sums_without_late_rows(rocks, tmp_path):
    spark, rng = rocks, random.Random(1)
    day = lambda d, h: dt.datetime(2024, 1, 1 + d, h)
    files = [[(rng.randrange(3), day(d, rng.randrange(24)), rng.randrange(1, 60)) for _ in range(12)] for d in range(4)]
    files[1] += [(1, day(0, 23), 5), (None, day(1, 1), 5), (1, None, 5), (1, day(1, 1), None)]
    late = (2, day(0, 3), 7)
    folder, place, out = f"{tmp_path}/in", f"{tmp_path}/checkpoint", []
    watched = budget.Progress()
    spark.streams.addListener(watched)
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for rows in files[:3]:
        write(rows)
        time.sleep(0.05)
    run(spark, folder, place, out)
    # Started again from its checkpoint, with a row of a day that is closed by now.
    write([*files[3], late])
    run(spark, folder, place, out)
    counted = [r for f in files for r in f if None not in r]
    want = {}
    for user, ts, n in counted:
        key = (user, (ts - dt.datetime(1970, 1, 1)).days)
        want[key] = want.get(key, 0) + n
    last = {(u, d): (used, over) for _, u, d, used, over, _ in out}
    assert last == {k: (v, v > 100) for k, v in want.items()}
    closed = [(u, d) for _, u, d, _, _, kind in out if kind == "closed"]
    assert len(closed) == len(set(closed)) and {k for k in want if k[1] <= 19724} <= set(closed)
    for _ in range(100):
        if len(watched.ended) >= 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(watched)
    reports = [r for r in watched.reports if r["name"] == "budget"]
    assert sum(r["rows"] for r in reports) == sum(map(len, files)) + 1 and max(r["state_rows"] for r in reports) > 0
    assert [r["error"] for r in watched.ended][:2] == [None, None]


def test_a_batch_costs_a_user_one_read_one_write_and_one_timer():
    class Handle:
        def __init__(self):
            self.value, self.calls, self.timers = None, [], set()

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 12 * budget.DAY

    handle, p = Handle(), budget.DailyBudget(100)
    p.init(handle)
    rows = lambda days: [{"day": d, "tokens": 60} for d in days]
    told = [tuple(r) for r in p.handleInputRows((7,), rows(range(10, 40)), None)]
    assert told == [(7, d, 60, False, "running") for d in range(10, 40)]
    assert handle.calls == ["get", "update"] and handle.timers == {11 * budget.DAY}
    assert [tuple(r) for r in p.handleInputRows((7,), rows([9, 10]), None)] == [(7, 9, 60, False, "running"), (7, 10, 120, True, "running")]
    assert handle.timers == {10 * budget.DAY}
    assert [tuple(r)[1:3] for r in p.handleExpiredTimer((7,), handle, None)] == [(9, 60), (10, 120), (11, 60)]
    assert 13 * budget.DAY in handle.timers and min(handle.value[0]) == 12
