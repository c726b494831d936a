"""A running daily budget of tokens, kept by user in a stream's state and reset by timers, and a listener of streams' progress."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

DAY = 86_400_000
#: State of this kind needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DailyBudget(StatefulProcessor):
    """By user and day the tokens used. Days that the watermark has passed are told once more as closed, and forgotten.

    A user's open days are one value, and the first of them has the user's only timer, so a batch costs a user a read and a write.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "days array<long>, used array<long>")

    def _told(self, user, rows: list[tuple[int, int]], kind: str) -> Iterator[Row]:  # noqa: ANN001
        for day, used in rows:
            yield Row(user_id=user, day=day, used=used, over=0 < self.most < used, kind=kind)

    def _days(self) -> dict[int, int]:
        known = self.open.get()
        return dict(zip(known[0], known[1], strict=True)) if known is not None else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        sums: dict[int, int] = {}
        for row in rows:
            sums[row["day"]] = sums.get(row["day"], 0) + row["tokens"]
        days = self._days()
        first = min(days, default=None)
        for day, tokens in sums.items():
            days[day] = days.get(day, 0) + tokens
        self.open.update((list(days), list(days.values())))
        begins = min(days)
        if first is None or begins < first:
            if first is not None:
                self.handle.deleteTimer((first + 1) * DAY)
            self.handle.registerTimer((begins + 1) * DAY)
        yield from self._told(key[0], [(day, days[day]) for day in sorted(sums)], "running")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        days = self._days()
        over = sorted(day for day in days if (day + 1) * DAY <= timerValues.getCurrentWatermarkInMs())
        left = {day: used for day, used in days.items() if day not in set(over)}
        if left:
            self.open.update((list(left), list(left.values())))
            self.handle.registerTimer((min(left) + 1) * DAY)
        else:
            self.open.clear()
        yield from self._told(key[0], [(day, days[day]) for day in over], "closed")

    def close(self) -> None:
        pass


def daily_budget(events: DataFrame, most: int = 0, late: str = "1 hour", ts: str = "ts", by: str = "user_id", tokens: str = "tokens") -> DataFrame:
    """user_id, day, used, over, kind of a stream of events: for each batch the `running` total of the days that it adds to, and `closed` totals.

    A day is one of UTC. A budget of 0 is unlimited. Null users, times and token counts are left out, and rows that come later than `late` don't count. The state of a user is a number a day that
    is still open; a batch that is run again after a failure begins from the state before it, so it counts once.
    """
    rows = events.select(F.col(by).alias("user_id"), F.col(ts).cast("timestamp").alias("_t"), F.col(tokens).cast("long").alias("tokens")).where("user_id is not null and _t is not null and tokens is not null")
    rows = rows.withWatermark("_t", late).withColumn("day", F.floor(F.unix_millis("_t") / DAY).cast("long"))
    kind = events.schema[by].dataType.simpleString()
    return rows.groupBy("user_id").transformWithState(DailyBudget(most), f"user_id {kind}, day long, used long, over boolean, kind string", "update", "eventTime")


class Progress(StreamingQueryListener):
    """The last `keep` reports of streams that run in the session: add it with spark.streams.addListener()."""

    def __init__(self, keep: int = 1000):
        self.reports: deque[dict] = deque(maxlen=keep)
        self.ended: deque[dict] = deque(maxlen=keep)
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        with self._lock:
            self.reports.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "state_rows": state, "watermark": (p.eventTime or {}).get("watermark")})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        with self._lock:
            self.ended.append({"id": str(event.id), "error": event.exception})
