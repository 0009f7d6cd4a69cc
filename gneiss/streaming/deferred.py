"""Work that is put off and waited for no longer than a while: what becomes of each piece, from a stream or a table."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_PENDING, WAIT = 6, "10 minutes"
OUTCOMES = "scope long, event_id long, outcome string, at timestamp"
_LONGS = T.ArrayType(T.LongType())
_PENDING = T.StructType([T.StructField("event_ids", _LONGS), T.StructField("works", T.ArrayType(T.StringType())), T.StructField("untils", _LONGS), T.StructField("timer", T.LongType())])


class _Registry(StatefulProcessor):
    """Of one scope: the work that is pending, by the time it runs out, and a timer for the first that runs out.

    All of it is one value, the timer's time included, since each call to the state or the timers is a message to the JVM and back.
    """

    def __init__(self, wait_ms: int, most: int | None, once: bool):
        self.wait_ms, self.most, self.once = wait_ms, most, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("pending", _PENDING)

    def _load(self) -> tuple[list[tuple], int | None]:
        held = self.value.get()
        return ([], None) if held is None else (list(zip(held[0], held[1], held[2], strict=True)), held[3])

    def _expire(self, pending: list[tuple], at: int, out: list[tuple]) -> list[tuple]:
        n = bisect_right(pending, at, key=itemgetter(2))
        out += [(e, "dropped", until * 1_000_000) for e, _, until in pending[:n]]
        return pending[n:] if n else pending

    def _keep(self, pending: list[tuple], timer: int | None) -> None:
        first = min((p[2] for p in pending), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if pending:
            self.value.update((*map(list, zip(*pending, strict=True)), first))
        else:
            self.value.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, out = list(rows), []
        ids, at = (np.concatenate([f[c].to_numpy().astype(t) for f in frames]).astype("int64") for c, t in (("event_id", "int64"), ("ts", "datetime64[ns]")))
        kinds, works = ([x for f in frames for x in f[c].tolist()] for c in ("kind", "work"))
        before, timer = self._load()
        pending = list(before)
        for i in np.lexsort((ids, at)).tolist():
            event, ns, work = int(ids[i]), int(at[i]), works[i]
            now = ns // 1_000_000
            pending = self._expire(pending, now - 1, out)  # an answer at the last moment is in time
            if kinds[i] == "answer":
                out += [(e, "delivered", ns) for e, _, _ in pending]
                pending = []
            elif self.once and any(p[1] == work for p in pending):
                out.append((event, "duplicate", ns))
            elif self.most is not None and len(pending) >= self.most:
                out.append((event, "refused", ns))
            else:
                insort(pending, (event, work, now + self.wait_ms), key=itemgetter(2))
        if pending != before:
            self._keep(pending, timer)
        yield from _frames(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        pending, _ = self._load()
        self._keep(self._expire(pending, timerValues.getCurrentWatermarkInMs(), out), None)  # the timer that has run out is gone
        yield from _frames(key[0], out)

    def close(self) -> None:
        pass


def _frames(scope: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        event, outcome, at = zip(*rows, strict=True)
        yield pd.DataFrame({"scope": np.full(len(rows), scope, "int64"), "event_id": np.array(event, "int64"), "outcome": outcome, "at": np.array(at, "datetime64[ns]")})


def outcomes(rows: DataFrame, wait: str = WAIT, most: int | None = MOST_PENDING, once: bool = True, late: str = "1 hour") -> DataFrame:
    """(scope, event_id, outcome, at) of a stream of rows (scope, event_id, ts, kind, work): what became of each piece of work put off.

    kind ``ask`` puts work off, ``answer`` delivers all that is pending in the scope.  Work that is pending already is a ``duplicate`` (with
    ``once``), work beyond ``most`` pending is ``refused``, and work without an answer for ``wait`` is ``dropped`` when that is over.  Rows
    later than the watermark are left out, rows without scope, id or time too.  What is still waited for has no row yet.
    """
    known = rows.where("scope IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return known.groupBy("scope").transformWithStateInPandas(_Registry(int(pd.Timedelta(wait).value // 1_000_000), most, once), OUTCOMES, "Append", "EventTime")


def answered(asked: DataFrame, answers: DataFrame, wait: str = WAIT, late: str = "1 hour") -> DataFrame:
    """(scope, event_id, asked_at, answered_at) of asked (scope, event_id, ts) with every answer (scope, ts) within ``wait``; null for none.

    Two streams are joined with bounds on their times, so what can't meet any more leaves the state; a stream gives the rows without an answer
    once the watermark has passed their time, a table gives all of them.  Null scopes meet nothing.
    """
    a = asked.select("scope", "event_id", F.col("ts").alias("asked_at")).withWatermark("asked_at", late)
    b = answers.select(F.col("scope").alias("of"), F.col("ts").alias("answered_at")).withWatermark("answered_at", late)
    near = F.expr(f"scope = of AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {wait}")
    return a.join(b, near, "left").select("scope", "event_id", "asked_at", "answered_at")
