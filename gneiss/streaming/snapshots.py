"""A stream of job states as the changes that a watcher is told of; what each job last was is kept across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("done", "failed", "cancelled")
IDLE = "6 hours"
CHANGES = "job_id long, event_id long, ts timestamp, kind string, status string, phase string"
_STATE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("ended", T.BooleanType()), T.StructField("beat", T.LongType())])


class _Watch(StatefulProcessor):
    """Of one job: the last state told, whether it has ended, and the timer of the next sign of life."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _arm(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        seen, status, phase, ended, beat = self.last.get() if self.last.exists() else (-(1 << 63), None, None, False, None)
        out, job = [], key[0]
        for r in new.itertuples(index=False):
            if ended or r.event_id <= seen:
                continue
            now = int(r.ts.value // 1_000_000)
            while beat is not None and beat < now:
                out.append((job, seen, pd.Timestamp(beat, unit="ms"), "alive", status, phase))
                beat += self.idle_ms
            seen, beat = int(r.event_id), now + self.idle_ms
            if (r.status, r.phase) != (status, phase):
                status, phase = r.status, r.phase
                out.append((job, seen, r.ts, "job", status, phase))
            if status in TERMINAL:
                ended, beat = True, None
                out.append((job, seen, r.ts, "done", status, phase))
        self.last.update((seen, status, phase, ended, beat))
        if beat is not None:
            self._arm(beat)
        else:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, status, phase, ended, beat = self.last.get()
        out, upto = [], timerValues.getCurrentWatermarkInMs()
        while not ended and beat is not None and beat <= upto:
            out.append((key[0], seen, pd.Timestamp(beat, unit="ms"), "alive", status, phase))
            beat += self.idle_ms
        self.last.update((seen, status, phase, ended, beat))
        if not ended and beat is not None:
            self._arm(beat)
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["job_id", "event_id", "ts", "kind", "status", "phase"]).astype({"job_id": "int64", "event_id": "int64", "ts": "datetime64[ns]"})


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).value // 1_000_000)


def changes(states: DataFrame, idle: str = IDLE, late: str = "1 hour") -> DataFrame:
    """(job_id, event_id, ts, kind, status, phase) of a stream of states (job_id, event_id, ts, status, phase): what a watcher is told.

    kind ``job``: status or phase are others than those told last; ``done``: the job has reached a terminal status, after which nothing
    of it is told; ``alive``: for ``idle`` of event time nothing came, told again after as long.  A state whose event_id is not above
    the last one is old and changes nothing, nor does one later than the watermark.  Needs the RocksDB state store (``with_state``).
    """
    rows = states.where("job_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Watch(_ms(idle)), T._parse_datatype_string(CHANGES), "Append", "EventTime")


def changes_of(states: DataFrame, idle: str = IDLE, late: str = "1 hour") -> DataFrame:
    """The same rows from a table, by windows: what a stream has told once it has read all of it and its watermark has come to rest.

    ``states`` is one row for each event; times grow with event_id.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("job_id").orderBy("event_id")
    rows = states.where("job_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").dropDuplicates(["job_id", "event_id"])
    last = rows.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("upto"))
    ended = F.max(F.col("status").isin(*TERMINAL).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    live = rows.withColumn("over", F.coalesce(ended, F.lit(0))).where("over = 0")
    before = lambda c: F.lag(c).over(by)
    live = live.withColumn("next", F.lead("ts").over(by)).withColumn("new", F.row_number().over(by) == 1).withColumn("changed", F.col("new") | ~F.col("status").eqNullSafe(before("status")) | ~F.col("phase").eqNullSafe(before("phase")))
    said = lambda where, kind, ts: live.where(where).select("job_id", "event_id", F.col(ts).alias("ts"), F.lit(kind).alias("kind"), "status", "phase")
    step = _ms(idle)
    first = F.timestamp_millis(F.unix_millis("ts") + step)
    # signs of life are told before the next state, or up to the watermark where there is none
    end = F.coalesce(F.timestamp_millis(F.unix_millis("next") - 1), F.col("upto"))
    beats = live.where(~F.col("status").isin(*TERMINAL)).crossJoin(last).where(first <= end)  # last is one row
    beats = beats.select("job_id", "event_id", F.explode(F.sequence(F.unix_millis(first), F.unix_millis(end), F.lit(step).cast("long"))).alias("at"), "status", "phase")
    beats = beats.select("job_id", "event_id", F.timestamp_millis("at").alias("ts"), F.lit("alive").alias("kind"), "status", "phase")
    return said(F.col("changed"), "job", "ts").unionByName(said(F.col("status").isin(*TERMINAL), "done", "ts")).unionByName(beats)
