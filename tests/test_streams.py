"""Streams with state: equal to their batch forms, however the rows are dealt out, and after a restart."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.streaming import replay, snapshots

STATES = "event_id long, job_id long, ts timestamp, status string, phase string"


def states(spark):
    at = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(200):
        job = i * 7 % 11
        status = "done" if i > 150 and job == 3 else "failed" if i == 90 else "running" if i % 40 > job else "queued"
        rows.append((i, job, (at + pd.Timedelta(minutes=13 * i)).to_pydatetime(), status, None if i % 5 else f"phase{i % 3}"))
    rows += [rows[0], (None, 1, at.to_pydatetime(), "running", "x"), (500, None, at.to_pydatetime(), "running", "x")]
    return spark.createDataFrame(rows, STATES)


def said(df):
    return sorted((x.job_id, x.event_id, str(x.ts), x.kind, x.status, x.phase or "") for x in df.collect())


def plain(rows, idle, late):
    """Row by row."""
    out, last = [], {}
    upto = max(r.ts for r in rows) - late
    for r in sorted((r for r in rows if r.job_id is not None and r.event_id is not None), key=lambda r: r.event_id):
        seen = last.setdefault(r.job_id, {"id": -1, "told": None, "beat": None, "over": False})
        if seen["over"] or r.event_id <= seen["id"]:
            continue
        while seen["beat"] is not None and seen["beat"] < r.ts:
            out.append((r.job_id, seen["id"], str(seen["beat"]), "alive", *seen["told"]))
            seen["beat"] += idle
        now = (r.status, r.phase or "")
        seen.update(id=r.event_id, beat=r.ts + idle)
        if now != seen["told"]:
            out.append((r.job_id, r.event_id, str(r.ts), "job", *now))
            seen["told"] = now
        if r.status in snapshots.TERMINAL:
            out.append((r.job_id, r.event_id, str(r.ts), "done", *now))
            seen["over"] = True
    for job, seen in last.items():
        while not seen["over"] and seen["beat"] <= upto:
            out.append((job, seen["id"], str(seen["beat"]), "alive", *seen["told"]))
            seen["beat"] += idle
    return sorted(out)


@pytest.mark.parametrize("stop_at", [None, 1])
def test_changes_of_a_stream(spark, tmp_path, stop_at):
    df = states(spark)
    want = plain(df.collect(), pd.Timedelta("3 hours").to_pytimedelta(), pd.Timedelta("1 hour").to_pytimedelta())
    assert said(snapshots.changes_of(df, "3 hours", "1 hour")) == want
    replay.arrive(df.where("event_id IS NOT NULL"), "event_id", str(tmp_path / "in"), 4)
    with replay.with_state(spark, 2):
        for start in range(2 if stop_at is not None else 1):  # the first start ends after a batch that it has written and not noted
            stream = snapshots.changes(spark.readStream.schema(STATES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "3 hours", "1 hour")
            seen = replay.commit_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"), after=(lambda n: n != stop_at) if start == 0 else None)
    assert seen >= 3
    assert said(replay.committed(spark, str(tmp_path / "out"), snapshots.CHANGES)) == want


def test_a_batch_that_comes_twice(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") * 2).alias("x"))
    replay.arrive(df, "event_id", str(tmp_path / "in"), 4)
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert replay.commit_batches(read(), str(tmp_path / "out"), str(tmp_path / "check"), after=lambda n: n < 2) == 3
    assert replay.committed(spark, str(tmp_path / "out"), df.schema).count() == 30
    assert replay.commit_batches(read(), str(tmp_path / "out"), str(tmp_path / "check")) == 2  # the third again, and the fourth
    assert sorted(map(tuple, replay.committed(spark, str(tmp_path / "out"), df.schema).collect())) == [(i, 2 * i) for i in range(40)]
    assert replay.commit_batches(read(), str(tmp_path / "out"), str(tmp_path / "check")) == 0


ROWS = "event_id long, scope long, ts timestamp, kind string, work string"


def asked(spark):
    at = pd.Timestamp("2024-01-01")
    rows = [(i, i * i % 5, (at + pd.Timedelta(seconds=97 * i)).to_pydatetime(), "answer" if i % 9 == 4 else "ask", f"w{i * 3 % 7}") for i in range(300)]
    return spark.createDataFrame([*rows, (900, None, at.to_pydatetime(), "ask", "x")], ROWS)


def plain_outcomes(rows, wait, most, once, late):
    out, pending = [], {}
    rows = sorted((r for r in rows if r.scope is not None), key=lambda r: (r.ts, r.event_id))
    for r in rows:
        own = pending.setdefault(r.scope, [])
        for p in [p for p in own if p[2] < r.ts]:
            out.append((r.scope, p[0], "dropped", str(p[2])))
            own.remove(p)
        if r.kind == "answer":
            out += [(r.scope, p[0], "delivered", str(r.ts)) for p in own]
            own.clear()
        elif once and any(p[1] == r.work for p in own):
            out.append((r.scope, r.event_id, "duplicate", str(r.ts)))
        elif most is not None and len(own) >= most:
            out.append((r.scope, r.event_id, "refused", str(r.ts)))
        else:
            own.append((r.event_id, r.work, r.ts + wait))
    upto = rows[-1].ts - late
    return sorted(out + [(s, p[0], "dropped", str(p[2])) for s, own in pending.items() for p in own if p[2] <= upto])


@pytest.mark.parametrize("most, once, stop_at", [(3, True, 1), (None, False, None)])
def test_deferred_work(spark, tmp_path, most, once, stop_at):
    df = asked(spark)
    want = plain_outcomes(df.collect(), pd.Timedelta("50 minutes").to_pytimedelta(), most, once, pd.Timedelta("1 hour").to_pytimedelta())
    assert {x[2] for x in want} >= ({"dropped", "delivered"} | ({"duplicate", "refused"} if once else set()))
    replay.arrive(df, "event_id", str(tmp_path / "in"), 3)
    from gneiss.streaming import deferred

    with replay.with_state(spark, 2):
        for start in range(2 if stop_at is not None else 1):
            stream = deferred.outcomes(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "50 minutes", most, once)
            replay.commit_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"), after=(lambda n: n != stop_at) if start == 0 else None)
    got = sorted((x.scope, x.event_id, x.outcome, str(x["at"])) for x in replay.committed(spark, str(tmp_path / "out"), deferred.OUTCOMES).collect())
    assert got == want


class Calls:
    """A handle that stands for the state, and counts the messages that would go to the JVM."""

    def __init__(self):
        self.n, self.held, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.n += 1
        return self.held

    def update(self, value):
        self.n, self.held = self.n + 1, value

    def clear(self):
        self.n, self.held = self.n + 1, None

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


def test_deferred_work_asks_the_state_little():
    """Messages for a scope do not grow with its rows, and its timer is set anew only for another time."""
    from gneiss.streaming import deferred

    calls, registry = Calls(), deferred._Registry(60_000, None, False)
    registry.init(calls)
    frame = lambda first, kinds: pd.DataFrame({"event_id": range(first, first + len(kinds)), "ts": pd.to_datetime(range(first, first + len(kinds)), unit="s").astype("datetime64[ns]"), "kind": kinds, "work": "w"})
    told = lambda first, kinds: [x for f in registry.handleInputRows((1,), iter([frame(first, kinds)]), None) for x in f.itertuples(index=False, name=None)]
    assert told(0, ["ask"] * 20) == [] and calls.n == 3 and calls.timers == {60_000}
    assert told(20, ["ask"] * 20) == [] and calls.n == 5 and calls.timers == {60_000}
    assert [x[:3] for x in told(40, ["answer"])] == [(1, i, "delivered") for i in range(40)] and calls.n == 8 and calls.timers == set() and calls.held is None


def test_streams_that_meet(spark, tmp_path):
    from gneiss.streaming import deferred

    df = asked(spark)
    replay.arrive(df.where("event_id < 900"), "event_id", str(tmp_path / "in"), 3)
    read = lambda kind: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).where(F.col("kind") == kind)
    with replay.with_state(spark, 2):
        replay.commit_batches(deferred.answered(read("ask"), read("answer"), "20 minutes"), str(tmp_path / "out"), str(tmp_path / "check"))
    batch = deferred.answered(df.where("kind = 'ask' AND scope IS NOT NULL"), df.where("kind = 'answer'"), "20 minutes")
    upto = df.groupBy("kind").agg(F.max("ts").alias("ts")).agg(F.min("ts") - F.expr("INTERVAL 1 hour")).first()[0]  # the slower side's watermark
    rows = lambda x: sorted(map(str, x.collect()))
    got = replay.committed(spark, str(tmp_path / "out"), batch.schema)
    assert rows(got.where("answered_at IS NOT NULL")) == rows(batch.where("answered_at IS NOT NULL"))
    sure = F.col("answered_at").isNull() & (F.col("asked_at") < F.lit(upto) - F.expr("INTERVAL 20 minutes"))
    assert rows(got.where(sure)) == rows(batch.where(sure)) != []


@pytest.mark.parametrize("stop_at", [None, 1])
def test_a_field_that_arrives_in_pieces(spark, tmp_path, stop_at):
    import json

    from gneiss.streaming import fields

    said = {1: 'quotes " and \\ and\nlines', 2: "ünï 😀 cödé", 3: "", 4: "x" * 200}
    rows = []
    for run, text in said.items():
        j = json.dumps({"first": "no", "answer": text, "last": "answer"})
        rows += [(run, k, j[i : i + 3]) for k, i in enumerate(range(0, len(j), 3))]
    rows += [rows[4], (None, 0, "x"), (4, None, "x"), (5, 0, None)]
    df = spark.createDataFrame(rows, "run long, seq long, token string")
    replay.arrive(df.where("seq IS NOT NULL"), "seq", str(tmp_path / "in"), 4)
    with replay.with_state(spark, 2):
        for start in range(2 if stop_at is not None else 1):
            stream = fields.field_deltas(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "answer")
            replay.commit_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"), after=(lambda n: n != stop_at) if start == 0 else None)
    got = {}
    for r in replay.committed(spark, str(tmp_path / "out"), fields.DELTAS).orderBy("run", "seq").collect():
        got[r.run] = got.get(r.run, "") + r.delta
    assert got == {k: v for k, v in said.items() if v}
