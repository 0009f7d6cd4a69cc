"""Queries that read their tables as streams, in several micro-batches, with the SQL of what they give in the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.plans.registry import Registry
from gneiss.plans.sql import ORACLE
from gneiss.sources.tables import table
from gneiss.streaming import deferred, fields, replay, snapshots

registry = Registry()


def _through(s, df, order: str, made, schema: str, parts: int = 4):
    """What a stream over df gives: its rows arrive in files by ``order``, one to a micro-batch; the result is what was committed."""
    folder = replay.new_folder(s, "stream")
    replay.arrive(df, order, f"{folder}/in", parts)
    with replay.with_state(s):
        replay.commit_batches(made(s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/check")
    return replay.committed(s, f"{folder}/out", schema)


def _states(s, d):
    """Users as jobs: signed up they are queued, a purchase ends them, an error ends every third."""
    e = table(s, d, "events")
    status = F.when(F.col("event_type") == "signup", "queued").when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), "done").when((F.col("event_type") == "error") & (F.col("event_id") % 11 == 0), "failed").otherwise("running")
    return e.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.when(F.col("value") > 20, "bulk").otherwise("light").alias("phase"))


@registry.query("""WITH s AS (SELECT event_id, user_id AS job_id, ts, CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'done' WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN value > 20 THEN 'bulk' ELSE 'light' END AS phase FROM events),
o AS (SELECT *, coalesce(max(CASE WHEN status IN ('done', 'failed', 'cancelled') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s),
l AS (SELECT *, lag(status) OVER w AS s0, lag(phase) OVER w AS p0, lead(ts) OVER w AS next FROM o WHERE over = 0 WINDOW w AS (PARTITION BY job_id ORDER BY event_id)),
e AS (SELECT *, coalesce(epoch_us(next) // 1000 - 1, (SELECT epoch_us(max(ts) - INTERVAL 1 HOUR) // 1000 FROM s)) AS upto FROM l WHERE status NOT IN ('done', 'failed', 'cancelled'))
SELECT job_id, event_id, ts, 'job' AS kind, status, phase FROM l WHERE s0 IS NULL OR s0 <> status OR p0 <> phase
UNION ALL SELECT job_id, event_id, ts, 'done', status, phase FROM l WHERE status IN ('done', 'failed', 'cancelled')
UNION ALL SELECT job_id, event_id, make_timestamp_ms(unnest(range(epoch_us(ts) // 1000 + 172800000, upto + 1, 172800000))), 'alive', status, phase FROM e""")
def job_changes(s, d):
    """What a watcher of all jobs is told, with a sign of life after two days of silence."""
    return _through(s, _states(s, d), "event_id", lambda x: snapshots.changes(x, "48 hours"), snapshots.CHANGES)


def _work(s, d):
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "answer").otherwise("ask")
    return e.where("event_type in ('view', 'click', 'purchase')").select("event_id", F.col("user_id").alias("scope"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("event_type").alias("work"))


@registry.query("""WITH w AS (SELECT event_id, user_id AS scope, ts, event_type = 'purchase' AS answer FROM events WHERE event_type IN ('view', 'click', 'purchase')),
a AS (SELECT q.scope, q.event_id, epoch_us(q.ts) // 1000 + 21600000 AS until, (SELECT min((r.ts, r.event_id)) FROM w r WHERE r.answer AND r.scope = q.scope AND (r.ts, r.event_id) > (q.ts, q.event_id)) AS got FROM w q WHERE NOT q.answer)
SELECT scope, event_id, 'delivered' AS outcome, got[1] AS at FROM a WHERE epoch_us(got[1]) // 1000 <= until
UNION ALL SELECT scope, event_id, 'dropped', make_timestamp_ms(until) FROM a WHERE (got IS NULL OR epoch_us(got[1]) // 1000 > until)
  AND (until <= (SELECT epoch_us(max(ts) - INTERVAL 1 HOUR) // 1000 FROM w) OR EXISTS (SELECT 1 FROM w r WHERE r.scope = a.scope AND epoch_us(r.ts) // 1000 > until))""")
def deferred_outcomes(s, d):
    """Views and clicks wait six hours for a purchase of the user."""
    return _through(s, _work(s, d), "event_id", lambda x: deferred.outcomes(x, "6 hours", None, False), deferred.OUTCOMES)


@registry.query("""SELECT a.user_id AS scope, a.event_id, a.ts AS asked_at, b.ts AS answered_at FROM events a LEFT JOIN events b ON b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click'""")
def answered_within(s, d):
    w = _work(s, d)
    return deferred.answered(w.where("work = 'click'"), w.where("work = 'purchase'"), "2 hours")


@registry.query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def committed_batches(s, d):
    """Events through a sink that writes each micro-batch under its number, summed up from what was committed."""
    e = table(s, d, "events").select("event_id", "event_type", "value")
    return _through(s, e, "event_id", lambda x: x, e.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@registry.query(ORACLE["field_stream"])
def field_stream_live(s, d):
    """Every turn as a JSON object that arrives in pieces of seven characters, over several micro-batches, decoded as it comes."""
    c = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("run"), F.to_json(F.struct("role", F.col("text").alias("final_response"))).alias("j"))
    tokens = c.select("run", F.posexplode(F.regexp_extract_all("j", F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "token")).withColumn("seq", F.col("seq").cast("long"))
    said = _through(s, tokens, "seq", lambda x: fields.field_deltas(x, "final_response"), fields.DELTAS)
    whole = said.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("p")).select("run", F.array_join(F.transform("p", lambda x: x["delta"]), "").alias("t"))
    return tokens.select("run").distinct().join(whole, "run", "left").select("run", F.md5(F.coalesce("t", F.lit(""))).alias("field"))
