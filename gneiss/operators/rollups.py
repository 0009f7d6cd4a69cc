"""Rollups of corpora, jobs, runs and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEASE, STALE = 180, 20


def corpus_stats(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source, documents, chunks, vectors) per scope; scopes without any count 0."""
    v = vectors.select("doc_id", F.lit(1).alias("v")).distinct()
    return docs.join(v, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.length("text") > 0).alias("chunks"), F.count("v").alias("vectors"))


def with_status(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """docs with status: failed without text, indexed with a vector, else degraded."""
    v = vectors.select("doc_id", F.lit(True).alias("__v")).distinct()
    bad = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    return docs.join(v, "doc_id", "left").withColumn("status", F.when(bad, "failed").when(F.col("__v"), "indexed").otherwise("degraded")).drop("__v")


def missing_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    return docs.join(vectors.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


def last_rows(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The n rows of each group with the largest order value."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")


def keyset_page(df: DataFrame, key: str, after: int, n: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def telemetry(events: DataFrame) -> DataFrame:
    """(user_id, event_type, spans, total_ms, last_seen, errors) per run and span name."""
    ms = F.round(F.sum("value"), 4)
    by = events.groupBy("user_id", "event_type").agg(F.count("*").alias("spans"), ms.alias("total_ms"), F.max("ts").alias("last_seen"))
    runs = events.groupBy("user_id").agg(F.max((F.col("event_type") == "error").cast("int")).alias("errors"))
    return by.join(runs, "user_id")


def expired(heartbeats: DataFrame, lease: int = LEASE) -> DataFrame:
    """(user_id, last_seen, expired): workers whose last beat lies more than a lease before the newest one, by real time."""
    last = heartbeats.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    now = heartbeats.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("user_id", "last_seen", ((F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1e6 > lease).alias("expired"))  # now is one row


def plateau(scores: DataFrame, by: str, order: str, value: str, least: float) -> DataFrame:
    """scores with gain over the previous attempt and whether it is below ``least``."""
    gain = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return scores.withColumn("gain", gain).withColumn("plateaued", F.coalesce(F.col("gain") < least, F.lit(False)))


def best_attempt(attempts: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The attempt with the highest value of each run; the earliest on ties."""
    w = Window.partitionBy(by).orderBy(F.desc(value), order)
    return attempts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def stagnation(steps: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, longest): the longest run of steps in which the value does not change."""
    w = Window.partitionBy(by).orderBy(order)
    flag = steps.withColumn("__new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1)))
    island = flag.withColumn("__i", F.sum("__new").over(w)).groupBy(by, "__i").agg(F.count("*").alias("n"))
    return island.groupBy(by).agg(F.max("n").alias("longest"))


def dispatch(tasks: DataFrame, known: list[str], cap: int = 8, capped: dict[str, int] | None = None) -> DataFrame:
    """tasks (run, step, agent, payload) with a decision: each agent's distinct tasks up to its cap of a run, in order."""
    caps = {"retriever": 2} if capped is None else capped
    first = F.row_number().over(Window.partitionBy("run", "agent", "payload").orderBy("step")) == 1
    tagged = tasks.withColumn("__ok", F.col("agent").isin(known)).withColumn("__first", first)
    n = F.sum((F.col("__ok") & F.col("__first")).cast("int")).over(Window.partitionBy("run", "agent").orderBy("step"))
    limit = F.lit(cap)
    for a, k in caps.items():
        limit = F.when(F.col("agent") == a, k).otherwise(limit)
    why = F.when(~F.col("__ok"), "unknown_agent").when(~F.col("__first"), "duplicate").when(n > limit, "over_budget").otherwise("dispatched")
    return tagged.withColumn("decision", why).drop("__ok", "__first")


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, event_type, value, ts): the last value of each field of a job, from its event log."""
    best = F.max(F.struct("ts", "event_id", "value")).alias("m")
    return events.groupBy("user_id", "event_type").agg(best).select("user_id", "event_type", F.col("m.value").alias("value"), F.col("m.ts").alias("ts"))


def progress(events: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(user_id, progress): the weighted share of phases seen, at most 99.5 until all are done."""
    w = F.lit(0.0)
    for k, x in weights.items():
        w = F.when(F.col("event_type") == k, x).otherwise(w)
    done = events.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.sum(w).alias("done"))
    return done.select("user_id", F.least(F.lit(99.5), F.round(100 * F.col("done") / sum(weights.values()), 1)).alias("progress"))
