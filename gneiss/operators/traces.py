"""Spans of traces, rolled up by turn and by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ms(start: str, end: str):
    return F.round((F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1000.0, 1)


def turns(roots: DataFrame, spans: DataFrame) -> DataFrame:
    """(conversation, trace_id, span_id, start_time, latency_ms, had_error, span_count, breakdown) of root spans.

    roots: (trace_id, span_id, conversation, start_time, end_time, status).  spans: all spans (trace_id, span_id, name, start_time, end_time), the roots
    among them, which are left out by their id.  breakdown holds (name, count, total_ms) of a trace's children, most time first, then by name; children
    are summed by trace and name before they meet the root, so a trace of any number of spans is a few rows.  Times are added in the order of
    the spans' ids, whichever tasks hold them: another order rounds some halves of such sums the other way.  A span without an end counts and
    takes no time, one without a name is ``unknown``, one without a trace belongs to no turn.
    """
    children = spans.join(roots.select("span_id").distinct(), "span_id", "left_anti").where("trace_id IS NOT NULL")
    kids = children.select("trace_id", "span_id", "start_time", "end_time", F.coalesce("name", F.lit("unknown")).alias("name"), _ms("start_time", "end_time").alias("ms"))
    upto = Window.partitionBy("trace_id", "name").orderBy("span_id", "start_time", "end_time").rowsBetween(Window.unboundedPreceding, 0)
    summed = kids.select("trace_id", "name", F.count(F.lit(1)).over(upto).alias("nth"), F.sum("ms").over(upto).alias("sofar"))
    by = summed.groupBy("trace_id", "name").agg(F.max("nth").alias("count"), F.round(F.coalesce(F.max_by("sofar", "nth"), F.lit(0.0)), 0).alias("total_ms"))
    line = F.struct((-F.col("total_ms")).alias("less"), "name", "count", "total_ms")
    per = by.groupBy("trace_id").agg(F.sum("count").alias("span_count"), F.array_sort(F.collect_list(line)).alias("lines"))
    per = per.select("trace_id", "span_count", F.transform("lines", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"), x["total_ms"].alias("total_ms"))).alias("breakdown"))
    empty = F.array().cast("array<struct<name:string,count:bigint,total_ms:double>>")
    return roots.join(per, "trace_id", "left").select(
        "conversation", "trace_id", "span_id", "start_time", _ms("start_time", "end_time").alias("latency_ms"), F.coalesce(F.upper("status").contains("ERROR"), F.lit(False)).alias("had_error"),
        F.coalesce("span_count", F.lit(0)).alias("span_count"), F.coalesce("breakdown", empty).alias("breakdown"),
    )


def conversations(turns_: DataFrame) -> DataFrame:
    """(conversation, turn_count, last_seen, turns): the turns of a conversation, the last first.  Turns without a conversation are left out; ``unmatched``
    counts them."""
    newest = F.struct((-F.unix_micros(F.col("start_time").cast("timestamp"))).alias("at"), "trace_id", "span_id", "start_time", "latency_ms", "had_error", "span_count", "breakdown")
    by = turns_.where("conversation IS NOT NULL").groupBy("conversation").agg(F.count("*").alias("turn_count"), F.max("start_time").alias("last_seen"), F.array_sort(F.collect_list(newest)).alias("turns"))
    fields = ("trace_id", "span_id", "start_time", "latency_ms", "had_error", "span_count", "breakdown")
    return by.withColumn("turns", F.transform("turns", lambda t: F.struct(*[t[f].alias(f) for f in fields])))


def unmatched(turns_: DataFrame) -> DataFrame:
    """(total, matched, unmatched) root spans."""
    return turns_.agg(F.count("*").alias("total"), F.count("conversation").alias("matched"), F.count_if(F.col("conversation").isNull()).alias("unmatched"))
