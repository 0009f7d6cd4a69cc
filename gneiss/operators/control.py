"""Decisions about runs and jobs: reviews, leases, token streams, uploads."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS, REVIEWS, GAIN, LEASE = 45, 3, 5, 180
TERMINAL = ["succeeded", "failed", "cancelled"]


def review(attempts: DataFrame, by: str, order: str, score: str, enough: float = PASS, most: int = REVIEWS, gain: float = GAIN) -> DataFrame:
    """attempts with route: end for a score that passes, for the last review allowed, or without enough gain; else supervisor."""
    w = Window.partitionBy(by).orderBy(order)
    n, before = F.row_number().over(w), F.lag(score).over(w)
    route = F.when(F.col(score) >= enough, "passed").when(n >= most, "review_limit").when(F.col(score) - before < gain, "plateau").otherwise("supervisor")
    return attempts.withColumn("review", n.cast("long")).withColumn("route", route)


def reclaim(jobs: DataFrame, now: Column, lease: int = LEASE) -> DataFrame:
    """jobs (status, heartbeat) with claimed or running ones queued again once their lease has run out."""
    gone = F.col("status").isin("claimed", "running") & (F.col("heartbeat").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("heartbeat") > lease))
    return jobs.withColumn("reclaimed", gone).withColumn("status", F.when(gone, "queued").otherwise(F.col("status")))


def may_cancel(status: Column) -> Column:
    """What a request to cancel does: a queued job ends at once, a running one when it next looks, a finished one stays."""
    return F.when(status.isin(TERMINAL), status).when(status == "queued", "cancelled").otherwise("cancelling")


class FieldReader:
    """Decodes one string field of a JSON object that arrives in pieces.  Only what is not decoded yet is kept."""

    _piece = re.compile(r'[^"\\]+|\\u[0-9a-fA-F]{4}|\\u.{4}|\\[^u]', re.S)
    # Halves of characters outside the basic plane, escaped one by one: a half alone is no character.
    _half, _low, _begun = re.compile(r"\\u[dD]([89a-fA-F])[0-9a-fA-F]{2}$"), re.compile(r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"), re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3})?)?")
    # Fixed values.
    _plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def __init__(self, field: str, rest: str = "", phase: int = 0):
        self.opening, self.rest, self.phase = re.compile(f'"{re.escape(field)}"\\s*:\\s*"'), rest, phase

    def feed(self, piece: str | None) -> str:
        if self.phase == 2 or not piece:
            return ""
        self.rest += piece
        if self.phase == 0:
            if not (m := self.opening.search(self.rest)):
                return ""
            self.phase, self.rest = 1, self.rest[m.end() :]
        out, at = [], 0
        while m := self._piece.match(self.rest, at):
            x = m[0]
            if self._half.match(x):
                after = self.rest[m.end() : m.end() + 6]
                if self._begun.fullmatch(after):
                    break  # the other half may still come
                pair = bytes.fromhex(x[2:] + after[2:]).decode("utf-16-be", "replace") if self._half.match(x)[1].lower() in "89ab" and self._low.match(after) else None
                out.append(pair or "\ufffd")
                at = m.end() + (6 if pair else 0)
                continue
            at = m.end()
            if x[0] != "\\":
                out.append(x)
            elif x[1] != "u":
                out.append(self._plain.get(x[1], x[1]))
            else:
                try:
                    out.append(chr(int(x[2:], 16)))
                except ValueError:
                    out.append(x)
        self.rest = self.rest[at:]
        if self.rest.startswith('"'):
            self.phase, self.rest = 2, ""
        return "".join(out)


def field_deltas(tokens: DataFrame, field: str) -> DataFrame:
    """(run, seq, delta) of tokens (run, seq, token): what each token adds to a JSON field.  A run is read in order with one
    reader in hand, so a long run does not have to fit into memory."""

    def run(batches):
        at, reader = None, None
        for p in batches:
            out = []
            for r, t in zip(p["run"], p["token"], strict=True):
                if reader is None or r != at:
                    at, reader = r, FieldReader(field)
                out.append(reader.feed(t))
            yield pd.DataFrame({"run": p["run"], "seq": p["seq"], "delta": out})

    kinds = dict(tokens.dtypes)
    return tokens.select("run", "seq", "token").repartition("run").sortWithinPartitions("run", "seq").mapInPandas(run, f"run {kinds['run']}, seq {kinds['seq']}, delta string")


def upload_reason(suffix: Column, size: Column, cap: Column, number: Column, most: int = 10) -> Column:
    """Why an upload is refused; empty if it is taken.  cap is null for types that are not supported."""
    return F.when(number > most, "too_many_files").when(cap.isNull(), "unsupported_media_type").when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(size > cap, "file_too_large").otherwise("")


def conversation_of(attributes: Column) -> Column:
    """The conversation of a span, from a map of its attributes: a plain attribute, else one in JSON metadata, else a tag."""
    some = lambda c: F.nullif(c, F.lit(""))
    a = lambda k: F.try_element_at(attributes, F.lit(k))
    tag = F.regexp_extract(F.coalesce(a("attributes.tag.tags"), F.lit("")), r'(?:^|[\[",\s])conversation:([^",\]\s]+)', 1)
    return F.coalesce(some(a("attributes.metadata.conversation_id")), some(F.get_json_object(a("attributes.metadata"), "$.conversation_id")), some(a("metadata.conversation_id")), some(tag))


def token_budget(source: Column, chars_per_token: float = 3.0, headroom: float = 1.35, least: int = 4096, most: int = 32768) -> Column:
    """Tokens to allow for rewriting a source, within bounds."""
    return F.greatest(F.lit(least), F.least((F.length(source) / chars_per_token * headroom).cast("int"), F.lit(most)))


def truncated(source: Column, result: Column, least: float = 0.6) -> Column:
    """A rewritten source that is suspiciously shorter than the first."""
    return F.length(F.coalesce(result, F.lit(""))) < least * F.length(F.coalesce(source, F.lit("")))
