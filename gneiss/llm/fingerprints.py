"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks where chunks may end: a strict mask before the usual length, a loose one after it, so
lengths stay near it (normalised chunking).  Boundaries depend on near bytes only, so an insertion shifts them but changes few
chunks.  The fingerprint is the set of chunk digests with their lengths; containment is the share of a text's bytes, counted once
per distinct chunk, whose chunks the other text has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm._store import table, tune
from gneiss.llm._words import mix

LEAST, USUAL, MOST, PART_ROWS = 32, 64, 256, 20_000
_STRICT, _LOOSE = np.uint32(0b111111111 << 23), np.uint32(0b111 << 29)  # about one place in 512 and in 8
_GEAR = (mix(np.arange(11, 267, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_PIECE = 1 << 20


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a chunk may end under the strict and under the loose mask."""
    strict, loose = [], []
    for at in range(0, len(data), _PIECE):
        lead = min(at, 31)
        h = _GEAR[data[at - lead : at + _PIECE]]
        for k in (1, 2, 4, 8, 16):  # h over 2k bytes from h over k bytes
            g = h.copy()
            g[k:] += h[:-k] << np.uint32(k)
            h = g
        h = h[lead:]
        at_loose = np.flatnonzero((h & _LOOSE) == 0)
        loose.append(at_loose + at + 1)
        strict.append(at_loose[(h[at_loose] & _STRICT) == 0] + at + 1)
    return np.concatenate(strict), np.concatenate(loose)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    strict, loose = _marks(np.frombuffer(data, np.uint8))
    strict, loose = strict.tolist(), loose.tolist()
    out, start, i, j, ns, nl = [], 0, 0, 0, len(strict), len(loose)
    while n - start > LEAST:
        low, mid, high = start + LEAST, start + USUAL, start + MOST
        while i < ns and strict[i] < low:
            i += 1
        if i < ns and strict[i] < mid:
            end = strict[i]
        else:
            while j < nl and loose[j] < mid:
                j += 1
            end = loose[j] if j < nl and loose[j] < high else high
        if end >= n:
            break
        out.append(end)
        start = end
    return [*out, n]


def fingerprint_of(text: bytes) -> dict[int, int]:
    """Length by digest of each distinct chunk, in order of appearance."""
    out, start = {}, 0
    for end in cuts(text):
        out[xxhash.xxh3_64_intdigest(text[start:end])] = end - start
        start = end
    return out


def written(fp: dict[int, int]) -> str:
    """20 hexadecimal digits a chunk: 16 of the digest, 4 of the length; digests ascend, so equal sets are equal strings."""
    return b"".join(b"%016x%04x" % x for x in sorted(fp.items())).decode()


def read(fp: str) -> dict[int, int]:
    return {int(fp[i : i + 16], 16): int(fp[i + 16 : i + 20], 16) for i in range(0, len(fp), 20)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes in chunks that b has: 1 for equal sets, also two empty ones; 0 if just one is empty."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprint(text: Column) -> Column:
    """The fingerprint of the whole text as a string; empty for null and empty texts."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([written(fingerprint_of(x.encode() if x else b"")) for x in texts.to_pylist()], pa.string())

    return run(text)


def contained(a: Column, b: Column) -> Column:
    """Containment of fingerprint a in fingerprint b."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([containment(read(p or ""), read(q or "")) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(a, b)


def with_next(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """docs (doc_id, text) dealt to ranges of descending ids and sorted; each range ends with the first rows of the next one,
    marked as guests, and the last with those of the first, so every row's successor follows it in its task.

    Ties in doc_id go by text; null ids come last.  Texts are exchanged once.
    """
    n = docs.count()
    parts = max(1, -(-n // part_rows))
    bounds = sorted(set(docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    last = len(bounds) + 1  # null ids
    at = np.array(bounds)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        near = np.searchsorted(at, ids.fillna(0).to_numpy().astype("float64"), side="right")
        return pd.Series(np.where(ids.isna(), last, len(at) - near).astype("int32"))

    placed = docs.select("doc_id", "text", part("doc_id").alias("part"))
    heads = {r["part"]: r["top"] for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first part's head is a guest of the last
    # (part, head, host) as sorted literals: one per range of part_rows rows
    tops = np.array([heads[p] if heads[p] is not None else 0 for p in order], dtype=np.int64)
    hosts = np.array([before[p] for p in order], dtype=np.int32)
    known = np.array(order, dtype=np.int32)

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series, own: pd.Series) -> pd.Series:
        at = np.searchsorted(known, own.to_numpy())
        top = ids.isna().to_numpy() | (ids.fillna(0).to_numpy().astype("int64") == tops[at])
        top &= (own.to_numpy() != last) | ids.isna().to_numpy()
        return pd.Series([[int(p), int(-1 - hosts[i])] if t else [int(p)] for p, i, t in zip(own, at, top, strict=True)])

    dealt = placed.withColumn("target", F.explode(targets("doc_id", "part"))).withColumn("guest", F.col("target") < 0)
    dealt = dealt.withColumn("host", F.when(F.col("guest"), -1 - F.col("target")).otherwise(F.col("target")))
    return dealt.select("doc_id", "text", "guest", "host").repartitionById(max(1, len(bounds) + 2), F.col("host")).sortWithinPartitions("host", "guest", F.desc_nulls_last("doc_id"), "text")


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how far the document is contained in it and in the next one."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
        rows: list[tuple] = []
        held, done = None, False

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
            rows.clear()
            return out

        for batch in batches:
            ids, texts, guests, hosts = (batch.column(i).to_pylist() for i in range(4))
            for doc_id, text, guest, host in zip(ids, texts, guests, hosts, strict=True):
                text = text or ""
                if held is not None and host != held[3]:
                    held, done = None, False
                if done:
                    continue  # further guests with the same id
                fp = fingerprint_of(text.encode())
                if held is not None:
                    own_id, own, own_fp, _ = held
                    new = edited(own, text).encode()
                    new_fp = fingerprint_of(new)
                    rows.append((own_id, len(own), hashlib.sha256(new).hexdigest(), written(own_fp), written(new_fp), containment(own_fp, new_fp), containment(own_fp, fp)))
                    if len(rows) >= 256:
                        yield flush()
                held, done = (doc_id, text, fp, host), guest
        if rows:
            yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, schema)
