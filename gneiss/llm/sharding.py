"""Sharding by histogram sort.

Documents are ordered by (hash of the text, id) and cut into shards of nearly equal bytes.  Probes between the smallest and
the largest key are counted exactly, across all partitions: how many bytes and rows lie below each.  Every splitter keeps
the bracket of probes around its target, and the next round probes inside the brackets, until a splitter meets the tolerance or
its bracket holds a single key.  Only then are the rows exchanged, once.  Equal texts are neighbours in the order, so a
group of copies shares a shard unless a splitter has to fall inside it, which equal sizes demand of a large group.  Where a
splitter has to fall inside rows equal in id and text, all rows are written with a number of their own first, which is then part of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm._store import discard, keeps, materialise, table, tune

PROBES, TOLERANCE, PART_BYTES, OVERHEAD = 24, 0.002, 256 << 20, 8
#: Probes and tolerance, as a share of a part, of cuts inside a shard: they only bound what a task sorts.
INNER_PROBES, INNER_TOLERANCE = 3, 0.25


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8 (none for null) and 8 more for its frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def _key(*parts: Column) -> Column:
    """8 bytes for each long, that sort as the longs do; a null sorts first."""
    flip = lambda c: F.unhex(F.lpad(F.hex(F.coalesce(c, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(*map(flip, parts))


def _at(keys: pd.Series, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, np.array(keys.tolist(), dtype=cuts.dtype), side="right") if len(keys) else np.zeros(0, int)


def _bytes(keys: list[int], width: int) -> np.ndarray:
    return np.array([k.to_bytes(width, "big") for k in keys], dtype=f"S{width}")


def histogram(slim: DataFrame, cuts: list[int], width: int = 16) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Bytes and rows of the keys between cuts, and the smallest and largest key of each bucket that has any; a key equal to a cut
    lies above it.  One row per bucket and task is shuffled, and one per bucket collected."""
    at = _bytes(cuts, width)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["bucket"] = _at(p["key"], at)
            yield p.groupby("bucket", as_index=False).agg(bytes=("size", "sum"), rows=("size", "size"), low=("key", "min"), high=("key", "max"))

    got = slim.mapInPandas(count, "bucket long, bytes long, rows long, low binary, high binary").groupBy("bucket").agg(F.sum("bytes"), F.sum("rows"), F.min("low"), F.max("high")).collect()
    size, rows, ends = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64), {}
    number = lambda key: int.from_bytes(bytes(key), "big")
    for bucket, n_bytes, n, low, high in got:
        size[bucket], rows[bucket], ends[bucket] = n_bytes, n, (number(low), number(high))
    return size, rows, ends


def splitters(slim: DataFrame, parts: int, each: int = 1, tolerance: float = TOLERANCE, probes: int = PROBES, width: int = 16, count=histogram) -> tuple[list[int], np.ndarray, bool]:
    """parts-1 keys that cut slim (key binary, size long) into parts of nearly equal size, the rows of each part, and whether a splitter
    between two shards, of ``each`` parts, missed its target because a single key holds more than the tolerance.

    Such a splitter lies within tolerance (a share of a part) of its target, or at the row boundary nearest to it; splitters inside a
    shard within INNER_TOLERANCE.  Driver work is in proportion to parts, but for sorting: the probes of a round are counted
    together, and each splitter finds its bracket by binary search in their cumulative bytes.
    """
    size, rows, ends = count(slim, [], width)
    if not ends:
        return [], np.zeros(parts, np.int64), False
    total, (low, high) = int(size[0]), ends[0]
    cut, stuck = [0] * (parts - 1), False
    outer = [(j + 1) % each == 0 for j in range(parts - 1)]
    # keys begin with a hash, so the first probes stand around each target's share of their range
    todo = {}
    for j in range(parts - 1):
        n = probes if outer[j] else INNER_PROBES
        mid, step = low + (high - low) * (j + 1) // parts, max((high - low) // (parts * n), 1)
        todo[j] = [mid + (2 * i - n + 1) * step // 2 for i in range(n)]
    while todo:
        tried = sorted({min(max(p, low), high + 1) for ps in todo.values() for p in ps})
        size, _, ends = count(slim, tried, width)
        below = np.concatenate([[0], np.cumsum(size)])  # bytes under each bucket
        goals = np.array([total * (j + 1) / parts for j in todo])
        bucket = np.searchsorted(below[1:-1], goals, side="right")  # that holds the target
        done = {}
        for j, goal, k in zip(todo, goals.tolist(), bucket.tolist(), strict=True):
            near = min((int(below[k]), tried[k - 1] if k else low), (int(below[k + 1]), tried[k] if k < len(tried) else high + 1), key=lambda e: (abs(e[0] - goal), e[1]))
            miss = abs(near[0] - goal) > (tolerance if outer[j] else INNER_TOLERANCE) * total / parts
            if not miss or k not in ends or ends[k][0] == ends[k][1]:
                cut[j] = near[1]
                stuck |= miss and outer[j]
                continue
            lo, hi = ends[k]
            done[j] = [lo, *(lo + 1 + (hi - lo) * i // probes for i in range(probes)), hi + 1]
        todo = done
    cut.sort()
    return cut, count(slim, cut, width)[1], stuck


@keeps("__key", "__part", "__n", "__row")
def shard(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard).

    Law ``bytes``: the sizes of shards differ by the tolerance or by single rows.  A null id sorts as the smallest, a null
    text is hashed as a value of its own with size 8.  An empty table gives an empty result.  A shard over part_bytes is sorted in
    several tasks.  Rows equal in id and text stay together unless they are more than a shard can take.  Columns named shard or slot
    are replaced, all others come back as they are.
    """
    return _shard(docs, shards, tolerance, part_bytes, id_col, text_col)


def _shard(docs: DataFrame, shards: int, tolerance: float, part_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """shard() of docs without the columns that it uses; __row tells equal rows apart where it is given."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("shard", "slot")
    longs = [F.xxhash64(text_col), F.col(id_col).cast("long"), *([F.col("__row")] if "__row" in docs.columns else [])]
    key, width = _key(*longs), 8 * len(longs)
    slim = materialise(docs.select(key.alias("key"), size_of(F.col(text_col)).alias("size")), "shard-keys")
    total = slim.agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-total // (shards * part_bytes)))
    cuts, rows, stuck = splitters(slim, shards * each, each, tolerance, width=width)
    discard(slim)
    if stuck and width == 16:
        numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # read twice, so written once
        return _shard(numbered, shards, tolerance, part_bytes, id_col, text_col)
    at = _bytes(cuts, width)

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series(_at(keys, at).astype("int32"))

    before = [int(rows[p - p % each : p].sum()) for p in range(shards * each)]
    placed = docs.withColumn("__key", key).withColumn("__part", part("__key")).repartitionById(shards * each, F.col("__part"))
    order = Window.partitionBy("__part").orderBy("__key", *([F.col(text_col)] if text_col in docs.columns else []))
    start = F.element_at(F.split(F.lit(",".join(map(str, before))), ",").cast("array<long>"), F.col("__part") + 1)
    return placed.withColumn("__n", F.row_number().over(order)).select("*", F.floor(F.col("__part") / each).cast("int").alias("shard"), (start + F.col("__n") - 1).alias("slot")).drop("__key", "__part", "__n", "__row")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
