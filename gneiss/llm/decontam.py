"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, ASCII lowered, so case and punctuation do not matter.  Documents are joined with benchmark items on
the hashes of 5-word seeds.  The words of an item under shared seeds bound its coverage; where the bound meets the threshold, greedy string
tiling runs over the item and the document's stretches around the seeds: the longest match of unmarked words is marked as a tile, again and
again, down to 5 words, matches being found by running Karp-Rabin.  Tiles may stand in any order, so reordered passages count in full.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm._store import materialise, table, tune
from gneiss.llm._words import LOWER, NOT_ALNUM, blocks, words

SEED_WORDS, COVERAGE, BLOCK_WORDS = 5, 0.5, 2_000_000
_BITS = 22
_BASE, _MOD = 1_000_003, (1 << 61) - 1


@dataclass
class Seeds:
    """The items of one block: their words as numbers, and their seeds by hash."""

    item_ids: list[int | None]
    tokens: list[np.ndarray]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    least: int

    @classmethod
    def of(cls, items: list[tuple[int | None, str]], least: int = SEED_WORDS) -> Seeds:
        ids, tokens, keys, item, place = [], [], [], [], []
        for item_id, text in items:
            h = _words(text)
            if not len(h):
                continue
            tokens.append(h)
            g = _grams(h, min(least, len(h)))
            keys.append(g)
            item.append(np.full(len(g), len(ids)))
            place.append(np.arange(len(g)))
            ids.append(item_id)
        if not ids:
            return cls([], [], *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)), least)
        keys, item, place = (np.concatenate(x) for x in (keys, item, place))
        order = np.argsort(keys, kind="stable")
        return cls(ids, tokens, keys[order], item[order], place[order], least)


def _words(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return words(b, np.array([0, len(b)]), NOT_ALNUM, LOWER).hashes()


def _grams(h: np.ndarray, m: int) -> np.ndarray:
    from gneiss.llm._words import Words

    return Words(None, h, h, h, 1).grams(m, h)


def _rolling(t: list[int], s: int) -> list[int]:
    """Karp-Rabin hashes of all runs of s numbers."""
    top, h, out = pow(_BASE, s - 1, _MOD), 0, []
    for i, x in enumerate(t):
        if i >= s:
            h = (h - t[i - s] * top) % _MOD
        h = (h * _BASE + x) % _MOD
        if i >= s - 1:
            out.append(h)
    return out


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of the tiles: again and again the longest run of unmarked words that both have, the
    earliest in pattern, then in text, where several are as long; down to ``least`` words.

    Runs are looked for by lengths s that halve from round to round.  A round lists all runs of s unmarked words or more, by their running
    hashes, and takes the longest first; what a tile has cut off one of them goes back to the list with its new length.
    """
    p_mark, t_mark, out = [False] * len(pattern), [False] * len(text), []
    s = max(least, min(len(pattern), len(text)))
    while min(len(pattern), len(text)) >= least:
        by: dict[int, list[int]] = {}
        for j, (h, free) in enumerate(zip(_rolling(text, s), _free(t_mark, s), strict=True)):
            if free:
                by.setdefault(h, []).append(j)
        heap = []
        for i, (h, free) in enumerate(zip(_rolling(pattern, s), _free(p_mark, s), strict=True)):
            for j in by.get(h, ()) if free else ():
                if i and j and pattern[i - 1] == text[j - 1] and not p_mark[i - 1] and not t_mark[j - 1]:
                    continue  # inside a longer run
                k = 0
                while i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k] and not p_mark[i + k] and not t_mark[j + k]:
                    k += 1
                if k >= s:
                    heap.append((-k, i, j))
        heapq.heapify(heap)
        while heap:
            k, i, j = heapq.heappop(heap)
            taken = [x for x in range(-k) if p_mark[i + x] or t_mark[j + x]]
            if not taken:
                p_mark[i : i - k] = t_mark[j : j - k] = [True] * -k
                out.append((i, j, -k))
                continue
            for a, b in zip([-1, *taken], [*taken, -k], strict=True):
                if b - a - 1 >= s:
                    heapq.heappush(heap, (a + 1 - b, i + a + 1, j + a + 1))
        if s == least:
            break
        s = max(least, s // 2)
    return out


def _free(mark: list[bool], s: int) -> list[bool]:
    n, out = 0, []
    for i, m in enumerate(mark):
        n = 0 if m else n + 1
        if i >= s - 1:
            out.append(n >= s)
    return out


def _doc_matches(h: np.ndarray, hits: np.ndarray, seeds: Seeds, sizes: dict[int, np.ndarray], coverage: float) -> list[tuple[int, float, int, int]]:
    """(item, coverage, tiles, longest) of a document's items that meet the threshold; hits: places of its runs that are seeds."""
    by: dict[int, tuple[set, set]] = {}
    for m, grams in sizes.items():
        for p in hits[m].tolist():
            lo, hi = np.searchsorted(seeds.keys, grams[p], "left"), np.searchsorted(seeds.keys, grams[p], "right")
            for k in range(lo, hi):
                i = int(seeds.item[k])
                if min(seeds.least, len(seeds.tokens[i])) != m:
                    continue
                a, b = by.setdefault(i, (set(), set()))
                a.update(range(seeds.place[k], seeds.place[k] + m))
                b.update(range(p, p + m))
    out = []
    for i, (a, b) in sorted(by.items()):
        item = seeds.tokens[i]
        if len(a) < coverage * len(item):
            continue
        at = np.array(sorted(b))
        # stretches of the document under seeds, apart by a number that no word has
        text, last = [], None
        for p in at.tolist():
            if last is not None and p != last + 1:
                text.append(-1)
            text.append(int(h[p]) >> 3)
            last = p
        found = tiles([int(x) >> 3 for x in item], text, min(seeds.least, len(item)))
        share = sum(k for _, _, k in found) / len(item)
        if share >= coverage:
            out.append((i, share, len(found), found[0][2]))
    return out


def _match(texts: pa.Array, seeds: Seeds, coverage: float) -> list[list[tuple[int, float, int, int]]]:
    out: list[list] = [[] for _ in range(len(texts))]
    if not seeds.item_ids:
        return out
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(seeds.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    lengths = sorted({min(seeds.least, len(t)) for t in seeds.tokens})
    for first, _, data, offsets in blocks(texts):
        w = words(data, offsets, NOT_ALNUM, LOWER)
        h = w.hashes()
        hit_of = {}
        for m in lengths:
            g = w.grams(m, h)
            at = np.flatnonzero(bitmap[(g & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            at = at[w.doc[at] == w.doc[at + m - 1]]
            k = np.searchsorted(seeds.keys, g[at])
            ok = seeds.keys[np.minimum(k, len(seeds.keys) - 1)] == g[at]
            hit_of[m] = (at[ok], g)
        for d in np.unique(np.concatenate([w.doc[at] for at, _ in hit_of.values()])).tolist():
            lo, hi = np.searchsorted(w.doc, [d, d + 1])
            hits = {m: at[(at >= lo) & (at < hi)] - lo for m, (at, _) in hit_of.items()}
            out[first + d] = _doc_matches(h[lo:hi], hits, seeds, {m: g[lo:hi] for m, (_, g) in hit_of.items()}, coverage)
    return out


def matches(text: Column, seeds: Seeds, coverage: float = COVERAGE) -> Column:
    """Array of (item_id, coverage, tiles, longest) of the benchmark items found in the text, the best covered first."""

    @F.arrow_udf("array<struct<item_id:long,coverage:double,tiles:int,longest:int>>")
    def run(texts: pa.Array) -> pa.Array:
        got = _match(texts, seeds, coverage)
        ids = seeds.item_ids
        rows = [[{"item_id": ids[i], "coverage": c, "tiles": n, "longest": k} for i, c, n, k in sorted(g, key=lambda x: (-x[1], ids[x[0]] is None, ids[x[0]] or 0))] for g in got]
        return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())])))

    return run(text)


_FOUND = "array<struct<item_id:long,coverage:double,tiles:int,longest:int>>"


def blocks_of(benchmark: DataFrame, least: int = SEED_WORDS, most: int = BLOCK_WORDS) -> Iterator[Seeds]:
    """Seeds of the benchmark's items, in blocks of about ``most`` words, so what the driver holds and the executors get is bounded.
    The words are counted first; items are dealt to as many blocks by a hash, and one block is read at a time."""
    items = benchmark.select("item_id", "text").where("text is not null")
    n = items.agg(F.sum(F.length("text") / 5 + 1)).first()[0] or 0
    parts = int(-(-n // most))
    for k in range(parts):
        block = Seeds.of([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()], least)
        if block.item_ids:
            yield block


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = SEED_WORDS, most: int = BLOCK_WORDS) -> DataFrame:
    """docs with ``__found``: the items of the benchmark (item_id, text) of which at least ``coverage`` of the words is tiled, the best
    covered first, then by item_id, null last.

    Null, empty and wordless texts match nothing, and so do such items.  An item below ``least`` words must occur as a whole.
    A benchmark of one block is one projection of docs.  A larger one is a pass over docs for each block, whose matches are written as
    (hash of the text, item), and are then joined to docs; driver and executors hold one block at a time.  An empty benchmark
    finds nothing.  A column named __found is replaced; __text is used and left out again.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("__found", "__text")
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    held, before = [], None
    for block in blocks_of(benchmark, least, most):
        if before is not None:
            held.append(_written(docs, key, before, coverage))
        before = block
    if before is None:
        return docs.withColumn("__found", F.array().cast(_FOUND))
    if not held:
        return docs.withColumn("__found", matches(F.col("text"), before, coverage))
    held.append(_written(docs, key, before, coverage))
    order = lambda a, b: (
        F.when(a["coverage"] > b["coverage"], -1).when(a["coverage"] < b["coverage"], 1).when(a["item_id"].isNull() & b["item_id"].isNull(), 0).when(b["item_id"].isNull() | (a["item_id"] < b["item_id"]), -1)
        .when(a["item_id"].isNull() | (a["item_id"] > b["item_id"]), 1).otherwise(0)
    )
    rows = held[0]
    for x in held[1:]:
        rows = rows.unionByName(x)
    whole = rows.groupBy("__text").agg(F.array_sort(F.flatten(F.collect_list("found")), order).alias("__found"))  # one array a block
    return docs.withColumn("__text", key).join(whole, "__text", "left").drop("__text").withColumn("__found", F.coalesce("__found", F.array().cast(_FOUND)))


def _written(docs: DataFrame, key: Column, block: Seeds, coverage: float) -> DataFrame:
    """(__text, found) of the texts with items of one block."""
    got = docs.select(key.alias("__text"), matches(F.col("text"), block, coverage).alias("found")).where(F.size("found") > 0)
    return materialise(got.dropDuplicates(["__text"]), "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = SEED_WORDS) -> DataFrame:
    """docs without those that hold a benchmark item."""
    return find(docs, benchmark, coverage, least).where(F.size("__found") == 0).select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document holds a benchmark item, how many, and the best covered one."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    first = F.get("__found", F.lit(0))
    return found.withColumn("__first", first).select("doc_id", (F.size("__found") > 0).alias("contaminated"), F.size("__found").alias("n_items"), "__first.item_id", "__first.coverage", F.col("__first.tiles").alias("n_tiles"), F.col("__first.longest").alias("longest_tile"))
