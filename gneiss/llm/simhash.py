"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt to partitions so that correlated bits share one.  If two fingerprints differ in at most R bits and the
thresholds t_i of m partitions add up to R - m + 1, then in some partition they differ in at most t_i bits.  The thresholds are
unequal: dynamic programming gives them so that the expected cost of probes and candidates, estimated from counts over all
fingerprints, is least; -1 leaves a partition out.  Each fingerprint is a base under its own value in each partition and a probe under
the values within t_i; bases meet all rows of their bucket and are verified on all 64 bits.  Only links that join two parts of
a bucket are emitted, so a bucket of n rows gives fewer than n, never all pairs.

The near copies of the pipeline (deduplicate) are compared by exact Jaccard similarity.  Their candidates are found by these fingerprints,
and by MinHash bands what lies beyond: at 0.8 the fingerprints differ in too many bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm._components import components
from gneiss.llm._store import materialise, table, tune
from gneiss.llm._words import LOWER, mix

SEED, WIDTH, BITS, HOT = 42, 4, 4, 20_000
#: Costs of the plan: a row that is dealt to a bucket, and a comparison within one.
ROW_COST, PAIR_COST = 1.0, 0.001
#: Of the near copies of the pipeline: bands of minima, minima in each, and rows of a block of a large group.
BANDS, ROWS, BLOCK = 64, 6, 2_000
_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_LOWER = bytes(LOWER)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each run of width words, A-Z lowered, repeats included; of all words where there are fewer; none without words."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), np.uint64)


def fingerprint_of(h: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), len(h)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """The 64-bit fingerprint as a signed long; zero for null, empty and blank texts."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(shingle_hashes(x, width)) for x in texts.to_pylist()], np.uint64).view(np.int64))

    return run(text)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Fingerprints, and in how many bits i and j are both set; at most 4096 numbers are collected."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((64, 64))
        for p in parts:
            for i in range(0, len(p), 1 << 14):
                x = np.unpackbits(p["fp"].to_numpy()[i : i + (1 << 14)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                both += x.T @ x
        at = np.nonzero(both)
        yield pd.DataFrame({"i": at[0], "j": at[1], "n": both[at].astype("int64")})

    both = np.zeros((64, 64))
    for r in fps.select("fp").mapInPandas(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = r["n"]
    return fps.count(), both


def arrange(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits (0 is the highest) of m partitions of nearly equal width; a bit goes where it is most correlated."""
    p = both.diagonal() / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev))
    left, parts = list(range(64)), []
    for k in range(m):
        width = -(-len(left) // (m - k))
        mine = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(mine[0])
        while len(mine) < width:
            best = max(left, key=lambda b: (corr[b, mine].sum(), -b))
            mine.append(best)
            left.remove(best)
        parts.append(sorted(mine))
    return parts


def allocate(n: int, both: np.ndarray, parts: list[list[int]], bits: int) -> tuple[float, list[int]]:
    """Thresholds that add up to bits - m + 1 at the least estimated cost, by dynamic programming over partitions."""
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)
    cost = []
    for part in parts:
        dist = np.array([1.0])  # of the number of bits in which two fingerprints differ
        for b in part:
            dist = np.convolve(dist, [1 - differ[b], differ[b]])
        row = [0.0]  # threshold -1
        for t in range(min(len(part), bits) + 1):
            probes = sum(math.comb(len(part), k) for k in range(t + 1))
            row.append(n * probes * ROW_COST + n * n * dist[: t + 1].sum() * PAIR_COST)
        cost.append(row)
    best = {0: (0.0, [])}  # by the sum of t + 1
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t1, x in enumerate(row):
                if used + t1 <= bits + 1 and (used + t1 not in step or step[used + t1][0] > c + x):
                    step[used + t1] = (c + x, [*ts, t1 - 1])
        best = step
    return best[bits + 1]


def plan(fps: DataFrame, bits: int, widths: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, of the number of partitions with the least estimated cost."""
    n, both = bit_counts(fps)
    n = max(n, 1)
    tried = []
    for m in (w for w in widths if w <= bits + 1):
        parts = arrange(n, both, m)
        c, ts = allocate(n, both, parts, bits)
        tried.append((c, [(q, t) for q, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(tried, key=lambda x: x[0])[1]


def _pick(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of part as a number."""
    v = np.zeros(len(fp), np.uint64)
    for b in part:
        v = (v << np.uint64(1)) | ((fp >> np.uint64(63 - b)) & np.uint64(1))
    return v


def candidates(fps: DataFrame, scheme: list[tuple[list[int], int]], bits: int, hot: int = HOT) -> DataFrame:
    """Links (a, b) between the nodes of fps (node long, fp long) that differ in at most ``bits`` bits.

    The links join exactly what all links would join, and a bucket gives fewer than it has rows.
    A bucket with over ``hot`` bases is cut into g shares by the node, and its bases and rows meet in g * g pairs of shares, so that no
    task holds more than one share of the bases and one of the rows.
    """
    # a pair that meets in several partitions is looked at in the first of them only
    earlier = [(np.uint64(sum(1 << (63 - b) for b in part)), t) for part, t in scheme]
    masks = []
    for part, t in scheme:
        w = len(part)
        masks.append(np.array([sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(range(w), k)], np.uint64))

    def base_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = x.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (part, _) in enumerate(scheme):
                yield pa.RecordBatch.from_arrays([pa.array((_pick(fp, part) << np.uint64(3) | np.uint64(i)).view(np.int64))], names=["key"])

    crowded = {r["key"]: -(-r["count"] // hot) for r in fps.select("fp").mapInArrow(base_values, "key long").groupBy("key").count().where(F.col("count") > hot).collect()}

    hot_keys = np.array(sorted(crowded), np.int64)
    hot_shares = np.array([crowded[k] for k in sorted(crowded)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            all_node, all_fp = (x.column(c).to_numpy(zero_copy_only=False) for c in ("node", "fp"))
            for at in range(0, len(all_fp), 1 << 12):
                node, fp = all_node[at : at + (1 << 12)], all_fp[at : at + (1 << 12)].view(np.uint64)
                for i, (part, _) in enumerate(scheme):
                    value = _pick(fp, part)
                    for own, v in ((True, value[:, None]), (False, value[:, None] ^ masks[i][None, :])):
                        key = ((v << np.uint64(3)) | np.uint64(i)).view(np.int64)
                        per = key.shape[1]
                        if not per:
                            continue
                        out = [key.ravel(), np.repeat(node, per), np.repeat(fp.view(np.int64), per), np.zeros(key.size, np.int32), np.full(key.size, own)]
                        if len(hot_keys):
                            out = _split(out, hot_keys, hot_shares)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["key", "node", "fp", "share", "base"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def links(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            key, share, node, fp, base = cols
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (share[1:] != share[:-1])])
            ends = np.r_[new[1:], len(key)]
            any_base = np.logical_or.reduceat(base, new) if len(new) else np.zeros(0, bool)
            for s, e in zip(new[(ends - new > 1) & any_base], ends[(ends - new > 1) & any_base], strict=True):
                yield from _bucket(node[s:e], fp[s:e].view(np.uint64), base[s:e], bits, earlier[: int(key[s]) & 7])

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            got = list(links(cols))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got])) for k in (0, 1)], names=["a", "b"])

        for x in batches:
            cols = [x.column(c).to_numpy(zero_copy_only=False) for c in ("key", "share", "node", "fp", "base")]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                whole = [np.concatenate(z) for z in zip(*held, [c[:cut] for c in cols], strict=True)] if held else [c[:cut] for c in cols]
                held = []
                yield from out(whole)
            held.append([c[cut:] for c in cols])
        if held:
            yield from out([np.concatenate(z) for z in zip(*held, strict=True)])

    dealt = fps.select("node", "fp").mapInArrow(deal, "key long, node long, fp long, share int, base boolean")
    return dealt.repartition("key", "share").sortWithinPartitions("key", "share").mapInArrow(verify, "a long, b long")


def _split(rows: list[np.ndarray], hot_keys: np.ndarray, hot_shares: np.ndarray) -> list[np.ndarray]:
    """rows (key, node, fp, share, base) with those of crowded keys dealt to pairs (i, j) of shares, numbered i * g + j: a base of share s
    stands as a base in all (s, j), and every row of share s to be held against bases in all (i, s)."""
    at = np.minimum(np.searchsorted(hot_keys, rows[0]), len(hot_keys) - 1)
    hit = hot_keys[at] == rows[0]
    if not hit.any():
        return rows
    parts = [[c[~hit] for c in rows]]
    for base in (True, False):
        some = np.flatnonzero(hit & rows[4]) if base else np.flatnonzero(hit)
        g = hot_shares[at[some]]
        home = rows[1][some] % g
        ends = np.cumsum(g)
        other = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - g, g)
        many, per, mine = np.repeat(some, g), np.repeat(g, g), np.repeat(home, g)
        share = mine * per + other if base else other * per + mine
        parts.append([rows[0][many], rows[1][many], rows[2][many], share.astype(np.int32), np.full(len(many), base)])
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _bucket(node: np.ndarray, fp: np.ndarray, base: np.ndarray, bits: int, earlier: list[tuple[np.uint64, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    label = np.arange(len(node))
    for x in np.flatnonzero(base):
        d = np.bitwise_count(fp ^ fp[x])
        at = np.flatnonzero(d <= bits)
        at = at[node[at] != node[x]]
        for mask, t in earlier:
            at = at[np.bitwise_count((fp[at] ^ fp[x]) & mask) > t]
        if not len(at):
            continue
        at = at[np.argsort(d[at], kind="stable")]
        _, first = np.unique(label[at], return_index=True)  # the nearest of each part
        first = first[label[at[first]] != label[x]]
        take = at[first]
        label[np.isin(label, label[take])] = label[x]
        if len(take):
            yield np.full(len(take), node[x]), node[take]


def near_duplicates(docs: DataFrame, width: int = WIDTH, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component long): one row per row of docs; component is the smallest id that links of at most ``bits``
    bits reach.  Equal fingerprints are one class, so copies are never paired.  A null text counts as empty; a null id
    never names a component unless all ids of it are null.  An empty table gives an empty result."""
    spark = docs.sparkSession
    tune(spark)
    slim = materialise(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp")), "fingerprints")
    classes = materialise(slim.groupBy("fp").agg(F.min("id").alias("id")).withColumn("node", F.col("fp")), "classes")
    edges = candidates(classes, plan(classes, bits), bits)
    label = components(edges)
    joined = classes.join(label, "node", "left").select("fp", "id", F.coalesce("label", "node").alias("label"))
    least = joined.groupBy("label").agg(F.min("id").alias("component"))
    named = materialise(joined.join(least, "label").select("fp", "component"), "components")
    return slim.join(named, "fp").select("id", "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _sets(text: Column, width: int) -> Column:
    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(x, width)).view(np.int64) for x in texts.to_pylist()], pa.list_(pa.int64()))

    return run(text)


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each of BANDS bands of ROWS minima of independent hashes of h; sets of Jaccard similarity j share a given key with
    probability j ** ROWS, and empty sets share all."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 1 << 12):
        np.minimum(low, (_FACTORS[:, None] * h[None, i : i + (1 << 12)]).min(1), out=low)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column)
    return keys


def _signature(text: Column, width: int) -> Column:
    """(fp, keys): the fingerprint and the keys of band_keys()."""

    @F.arrow_udf("struct<fp:long,keys:array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        hashes = [shingle_hashes(x, width) for x in texts.to_pylist()]
        fp = pa.array(np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([fp, pa.array([band_keys(h).view(np.int64) for h in hashes], pa.list_(pa.int64()))], names=["fp", "keys"])

    return run(text)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows (key, node), sorted, to the first node of their key."""
    last = [np.zeros(0, np.int64)] * 2  # the key of the row before, and the first node of it
    for x in batches:
        key, node = (np.r_[z, x.column(c).to_numpy(zero_copy_only=False)] for z, c in zip(last, ("key", "node"), strict=True))
        if not len(key):
            continue
        new = np.r_[True, key[1:] != key[:-1]]
        first = node[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = node != first
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(first[at])], names=["a", "b"])
        last = [key[-1:], first[-1:]]


def linked(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join exactly what all pairs of at least this Jaccard similarity join, fewer than there are sets (of distinct values).
    With ``side`` only pairs of different sides count.  Pairs already joined are not compared, all others are."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders, ends = row[np.argsort(token, kind="stable")], np.cumsum(df)
    mine = np.split(token, np.cumsum(n)[:-1])
    label, links = np.arange(len(sets)), []
    for x in range(len(sets) - 1):
        away = label != label[x]
        away[:x] = False  # those were held against x
        if side is not None:
            away &= side != side[x]
        if not away.any():
            continue
        both = np.zeros(len(sets), np.int64)
        for t in mine[x]:
            both[holders[ends[t] - df[t] : ends[t]]] += 1
        union = n + n[x] - both
        at = np.flatnonzero(away & (both >= similarity * union - 1e-6 * union))
        at = at[[union[y] == 0 or both[y] / union[y] >= similarity for y in at]] if len(at) else at
        for y in at:
            if label[y] != label[x]:
                links.append((x, int(y)))
                label[label == label[y]] = label[x]
    return links


def _compare(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            node, block = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            got = linked([h[2] for h in held], similarity, block if block.min() != block.max() else None)
            if got:
                a, b = node[np.array(got)].T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        now = None
        for x in batches:
            sets = x.column("set")
            for i, key in enumerate(zip(*(x.column(c).to_pylist() for c in ("group", "i", "j")), strict=True)):
                if key != now and held:
                    yield from out()
                    held = []
                now = key
                held.append((x.column("node")[i].as_py(), x.column("block")[i].as_py(), sets[i].values.to_numpy(zero_copy_only=False)))
        if held:
            yield from out()

    return run


def similar(docs: DataFrame, groups: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join what all pairs of one group with at least this Jaccard similarity join.

    docs has (node, set), groups (node, label).  A group with over ``block`` rows is cut into blocks by the node, and each pair of
    blocks is one comparison, so that a task holds two blocks at most; all pairs of the group meet.
    """
    large = groups.groupBy("label").count().where(F.col("count") > block).select("label", F.ceil(F.col("count") / block).cast("int").alias("g"))
    cut = groups.join(F.broadcast(large), "label", "left").select("node", F.col("label").alias("group"), F.coalesce("g", F.lit(1)).alias("g"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = cut.select("node", "group", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(docs, "node")
    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_compare(similarity), "a long, b long")


_USED = ["__hash", "__check", "__keep", "__node", "__k", "__n"]


def _hash(text: Column, which: int) -> Column:
    """One of two 64-bit hashes of a text; null counts as empty."""
    return F.xxhash64(F.lit(which), F.coalesce(text, F.lit("")))


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id (null last), its first text on ties.

    Equal texts, by 128 bits of hash, are one class.  Texts are linked if the Jaccard similarity of their sets of width-word shingles reaches ``similarity``.
    Texts whose fingerprints differ in at most BITS bits, or that share a key of band_keys(), at once or through others, form a group, and
    within a group all pairs that are not joined yet are compared by their sets.  Two texts of similarity j share no key with probability (1 - j ** ROWS) ** BANDS: 4e-9 at 0.8.
    Null, empty and blank texts have no shingles and form one group with each other only.  An empty table gives an empty one.  Columns
    with the names in _USED are left out.
    """
    spark = docs.sparkSession
    tune(spark)
    names = [c for c in docs.columns if c not in _USED]
    docs = docs.drop(*_USED)
    plain = docs.withColumn("__hash", _hash(F.col(text_col), 0)).withColumn("__check", _hash(F.col(text_col), 1))
    slim = materialise(plain.select(F.col(id_col).alias("id"), F.col("__hash"), F.col("__check"), _signature(F.col(text_col), width).alias("s")), "signatures")
    texts_ = materialise(slim.groupBy("__hash", "__check").agg(F.min("id").alias("id"), F.first("s.fp").alias("fp"), F.first("s.keys").alias("keys")), "classes")
    # different texts with one 64-bit hash: all but one take their second hash for a name; there are few of them among any number of texts
    clash = materialise(texts_.groupBy("__hash").agg(F.count("*").alias("n"), F.min("__check").alias("__keep")).where("n > 1").select("__hash", "__keep"), "clashes")

    def named(df: DataFrame) -> DataFrame:
        return df.join(clash, "__hash", "left").withColumn("__node", F.when(F.col("__check") != F.col("__keep"), F.col("__check")).otherwise(F.col("__hash"))).drop("__hash", "__check", "__keep")

    keyed, classes = named(plain), named(texts_).withColumnRenamed("__node", "node")
    keys = classes.select("node", F.explode("keys").alias("key"))
    stars = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a long, b long")
    of = classes.select("node", "fp")
    fps = materialise(of.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = of.join(fps.withColumnRenamed("node", "first"), "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = materialise(components(stars.unionByName(same).unionByName(candidates(fps, plan(fps, BITS), BITS))), "groups")
    keyed = keyed.withColumn("__k", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    first = classes.select(F.col("node").alias("__node"), F.coalesce("id", F.lit(-(1 << 63))).alias("__k"))
    nodes = groups.select(F.col("node").alias("__node")).join(first, "__node")
    # one row of each text: its hash and smallest id are a key without hot values
    texts = keyed.select("__node", "__k", text_col).join(nodes, ["__node", "__k"], "left_semi").dropDuplicates(["__node"])
    sets = materialise(texts.select(F.col("__node").alias("node"), _sets(F.col(text_col), width).alias("set")), "shingles")
    label = components(similar(sets, groups, similarity))
    joined = classes.join(label, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    best = joined.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))).alias("m"))
    best = best.select(F.col("m.node").alias("__node"), F.coalesce("m.id", F.lit(-(1 << 63))).alias("__k"))
    order = Window.partitionBy("__node", "__k").orderBy(id_col)
    return keyed.join(best, ["__node", "__k"]).withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*names)
