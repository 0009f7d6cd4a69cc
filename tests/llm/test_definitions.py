"""The classifier's forward pass, the mixture and long texts against slow definitions in plain Python."""

import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from gneiss.llm import decontam, mixing, quality, sharding, tokenbin
from tests.llm.tables import PASSAGE, rows_of


def slow_score(net, text):
    """Chunk by chunk, place by place, filter by filter."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, hidden = list((text or "").encode()), []
    start = 0
    while True:
        chunk = data[start : start + quality.CHUNK]
        full = len(chunk) / quality.CHUNK
        chunk += [256] * (quality.CHUNK - len(chunk))
        best = [-np.inf] * quality.FILTERS
        for at in range(0, quality.CHUNK - quality.KERNEL + 1, quality.STRIDE):
            under = np.concatenate([p["embed"][b] for b in chunk[at : at + quality.KERNEL]])
            best = [max(m, float(under @ p["w"][:, f])) for f, m in enumerate(best)]
        seen = np.array([max(m + b, 0) for m, b in zip(best, p["b"], strict=True)] + [full])
        hidden.append(np.maximum(seen @ p["u"] + p["c"], 0))
        start += quality.HOP
        if start >= max(len(data) - (quality.CHUNK - quality.HOP), 1):
            break
    x = np.concatenate([np.max(hidden, 0), np.mean(hidden, 0)])
    return 1 / (1 + np.exp(-float(x @ p["top"] + p["bias"][0])))


def test_forward_pass(spark, folders):
    r = np.random.default_rng(5)
    net = quality.Network(5)
    net.p = {k: v + r.normal(0, 0.2, v.shape).astype(np.float32) for k, v in net.p.items()}
    texts = [t for _, t in rows_of(folders["awkward"])] + ["x" * n for n in (127, 128, 129, 511, 512, 513, 895, 896, 897)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.s for x in docs.select("doc_id", quality.score(F.col("text"), net).alias("s")).collect()}
    assert max(abs(got[i] - slow_score(net, t)) for i, t in enumerate(texts)) < 1e-5


def test_quality_rows_of_the_awkward_table(spark, folders):
    rows = rows_of(folders["awkward"])
    got = quality.op3_quality(spark, folders["awkward"]).collect()
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(d), d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {}
    for r in got:
        by.setdefault(dict(rows[:20]).get(r.doc_id) if r.doc_id is not None else r.doc_id, set()).add(round(r.score, 6))
    assert len(by[PASSAGE]) == 1 and len(by["one two three"]) == 1  # copies


def slow_share_out(total, weights, caps):
    """One token after the other, to the child that has least for its weight; children without weight come last."""
    out = [0] * len(caps)
    for _ in range(min(total, sum(caps))):
        some = [i for i in range(len(caps)) if out[i] < caps[i] and weights[i] > 0] or [i for i in range(len(caps)) if out[i] < caps[i]]
        i = min(some, key=lambda i: ((out[i] + 1) / (weights[i] or 1), i))
        out[i] += 1
    return out


def test_shares_token_by_token():
    r = random.Random(3)
    for _ in range(400):
        n = r.randint(1, 6)
        weights, caps = [r.choice([0, 0.5, 1, 2, 4]) for _ in range(n)], [r.randint(0, 120) for _ in range(n)]
        total = r.randint(0, 500)
        got, want = mixing.share_out(total, weights, caps), slow_share_out(total, weights, caps)
        assert sum(got) == sum(want) and all(0 <= g <= c for g, c in zip(got, caps, strict=True))
        assert max(abs(g - w) for g, w in zip(got, want, strict=True)) <= n, (total, weights, caps, got, want)


def chained(seed, *values):
    """Spark's xxhash64 of several columns: each one's hash is the seed of the next, nulls are passed over."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v, seed)
    return seed - (1 << 64) if seed >> 63 else seed


@pytest.mark.parametrize("which", ["awkward", "driver"])
def test_mixing_query_by_definition(spark, folders, which):
    t = pq.read_table(f"{folders[which]}/documents.parquet").to_pydict()
    rows = []
    for doc, text, lang, source in zip(t["doc_id"], t["text"], t["lang"], t["source"], strict=True):
        digits = "".join(c for c in (source or "") if c.isdigit())
        place = chained(42, struct.pack("<i", mixing.SEED), None if doc is None else struct.pack("<q", doc), None if text is None else text.encode())
        rows.append((doc, f"domain{int(digits) % 4 if digits else 0}", lang, source, len((text or "").encode().split()), place))
    root, leaves = mixing.Node(""), {}
    for r in sorted(rows, key=lambda r: (r[1], r[2] or "\0null", r[3] or "\0null")):
        d = root.children.setdefault(r[1], mixing.Node(r[1], mixing.DOMAIN_WEIGHTS.get(r[1], 1.0)))
        g = d.children.setdefault(r[2], mixing.Node("", mixing.LANG_WEIGHTS.get(r[2], 1.0)))
        leaf = g.children.setdefault(r[3], mixing.Node(""))
        leaf.tokens += r[4]
        leaves[r[1:4]] = leaf
    mixing.hand_down(root, min(int(sum(r[4] for r in rows) * 0.6), root.capacity(mixing.MAX_EPOCHS)), mixing.MAX_EPOCHS)
    want = []
    for key, leaf in leaves.items():
        epochs = leaf.budget // leaf.tokens if leaf.tokens else 0
        mine = [(chained(42, struct.pack("<q", r[5]), struct.pack("<i", epochs)), r) for r in rows if r[1:4] == key]
        for turn, r in mine:
            upto = sum(x[4] for at, x in mine if at <= turn)
            want.append((r[0], *key, r[4], epochs, epochs + (upto <= leaf.budget - epochs * leaf.tokens)))
    assert sorted(map(tuple, mixing.op9_mixing(spark, folders[which]).collect()), key=str) == sorted(want, key=str)


def test_very_long_texts(spark):
    """A text of 3 MB beside short ones, and columns whose names the operators use."""
    long = ("many words of one long line and a number 12345 " * 30 + "\n") * 2200
    docs = spark.createDataFrame([(1, long), (2, "short one"), (3, long + "end"), (4, "")], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("src1"))
    for name in ("__key", "__n", "__row_", "__tokens_"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = sharding.shard(docs, 3).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4]
    ids = {r.doc_id: r.n_tokens for r in tokenbin.read(tokenbin.write(docs), ids=False).collect()}
    tok = tokenbin._encoder(tokenbin._path(tokenbin.TOKENIZER)).tok
    assert ids == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in ((1, long), (2, "short one"), (3, long + "end"), (4, ""))}
    bench = spark.createDataFrame([(7, "many words of one long line and a number"), (8, "something else that stands in none of the texts")], "item_id long, text string")
    assert {r.doc_id: [m.item_id for m in r["__found"]] for r in decontam.find(docs, bench).collect()} == {1: [7], 2: [], 3: [7], 4: []}
    assert {r.doc_id: r["__tokens"] for r in mixing.mix(docs).collect()} == {d: len(t.split()) for d, t in ((1, long), (2, "short one"), (3, long + "end"), (4, ""))}
