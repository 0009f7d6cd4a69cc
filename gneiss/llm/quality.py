"""Quality classifier: a byte-level convolutional network in numpy.

The whole UTF-8 text is cut into overlapping chunks.  Bytes are embedded, learned filters slide over each chunk, and each filter keeps
its largest response in the chunk.  A small layer combines these with how far the chunk is filled; over the chunks of a document
the largest and the mean of its outputs are kept, and a logistic layer turns them into one probability.  It is trained on the driver on at most TRAIN_ROWS labelled rows and at most TRAIN_CHUNKS chunks of each, spread
evenly over the text; scores always use every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm._store import table, tune

CHUNK, HOP, KERNEL, STRIDE, DIM, FILTERS, HIDDEN = 512, 384, 8, 2, 8, 32, 16
TRAIN_ROWS, TRAIN_CHUNKS, EPOCHS, BAR = 5000, 8, 8, 0.7
_PAD, _BLOCK = 256, 128


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of a text of n bytes; they overlap by CHUNK - HOP bytes and the last one reaches the end."""
    return np.arange(0, max(n - (CHUNK - HOP), 1), HOP)


def chunks_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of byte numbers for each start, filled up with _PAD."""
    wide = np.full(int(starts[-1]) + CHUNK if len(starts) else CHUNK, _PAD, np.int16)
    wide[: len(data)] = data[: len(wide)]
    return np.lib.stride_tricks.sliding_window_view(wide, CHUNK)[starts]


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (257, DIM)).astype(np.float32), "w": r.normal(0, (KERNEL * DIM) ** -0.5, (KERNEL * DIM, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32),
            "u": r.normal(0, (FILTERS + 1) ** -0.5, (FILTERS + 1, HIDDEN)).astype(np.float32), "c": np.full(HIDDEN, 0.1, np.float32), "top": r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "bias": np.zeros(1, np.float32),
        }

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """(rows, places, KERNEL * DIM): the embedded bytes under the filter at each place."""
        e = self.p["embed"][rows]
        v = np.lib.stride_tricks.sliding_window_view(e.reshape(len(rows), -1), KERNEL * DIM, axis=1)[:, :: STRIDE * DIM]
        return np.ascontiguousarray(v)

    def _best(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each chunk, and its place."""
        best, where = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64)
        for i in range(0, len(rows), _BLOCK):
            v = self.windows(rows[i : i + _BLOCK])
            z = (v.reshape(-1, KERNEL * DIM) @ self.p["w"]).reshape(*v.shape[:2], FILTERS)
            where[i : i + _BLOCK] = z.argmax(1)
            best[i : i + _BLOCK] = np.take_along_axis(z, where[i : i + _BLOCK, None], 1)[:, 0]
        return best, where

    def _inputs(self, best: np.ndarray, rows: np.ndarray) -> np.ndarray:
        full = (rows != _PAD).mean(1, dtype=np.float32)[:, None]
        return np.concatenate([np.maximum(best + self.p["b"], 0), full], 1)

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        """The small layer's outputs for each chunk.  Blocks are filled up to one size, so that a chunk's numbers don't depend on its neighbours
        and equal texts have equal scores."""
        best = np.empty((len(rows), FILTERS), np.float32)
        for i in range(0, len(rows), _BLOCK):
            some = rows[i : i + _BLOCK]
            if len(some) < _BLOCK:
                some = np.concatenate([some, np.full((_BLOCK - len(some), CHUNK), _PAD, rows.dtype)])
            v = self.windows(some)
            z = (v.reshape(-1, KERNEL * DIM) @ self.p["w"]).reshape(*v.shape[:2], FILTERS).max(1)
            best[i : i + _BLOCK] = z[: len(rows) - i]
        return np.maximum(self._inputs(best, rows).astype(np.float64) @ self.p["u"].astype(np.float64) + self.p["c"], 0)

    def probability(self, hidden: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of documents whose chunks begin at the rows ``first``."""
        n = np.diff(np.r_[first, len(hidden)])[:, None]
        x = np.concatenate([np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / n], 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.p["top"] + self.p["bias"], -30, 30)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the log loss; the gradient passes through the largest places only."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                rows = np.concatenate([docs[k] for k in some])
                size = np.array([len(docs[k]) for k in some])
                first = np.cumsum(size) - size
                g = self._gradient(rows, first, size, labels[some])
                step += 1
                lr = rate * (0.5 * (1 + np.cos(np.pi * (epoch + i / len(order)) / epochs)))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, rows: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        best, where = self._best(rows)
        f = self._inputs(best, rows)
        h = np.maximum(f @ self.p["u"] + self.p["c"], 0)
        high = np.maximum.reduceat(h, first)
        x = np.concatenate([high, np.add.reduceat(h, first) / size[:, None]], 1)
        p = 1 / (1 + np.exp(-np.clip(x @ self.p["top"] + self.p["bias"], -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"top": x.T @ d + 1e-4 * self.p["top"], "bias": d.sum(keepdims=True)}
        doc = np.repeat(np.arange(len(size)), size)
        dh = d[doc, None] * (self.p["top"][None, HIDDEN:] / size[doc, None] + self.p["top"][None, :HIDDEN] * (h == high[doc]))
        dh *= h > 0
        g["u"], g["c"] = f.T @ dh, dh.sum(0)
        dp = (dh @ self.p["u"].T)[:, :FILTERS] * (f[:, :FILTERS] > 0)
        g["b"] = dp.sum(0)
        at = where[:, :, None] * STRIDE + np.arange(KERNEL)  # bytes under the largest place of each filter
        byte = np.take_along_axis(rows[:, None, :].astype(np.int64), at, 2)
        e = self.p["embed"][byte].reshape(len(rows), FILTERS, KERNEL * DIM)
        g["w"] = (e.transpose(1, 2, 0) @ dp.T[:, :, None])[:, :, 0].T
        de = (dp[:, :, None] * self.p["w"].T[None]).reshape(-1, DIM)
        g["embed"] = np.stack([np.bincount(byte.ravel(), de[:, k], 257) for k in range(DIM)], 1).astype(np.float32)
        return g

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A probability for each whole text; null counts as empty."""
        out = np.empty(len(texts))
        rows: list[np.ndarray] = []
        who: list[int] = []
        held = 0

        def flush() -> None:
            first = np.cumsum([len(x) for x in rows]) - [len(x) for x in rows]
            out[who] = self.probability(self.hidden(np.concatenate(rows)), first)
            rows.clear()
            who.clear()

        for i, text in enumerate(texts):
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts = chunk_starts(len(data))
            if len(starts) > 1024:  # a very long text in runs of chunks
                hidden = np.concatenate([self.hidden(chunks_of(data[starts[k] : starts[min(k + 1024, len(starts)) - 1] + CHUNK], starts[k : k + 1024] - starts[k])) for k in range(0, len(starts), 1024)])
                out[i] = self.probability(hidden, np.array([0]))[0]
                continue
            rows.append(chunks_of(data, starts))
            who.append(i)
            held += len(starts)
            if held >= 512:
                flush()
                held = 0
        if rows:
            flush()
        return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """A network for labels.quality.  Rows are the first in the order of a hash of doc_id, so the sample is bounded, spread and the same
    each time.  Labels or ids that are null, and held-out rows, are left out.  Without any labels the network stays untrained."""
    tune(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                data = np.frombuffer((text or "").encode(), np.uint8)
                starts = chunk_starts(len(data))
                if len(starts) > TRAIN_CHUNKS:
                    starts = starts[np.linspace(0, len(starts) - 1, TRAIN_CHUNKS).astype(int)]
                out.append(chunks_of(data, starts).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "quality", "chunks"])

    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text").mapInArrow(spread, "doc_id long, quality int, chunks binary")
    got = sorted((r["doc_id"], r["quality"], bytes(r["chunks"])) for r in got.limit(2 * rows).collect())  # repeated rows can raise the number
    net = Network()
    if got:
        net.fit([np.frombuffer(c, "<i2").reshape(-1, CHUNK) for _, _, c in got], np.array([q for _, q, _ in got], np.float32))
    return net


def score(text: Column, net: Network) -> Column:
    """The probability that the text's quality is 1.  Null and empty texts are one empty chunk; every chunk of a long text counts; equal texts
    have equal scores; an empty table gives an empty result; no column is added, so no name can clash."""
    weights = net.p

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        n = Network()
        n.p = weights
        return pa.array(n.score(texts.to_pylist()), pa.float64())

    return run(text)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a network trained on labels outside the held-out rows."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), net).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= BAR).cast("int"))
