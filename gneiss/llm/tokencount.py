"""Token counts: batches balanced by bytes are encoded in an Arrow function that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm._store import table, tune

MODEL, PIECE_CHARS, BATCH_BYTES, LIMIT = "piece_bpe_32k.model", 1 << 14, 1 << 18, 4096
#: A single blank between two visible ASCII characters: no piece of the vocabulary has a blank inside, and the encoder puts one before each text.
SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")


@cache
def _model(path: str):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    whole = all(mark not in m.id_to_piece(i).lstrip(mark) for i in range(m.get_piece_size()))
    # a cut is safe if the encoder gives the same pieces on both sides, with the blank put back as the mark that begins a text
    alike = [len(m.encode(x)) for x in ("ab cd", "ab", "cd")]
    return m, whole and alike[0] == alike[1] + alike[2]


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """text in runs of at least ``most`` characters, cut at safe blanks, which are left out; whole where there is none."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def lengths(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text."""
    model, safe = _model(path)
    out, batch, owner, size = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, ids in zip(owner, model.encode(batch, num_threads=1), strict=True):
            out[i] += len(ids)
        batch.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text or "") if safe else [text or ""]:
            batch.append(piece)
            owner.append(i)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= BATCH_BYTES:
                flush()
                size = 0
    if batch:
        flush()
    return out


def count_tokens(text: Column, model: str = MODEL) -> Column:
    """Tokens of the whole text (null: of the empty text, none), as the encoder gives them without begin or end.

    A long text is encoded in pieces cut at safe blanks, and as a whole where it has none.  Equal texts have equal counts, an empty
    table gives an empty result, and no column is added, so no name can clash.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(lengths(texts.to_pylist(), _path(model)), pa.int64())

    return count(text)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; a null text has none of either."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count_tokens(F.col("text")).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
