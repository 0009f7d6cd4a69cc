"""Byte-level BPE and spelling variants: against the library, against SQL and against plain Python."""

import hashlib
import random
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gneiss.llm import bytebpe, spelling
from tests.llm.tables import rows_of


@pytest.fixture(scope="module")
def library():
    ranks = bytebpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["awkward", "driver", "empty"])
def test_byte_bpe_gives_the_ids_of_the_library(spark, folders, library, which):
    got = bytebpe.op12_byte_bpe(spark, folders[which]).collect()
    want = []
    for d, t in rows_of(folders[which]):
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_byte_bpe_of_odd_words(spark, library):
    """Words of all lengths, in and out of the dictionary; letters, numbers and blanks that Unicode versions see differently; clashing names."""
    r = random.Random(4)
    texts = ["".join(r.choice("abeinorst eE'12 ") for _ in range(n)) for n in (1, 2, 3, 9, 60, 400)] + ["z" * 300, "0" * 5000, "ab" * 40000, "語" * 300, "\x1c \x1d\x85\xa0x y  ", "ࡰa\U000323af1", "'s 'll don't", "".join(map(chr, range(1, 0x600)))]
    texts += ["".join(chr(r.choice([r.randrange(0x530, 0xD800), r.randrange(0x10000, 0x11FFF)])) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("mine")).withColumn("w", F.lit(1)).withColumn("__rest", F.lit("x"))
    encoder = bytebpe.Encoder()
    for most in (4, 1000):
        out = bytebpe.encode(docs, encoder, most=most)
        rows = out.withColumn("back", bytebpe.decode(F.col("ids"), encoder)).collect()
        assert out.columns == ["doc_id", "text", "w", "__rest", "ids"]
        for x in rows:
            assert x.ids == library.encode_ordinary(texts[x.doc_id]), x.doc_id
            assert bytes(x.back) == texts[x.doc_id].encode() and x.w == 1 and x["__rest"] == "x"


def test_heap_and_fold_are_the_same(spark, library):
    r = random.Random(7)
    words = ["".join(r.choice("eitnaslo") for _ in range(r.randint(1, 40))) for _ in range(150)] + ["ö" * 9, "𝔘𝔫"]
    encoder = bytebpe.Encoder()
    folded = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", encoder.fold(F.array("w"))[0].alias("ids")).collect()
    ranks = bytebpe.ranks_of(encoder.path)
    for x in folded:
        assert x.ids == bytebpe.merged_by_heap(words[x.i].encode(), ranks) == library._encode_single_piece(words[x.i].encode())


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= 5 * n else None, len(close))
    rows = []
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, counts[w], n_near, counts[form] if form else None))
    return sorted(rows, key=str)


@pytest.mark.parametrize("crowded", [2, 64])
def test_spelling_by_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    r = random.Random(11)
    counts = {}
    for _ in range(60):
        w = "".join(r.choice("abcéÀz") for _ in range(r.randint(6, 9)))
        counts[w], n = r.randint(100, 5000), 3
        while n:  # chains of variants
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcéÀz") + w[i:], w[:i] + r.choice("abcéÀz") + w[i + 1 :]])
            counts.setdefault(w, r.randint(1, 100) * 4 ** r.randint(0, 3))
            n -= 1
    found = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.group(found).collect()), key=str) == brute(counts)


@pytest.mark.parametrize("which", ["awkward", "driver", "empty"])
def test_words_by_definition(spark, folders, which):
    import re

    want = {}
    for d, t in rows_of(folders[which]):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            run = run[:at] + run[at + 1 :] if h % 199 == 0 else run
            want[run] = want.get(run, 0) + 1
    from gneiss.llm._store import table

    assert {x.word: x.n for x in spelling.words(table(spark, folders[which], "documents")).collect()} == want


@pytest.mark.parametrize("which", ["awkward", "driver", "empty"])
def test_spelling_is_what_sql_gives(spark, folders, which):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folders[which]}/documents.parquet')")
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.op11_spelling(spark, folders[which]).collect()]
    assert sorted(got, key=str) == sorted(con.sql(spelling.ORACLE).fetchall(), key=str)
