"""Byte-level BPE: which words are folded, and how words are found and looked up."""

import random

import regex

from gneiss.llm import bytebpe


def test_only_words_that_occur_once_are_folded_in_their_text(spark, monkeypatch):
    """Words beyond the dictionary come from arrays by their hash; the ids are the same as by the heap."""
    monkeypatch.setattr(bytebpe, "HOT", 3)
    texts = ["the aqzub the wörq the end", "aqzub lonely wörq end", "", None, "x" * 300 + " the solo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoder = bytebpe.Encoder()
    known = bytebpe._Known(bytebpe.frequent(docs, encoder).value)
    assert set(known.words.to_pylist()) == {" the", " wörq", " end"} and len(known) == 3
    known = bytebpe._Known(bytebpe.frequent(docs.union(docs), encoder).value)
    assert len(known) == 3 and len(known.words) == 8
    ranks = bytebpe.ranks_of(encoder.path)
    codes, rest = bytebpe._coded(texts, known, bytebpe._finder(encoder.pattern), ranks)
    assert rest.to_pylist() == [[], [], [], [], []]
    want = [b"".join(i.to_bytes(4, "little") for w in regex.findall(encoder.pattern[0], t or "") for i in bytebpe.merged_by_heap(w.encode(), ranks)) for t in texts]
    assert codes.to_pylist() == want
    few = bytebpe._Known(bytebpe.frequent(docs.union(docs), encoder, most=1).value)
    assert few.words.to_pylist() == [" the"]
    rest = bytebpe._coded(texts, few, bytebpe._finder(encoder.pattern), ranks)[1].to_pylist()
    assert [set(w) for w in rest] == [{"the", " aqzub", " wörq", " end"}, {"aqzub", " lonely", " wörq", " end"}, set(), set(), {" solo"}]


def test_words_of_the_first_256_characters_are_those_of_the_pattern():
    find, usual, r = bytebpe._finder(bytebpe.pattern()), regex.compile(bytebpe.pattern()[0]).findall, random.Random(3)
    some = "".join(map(chr, range(256))) + "  ''stllre \n\n" * 6
    for _ in range(5000):
        t = "".join(r.choice(some) for _ in range(r.randint(0, 30)))
        assert find(t) == usual(t)
