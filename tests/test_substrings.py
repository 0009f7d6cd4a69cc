"""Texts that hold a term anywhere, against a plain scan."""

from gneiss.operators import retrieval


def test_terms_anywhere(spark):
    texts = ["The Catalogue of cats", "concatenate", "", None, "a-b c d", "0" * 500, "Émigré cat", "xx" * 3000 + "cat9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = [(1, "cat"), (1, "of"), (2, "000"), (2, "migr"), (3, "b c"), (3, "é"), (4, "nowhere"), (5, "cat9"), (5, "xxx")]
    want = sorted({(q, i) for i, t in enumerate(texts) for q, w in terms if w in (t or "").lower()})
    got = retrieval.substring_hits(docs, spark.createDataFrame(terms, "query_id long, term string"), k=50)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == want
    only = [(q, w) for q, w in terms if w.isascii() and " " not in w]
    some = retrieval.substring_hits(docs, spark.createDataFrame(only, "query_id long, term string"), k=2)
    assert "NestedLoop" not in some._jdf.queryExecution().toString() and "Cartesian" not in some._jdf.queryExecution().toString()
    per = {}
    for q, i in sorted({(q, i) for i, t in enumerate(texts) for q, w in only if w in (t or "").lower()}):
        per.setdefault(q, []).append(i)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in some.collect()) == sorted((q, k + 1, i) for q, ids in per.items() for k, i in enumerate(ids[:2]))
