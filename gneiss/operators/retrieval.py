"""Hybrid retrieval for many questions at once: BM25 and cosine arms, fusion, recency, diversity, budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as X

TOP_K, POOL, RRF_K, RECENCY, PER_DOC, BUDGET, REST = 6, 3, 60, 0.15, 3, 12_000, 200
QUERY_BLOCK = 2_000
#: Terms of all questions up to which they are sent to every task, and pairs of a document and a question in one part of the scores.
SENT, PAIRS = 200_000, 500_000


def _top(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def bm25(docs: DataFrame, questions: DataFrame, k: int = TOP_K * POOL, scopes: DataFrame | None = None, stems=None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each question.

    Statistics are of the whole table, whatever the scope.  Only the questions' terms are kept after the tokens of a document
    are laid out, and they are exchanged by document, so that a term of all documents is no group of its own.  Ties go to the smaller doc_id.  ``stems``, a function of an array
    column, makes terms that share a stem one term: it sees each distinct token once, and no token of a document.
    """
    asked = questions.select("query_id", F.explode(X.search_terms(F.col("text"))).alias("term"))
    few = asked.select("term").distinct().limit(SENT + 1).count() <= SENT
    sent = F.broadcast if few else lambda x: x
    words = docs.select("doc_id", X.tokens(F.col("text")).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    hits = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    if stems is None:
        hits = hits.join(sent(asked.select("term").distinct()), "term")
    else:
        asked = asked.withColumn("term", F.get(stems(F.array("term")), F.lit(0)))
        forms = hits.select("term").distinct().select(F.col("term").alias("form"), F.get(stems(F.array("term")), F.lit(0)).alias("term"))
        hits = hits.withColumnRenamed("term", "form").join(sent(forms.join(sent(asked.select("term").distinct()), "term")), "form")
    # all of a document is in one part, where it meets its questions; a part holds a bounded number of such pairs, so parts grow with both tables
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * questions.count() // PAIRS))
    tf = hits.select("doc_id", "term", "dl").repartition(parts, "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("dl").alias("df"))  # of dl, which is never null, so that both uses of tf read one exchange
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"), "avgdl")  # stats is one row
    part = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    found = tf.join(sent(idf), "term").select("term", "doc_id", part.alias("part"))
    if scopes is not None:
        found = found.join(docs.join(scopes, "source", "left_semi").select("doc_id"), "doc_id", "left_semi")
    scored = found.join(sent(asked), "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return _top(scored, k, ["query_id"], F.desc(F.round("score", 9)), "doc_id")


def _held(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term): the terms, of letters and digits, that texts hold.  Such a term lies within a run of letters and digits, so the corpus's distinct
    runs are cut into pieces as long as terms are, the pieces meet the terms, and the runs their documents, each by equality."""
    sizes = sorted(r.n for r in terms.select(F.length("term").alias("n")).distinct().collect())  # as many as a term has characters
    runs = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))).alias("run"))

    def cut(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length("run") - n + 1)
        return F.when(F.length("run") >= n, F.transform(at, lambda i: F.substring("run", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    pieces = runs.select("run").distinct().select("run", F.explode(F.array_distinct(F.concat(*map(cut, sizes)))).alias("term"))
    return runs.join(pieces.join(terms, "term"), "run").select("doc_id", "term").distinct()


def substring_hits(docs: DataFrame, terms: DataFrame, k: int = 8, block: int = 2_000) -> DataFrame:
    """(query_id, doc_id, score, rank): documents whose text holds one of the question's terms (query_id, term) anywhere, ASCII case aside; all
    count 1, the first ``k`` by doc_id.

    Terms of letters and digits are found by equality joins.  Others, if there are any, go to the documents in blocks of about ``block``;
    a document is read once a block and gives the terms it holds.
    """
    known = terms.where("term <> ''").select("term").distinct()
    plain = F.col("term").rlike("^[a-z0-9]+$")
    simple, odd = known.where(plain), known.where(~plain)
    n, m = (df.count() for df in (odd, simple))
    parts = [_held(docs, simple)] if m or not n else []
    if n:
        blocks = odd.groupBy(F.pmod(F.xxhash64("term"), F.lit(-(-n // block))).alias("block")).agg(F.collect_list("term").alias("some"))  # a stated set of questions
        parts.append(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).crossJoin(F.broadcast(blocks)).select("doc_id", F.explode(F.filter("some", lambda t: F.contains(F.col("low"), t))).alias("term")))
    held = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    hits = held.join(terms, "term").select("query_id", "doc_id").distinct().withColumn("score", F.lit(1.0))
    return _top(hits, k, ["query_id"], "doc_id")


def cosine(vectors: DataFrame, questions: DataFrame, k: int = TOP_K * POOL, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): the nearest vectors (doc_id, embedding) of each question (query_id, embedding).

    Exact.  Questions go to the executors in blocks of a bounded size; each task keeps its own best k of a question, so what is exchanged does
    not depend on the number of vectors in a task.  A zero vector has similarity 0.
    """
    rows = questions.select("query_id", "embedding").orderBy("query_id").toLocalIterator()
    held, out = [], None

    def arm(some: list) -> DataFrame:
        ids = np.array([r[0] for r in some])
        q = np.array([r[1] for r in some], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top_s, top_d = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                d = b.column(0).to_numpy(zero_copy_only=False)
                v = np.array(b.column(1).to_pylist(), np.float64)
                n = np.linalg.norm(v, axis=1)
                s = np.round(q @ (v / np.where(n > 0, n, 1)[:, None]).T, 9)
                top_s, top_d = np.concatenate([top_s, s], 1), np.concatenate([top_d, np.broadcast_to(d, s.shape)], 1)
                at = np.lexsort((top_d, -top_s), axis=1)[:, :k]
                top_s, top_d = np.take_along_axis(top_s, at, 1), np.take_along_axis(top_d, at, 1)
            m = top_s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(top_d.ravel()), pa.array(top_s.ravel())], names=["query_id", "doc_id", "score"])

        return vectors.where("embedding is not null").select("doc_id", "embedding").mapInArrow(best, "query_id long, doc_id long, score double")

    for r in rows:
        held.append(r)
        if len(held) == block:
            out = arm(held) if out is None else out.unionByName(arm(held))
            held = []
    if held or out is None:
        if not held:
            return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank long")
        out = arm(held) if out is None else out.unionByName(arm(held))
    return _top(out, k, ["query_id"], F.desc("score"), "doc_id")


def rrf(dense: DataFrame, lexical: DataFrame, k: int = TOP_K * POOL) -> DataFrame:
    """(query_id, doc_id, score, rank): reciprocal rank fusion of two rankings; ties go to the dense arm, then to the better rank."""
    both = dense.select("query_id", "doc_id", "rank", F.lit(1).alias("dense")).unionByName(lexical.select("query_id", "doc_id", "rank", F.lit(0).alias("dense")))
    fused = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.max("dense").alias("dense"), F.min("rank").alias("first"))
    return _top(fused, k, ["query_id"], F.desc(F.round("score", 9)), F.desc("dense"), "first", "doc_id").select("query_id", "doc_id", "score", "rank")


def recency_rerank(ranked: DataFrame, weight: float = RECENCY) -> DataFrame:
    """Lift scores by how new a document is among its question's candidates; unknown dates count as the middle, and without any nothing changes."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("modified").over(w), F.max("modified").over(w)
    share = F.when(F.col("modified").isNull() | (hi == lo), 0.5).otherwise((F.col("modified") - lo) / (hi - lo))
    lifted = ranked.withColumn("score", F.when(hi.isNull(), F.col("score")).otherwise(F.col("score") * (1 + weight * share)))
    return lifted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "rank")).cast("long"))


def diversify(ranked: DataFrame, group: str, most: int = PER_DOC, k: int = TOP_K) -> DataFrame:
    """At most ``most`` hits of a group, then the best k; 0 lifts the limit."""
    if most:
        ranked = ranked.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))).where(F.col("__n") <= most).drop("__n")
    return _top(ranked, k, ["query_id"], "rank")


def context_budget(ranked: DataFrame, budget: int = BUDGET, rest: int = REST) -> DataFrame:
    """Pack hits in rank order: whole while they fit, then a last one cut to what is left if that is at least ``rest``."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    packed = ranked.withColumn("__left", left).where((F.length("text") <= F.col("__left")) | (F.col("__left") >= rest))
    return packed.withColumn("text", F.substr("text", F.lit(1), F.least(F.col("__left"), F.length("text")).cast("int"))).drop("__left")


def hybrid_search(docs: DataFrame, vectors: DataFrame, questions: DataFrame, question_vectors: DataFrame, k: int = TOP_K, stems=None) -> DataFrame:
    """(query_id, rank, doc_id, source, score, text): the context of each question; ``stems`` as in bm25()."""
    fused = rrf(cosine(vectors, question_vectors, k * POOL), bm25(docs, questions, k * POOL, stems=stems), k * POOL)
    hydrated = fused.join(docs.select("doc_id", "source", "modified", "text"), "doc_id")
    best = diversify(recency_rerank(hydrated), "source", PER_DOC, k)
    return context_budget(best).select("query_id", "rank", "doc_id", "source", F.round("score", 6).alias("score"), "text")


def discover_collections(ranked: DataFrame, per: int = 3) -> DataFrame:
    """(query_id, source, hits, top_score, best_doc): scopes by their best hit, with the first hits of each."""
    top = _top(ranked, per, ["query_id", "source"], F.desc(F.round("score", 9)), "doc_id")
    return top.groupBy("query_id", "source").agg(F.count("*").alias("hits"), F.max("score").alias("top_score"), F.min_by("doc_id", "rank").alias("best_doc"))


def mean_vector(vectors: DataFrame, by: str) -> DataFrame:
    """(by, pos, mean): the elementwise mean of each group's vectors."""
    return vectors.select(by, F.posexplode("embedding").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def cosine_of(a, b):
    """Cosine of two array columns; 0 if one is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def relevance_filter(vectors: DataFrame, intents: DataFrame, least: float = 0.70, most: int = 15) -> DataFrame:
    """The best vectors of each label of at least ``least`` similarity to the label's intent vector."""
    scored = vectors.join(intents, "label").select("label", "doc_id", cosine_of(F.col("embedding"), F.col("intent")).alias("score")).where(F.col("score") >= least)
    return _top(scored, most, ["label"], F.desc(F.round("score", 9)), "doc_id")


def relevant(vectors: DataFrame, intents: DataFrame, least: float = 0.70, most: int = 15) -> DataFrame:
    """(label, doc_id, rank, score, had_any_match): relevance_filter for the labels with an intent vector; of a label without one the first ``most``,
    unfiltered and without a score; a label whose vectors all fall short keeps one row without a document that says so."""
    known = relevance_filter(vectors, intents, least, most).select("label", "doc_id", "rank", "score", F.lit(True).alias("had_any_match"))
    bare = _top(vectors.join(intents, "label", "left_anti").select("label", "doc_id"), most, ["label"], "doc_id").select("label", "doc_id", "rank", F.lit(None).cast("double").alias("score"), F.lit(True).alias("had_any_match"))
    short = vectors.select("label").distinct().join(intents, "label", "left_semi").join(known.select("label").distinct(), "label", "left_anti")
    none = short.select("label", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("had_any_match"))
    return known.unionByName(bare).unionByName(none)
