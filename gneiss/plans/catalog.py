"""All queries of the engine's own operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import code, stem
from gneiss.functions import text as X
from gneiss.operators import chunking, context, control, dedup, graphs, ontology, relations, retrieval, rollups, web
from gneiss.plans import scopes as more
from gneiss.plans import rounds, streams, terms
from gneiss.plans import sql as Q
from gneiss.sources import sinks
from gneiss.sources.tables import documents, questions, table, vectors
from gneiss.streaming import jobs

_all: dict = {}
_more = [m.registry for m in (streams, rounds, terms)]


def query(f):
    _all[f.__name__] = f
    return f


def queries() -> dict:
    return _all | more.queries() | {k: f for r in _more for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in Q.ORACLE.items() if k in _all} | more.oracle_sql() | {k: q for r in _more for k, q in r.sql.items()}


def _question_vectors(s, d) -> DataFrame:
    v = vectors(s, d).withColumnRenamed("doc_id", "query_id").select("query_id", "embedding")
    return questions(s, d).select("query_id").join(v, "query_id")


def _doc_vectors(s, d) -> DataFrame:
    return vectors(s, d).join(documents(s, d).select("doc_id"), "doc_id", "left_semi")


def _dense(s, d):
    return retrieval.cosine(_doc_vectors(s, d), _question_vectors(s, d))


def _lexical(s, d):
    return retrieval.bm25(documents(s, d), questions(s, d))


def _fused(s, d):
    return retrieval.rrf(_dense(s, d), _lexical(s, d)).join(documents(s, d).select("doc_id", "source", "modified", "text"), "doc_id")


# ---------------------------------------------------------------- corpus


@query
def corpus_stats(s, d):
    return rollups.corpus_stats(documents(s, d), vectors(s, d))


@query
def status_tally(s, d):
    return rollups.with_status(documents(s, d), vectors(s, d)).groupBy("status").agg(F.count("*").alias("n"))


@query
def missing_vectors(s, d):
    return rollups.missing_vectors(documents(s, d), vectors(s, d))


@query
def scope_documents(s, d):
    scopes = s.createDataFrame([("src1",), ("src2",)], "source string")
    return documents(s, d).join(scopes, "source", "left_semi").select("doc_id", "source", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query
def document_ids(s, d):
    return documents(s, d).select("doc_id", X.document_id(F.col("source"), F.col("text")).alias("content_id"), X.chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.col("text")).alias("chunk_id"))


@query
def content_duplicates(s, d):
    return dedup.content_duplicates(documents(s, d))


@query
def collections_overview(s, d):
    stats, tally = rollups.corpus_stats(documents(s, d), vectors(s, d)), rollups.with_status(documents(s, d), vectors(s, d)).groupBy("source").agg(F.count_if(F.col("status") == "indexed").alias("indexed"))
    return stats.join(tally, "source").withColumn("graph", F.when(F.col("indexed") == F.col("chunks"), "ready").otherwise("stale"))


# ---------------------------------------------------------------- conversations


@query
def recent_turns(s, d):
    return rollups.last_rows(table(s, d, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role")


@query
def message_counts(s, d):
    c = table(s, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("prompts"), F.max("turn").alias("last_turn"))


@query
def autotitle(s, d):
    first = table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    return first.select("conv_id", X.autotitle(F.col("prompt")).alias("title"))


@query
def list_conversations(s, d):
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("updated"))
    return c.where("messages > 2").orderBy(F.desc("updated"), "conv_id").limit(50)


@query
def prompt_history(s, d):
    c = table(s, d, "conversations")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    kept = F.when((F.col("role") == "assistant") & (F.col("turn") == last), 4000).otherwise(600)
    return c.select("conv_id", "turn", F.length(F.substr("text", F.lit(1), kept)).alias("kept_chars"))


# ---------------------------------------------------------------- text


@query
def score_text(s, d):
    return documents(s, d).select("doc_id", X.score_text(F.col("text")).alias("quality"), X.score_warnings(F.col("text")).alias("warnings"))


@query
def classify_level(s, d):
    return documents(s, d).select("doc_id", X.classify(F.col("text"), F.col("source")).alias("level"))


@query
def pii_tags(s, d):
    return documents(s, d).select("doc_id", X.pii_tags(F.col("text")).alias("tags"))


@query
def extract_urls(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.posexplode(X.urls(F.col("text"))).alias("pos", "url"))


@query
def junk_ratio(s, d):
    return documents(s, d).select("doc_id", F.round(X.junk_ratio(F.col("text")), 6).alias("junk"))


@query
def clean_text(s, d):
    return documents(s, d).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("cleaned"))


@query
def snippets(s, d):
    return documents(s, d).select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query
def sentence_split(s, d):
    return documents(s, d).select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"), F.array_max(F.transform(X.sentences(F.col("text")), lambda x: F.length(x))).cast("long").alias("longest"))


@query
def title_case_entities(s, d):
    return documents(s, d).select("doc_id", F.array_join(X.title_entities(F.col("text")), "|").alias("entities"))


@query
def keywords_topk(s, d):
    words = documents(s, d).select("doc_id", F.posexplode(X.keyword_tokens(F.col("text"))).alias("pos", "word"))
    n = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("rank", rank.cast("long")).where("rank <= 8").select("doc_id", "rank", "word", "n")


@query
def word_counts(s, d):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(X.CLOUD_WORD), F.lit(0))
    by_form = documents(s, d).select(F.explode(found).alias("form")).groupBy("form").agg(F.count("*").alias("n")).withColumn("word", F.lower("form")).where((F.length("form") >= 3) & ~F.col("word").isin(X.CLOUD_STOP_WORDS))
    best = F.min(F.struct((-F.col("n")).alias("k"), "form"))["form"]
    return by_form.groupBy("word").agg(F.sum("n").alias("n"), best.alias("display")).orderBy(F.desc("n"), "word").limit(60)


@query
def word_sizes(s, d):
    c = word_counts(s, d)
    w = Window.partitionBy(F.lit(1))  # 60 rows
    share = (F.col("n") - F.min("n").over(w)) / F.greatest(F.max("n").over(w) - F.min("n").over(w), F.lit(1))
    return c.select("word", F.round(15 + F.sqrt(share) * (68 - 15), 6).alias("size"))


# ---------------------------------------------------------------- retrieval


@query
def bm25_unstemmed(s, d):
    return _lexical(s, d).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query
def cosine_topk(s, d):
    return _dense(s, d).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query
def rrf_fusion(s, d):
    return retrieval.rrf(_dense(s, d), _lexical(s, d)).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query
def recency_rerank(s, d):
    return retrieval.recency_rerank(_fused(s, d)).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query
def diversify(s, d):
    return retrieval.diversify(_fused(s, d), "source", 1).select("query_id", "rank", "doc_id", "source")


@query
def context_budget(s, d):
    return retrieval.context_budget(_fused(s, d)).select("query_id", "rank", "doc_id", F.length("text").cast("long").alias("chars"))


@query
def hybrid_search(s, d):
    out = retrieval.hybrid_search(documents(s, d), _doc_vectors(s, d), questions(s, d), _question_vectors(s, d))
    return out.select("query_id", "rank", "doc_id", "source", "score", F.length("text").cast("long").alias("chars"))


@query
def hybrid_stemmed(s, d):
    """The same over stems; tests hold its lexical arm against SQLite's index."""
    out = retrieval.hybrid_search(documents(s, d), _doc_vectors(s, d), questions(s, d), _question_vectors(s, d), stems=stem.stems)
    return out.select("query_id", "rank", "doc_id", "source", "score", F.length("text").cast("long").alias("chars"))


@query
def collection_discovery(s, d):
    return retrieval.discover_collections(_lexical(s, d).join(documents(s, d).select("doc_id", "source"), "doc_id")).withColumn("top_score", F.round("top_score", 6))


@query
def like_search(s, d):
    terms = questions(s, d).select("query_id", F.explode(X.search_terms(F.col("text"), 6)).alias("term")).distinct()
    return retrieval.substring_hits(documents(s, d), terms)


@query
def mean_intent_vector(s, d):
    return retrieval.mean_vector(vectors(s, d), "label").select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query
def relevance_filter(s, d):
    m = retrieval.mean_vector(vectors(s, d), "label").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("v"))
    return retrieval.relevance_filter(vectors(s, d), m.select("label", F.transform("v", lambda x: x["mean"]).alias("intent")), 0.2).select("label", "rank", "doc_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- duplicates


def _pairs(s, d):
    return dedup.shared(dedup.fingerprints(documents(s, d)))


@query
def fingerprint_pairs(s, d):
    return _pairs(s, d)


@query
def near_duplicates(s, d):
    return dedup.near(_pairs(s, d)).withColumn("jaccard", F.round("jaccard", 6))


@query
def containment(s, d):
    return dedup.contained(_pairs(s, d)).withColumn("coverage", F.round("coverage", 6))


@query
def absorbed(s, d):
    return dedup.absorbed(dedup.contained(_pairs(s, d))).withColumn("coverage", F.round("coverage", 6))


@query
def near_components(s, d):
    return graphs.components(dedup.near(_pairs(s, d)).select("a", "b"))


@query
def complete_linkage(s, d):
    links = dedup.near(_pairs(s, d)).select("a", "b")
    groups = dedup.linkage(links, graphs.components(links))
    size = dedup.fingerprints(documents(s, d)).groupBy("doc_id").agg(F.count("*").alias("size"))
    return dedup.survivors(groups, documents(s, d).select("doc_id", "modified").join(size, "doc_id")).select("cluster", "doc_id", "role")


@query
def file_families(s, d):
    names = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, " v2").when(F.col("p_partkey") % 3 == 1, "_final").otherwise(""), F.lit(".docx")).alias("file_name"))
    return dedup.families(names)


# ---------------------------------------------------------------- graphs


@query
def mention_explode(s, d):
    return graphs.mentions(documents(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "raw", "name")


@query
def entity_exact_clusters(s, d):
    return graphs.exact_clusters(graphs.mentions(documents(s, d)))


@query
def cooccurrence_edges(s, d):
    return graphs.cooccurrence(graphs.mentions(documents(s, d)))


@query
def neighbourhood(s, d):
    ms = graphs.mentions(documents(s, d))
    seeds = ms.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(8).select(F.col("name").alias("seed"))
    return graphs.neighbourhood(graphs.cooccurrence(ms), seeds)


@query
def edge_stats(s, d):
    ms = graphs.mentions(documents(s, d))
    e = graphs.cooccurrence(ms).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return ms.agg(F.count_distinct("name").alias("nodes"), F.count("*").alias("mentions")).crossJoin(e)  # one row each


@query
def candidate_terms(s, d):
    return graphs.candidate_terms(documents(s, d))


@query
def entity_resolution(s, d):
    ms = graphs.checkpointed(graphs.mentions(documents(s, d), None).select("doc_id", "source", "pos", "name"))  # names are found once
    width = (ms.agg(F.max("pos")).first()[0] or 0) + 1
    near = ms.groupBy("doc_id").agg(F.collect_set("name").alias("near"))
    full = ms.join(near, "doc_id").select((F.col("doc_id") * width + F.col("pos")).alias("mention_id"), "doc_id", F.col("source").alias("uri"), F.lit("PROPN").alias("label"), "name", F.array_except("near", F.array("name")).alias("near"), F.array().cast("array<string>").alias("keywords"))
    found = graphs.resolved(full)
    return found.groupBy("label").agg(F.count("*").alias("mentions"))


# ---------------------------------------------------------------- ontology


def _relations(s, d) -> DataFrame:
    kinds = F.array(*map(F.lit, ["Service", "Team", "Tool", "Risk", "Control"]))
    preds = F.array(*map(F.lit, ["USES", "MITIGATES", "DEPENDS_ON", "ALTERNATIVE_TO", "OWNED_BY", "OTHER", "FORBIDDEN", "UNHEARD"]))
    o = table(s, d, "lineitem")
    pick = lambda a, k: F.get(a, (k % F.size(a)).cast("int"))
    return o.select("l_orderkey", "l_linenumber", pick(preds, F.col("l_partkey")).alias("predicate"), pick(kinds, F.col("l_suppkey")).alias("subject_class"), pick(kinds, F.col("l_linenumber") + F.col("l_orderkey")).alias("object_class"))


@query
def type_gate(s, d):
    g = ontology.type_gate(_relations(s, d), ontology.constraints(s))
    # the verdicts follow from the first three; as keys they are counted by hash, where a first() of strings would sort all relations
    by = g.groupBy("predicate", "subject_class", "object_class", "ok", "inversion_valid", "reason", "component").agg(F.count("*").alias("n"))
    return by.select("predicate", "subject_class", "object_class", "n", "ok", "inversion_valid", "reason", "component")


@query
def claim_confidence(s, d):
    g = ontology.type_gate(_relations(s, d), ontology.constraints(s)).withColumn("self", (F.col("l_orderkey") % 11) / 10.0)
    g = g.withColumn("confidence", ontology.confidence(F.col("self"), F.col("predicate"), F.col("component")))
    return g.groupBy("confidence", (~F.col("ok") | (F.col("confidence") < 0.35)).alias("quarantined")).agg(F.count("*").alias("n"))


@query
def unmitigated_risks(s, d):
    """Customers stand for risks and their orders of high priority for mitigations."""
    risks = table(s, d, "customer").select(F.col("c_custkey").alias("risk"), "c_mktsegment")
    return risks.join(table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("risk")), "risk", "left_anti")


@query
def impact_closure(s, d):
    """Everything that a nation depends on, at once or through others, and over how few steps."""
    edges = table(s, d, "nation").select((F.col("n_nationkey")).alias("a"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("b")).where("a <> b")
    return graphs.closure(edges)


@query
def claim_sets(s, d):
    r = _relations(s, d).select(F.col("subject_class").alias("subject"), "predicate", F.col("object_class").alias("object"), "l_linenumber")
    return ontology.mutually_exclusive(r.where("l_linenumber = 1"), r.where("l_linenumber = 5"))


@query
def entailment_policy(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("entail"), (F.col("l_tax") * 10).alias("contradict"), ((F.col("l_partkey") % 10) / 10.0).alias("flipped_entail"), (F.col("l_returnflag") == "R").alias("negated"), (F.col("l_linestatus") == "O").alias("symmetric"))
    return ontology.entailment_policy(rows).groupBy("negated", "symmetric", "decision").agg(F.count("*").alias("n"))


#: Forms of the synthetic corpus, as a small vocabulary.
VOCABULARY = ontology.Gazetteer({"Licence": {"MIT License": [], "Apache License": ["Apache License, Version 2.0"], "GNU General Public License": ["GPL"], "CC BY-NC": ["CC BY-NC 4.0"]}, "Vendor": {"All rights reserved": []}}, {"License": ["MIT License", "Apache License"]})


@query
def gazetteer_find(s, d):
    return ontology.gazetteer_mentions(documents(s, d), VOCABULARY)


@query
def entity_build(s, d):
    return ontology.entity_build(ontology.gazetteer_mentions(documents(s, d), VOCABULARY))


@query
def trigger_budget(s, d):
    return ontology.trigger_budget(ontology.gazetteer_mentions(documents(s, d), VOCABULARY))


# ---------------------------------------------------------------- runs


@query
def telemetry_rollup(s, d):
    return rollups.telemetry(table(s, d, "events"))


@query
def keyset_page(s, d):
    return rollups.keyset_page(table(s, d, "events").select("event_id", "user_id", "event_type"), "event_id", 500, 100)


@query
def prune_events(s, d):
    return rollups.last_rows(table(s, d, "events"), "user_id", "event_id", 20).select("user_id", "event_id")


@query
def lease_expiry(s, d):
    return rollups.expired(table(s, d, "events"), 3600)


@query
def job_progress(s, d):
    return rollups.progress(table(s, d, "events"), {"signup": 10.0, "click": 20.0, "view": 30.0, "purchase": 35.0, "error": 5.0})


@query
def latest_job_state(s, d):
    return rollups.latest_state(table(s, d, "events"))


@query
def plateau(s, d):
    e = table(s, d, "events").where("event_type = 'view'").select("user_id", "event_id", "value")
    return rollups.plateau(e, "user_id", "event_id", "value", 5.0).groupBy("user_id").agg(F.count_if("plateaued").alias("plateaus"), F.round(F.sum("gain"), 4).alias("gain"))


@query
def best_attempt(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "value", "event_type")
    return rollups.best_attempt(e, "user_id", "event_id", "value")


@query
def stagnation_islands(s, d):
    return rollups.stagnation(table(s, d, "events"), "user_id", "event_id", "event_type")


def _tasks(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_type") == "click", "retriever").otherwise(F.col("event_type")).alias("agent"), F.lower(F.trim("props")).alias("payload"))


@query
def dispatch_budget(s, d):
    return rollups.dispatch(_tasks(s, d), ["retriever", "view", "purchase", "signup"]).groupBy("run", "agent", "decision").agg(F.count("*").alias("n"))


@query
def duplicate_tasks(s, d):
    return _tasks(s, d).groupBy("agent", "payload").agg(F.count("*").alias("n"), F.min("step").alias("first")).where("n > 1")


@query
def job_stats(s, d):
    o = table(s, d, "orders")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("jobs"), F.round(F.coalesce(F.sum(F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("total"))


@query
def jobs_page(s, d):
    j = table(s, d, "orders").join(table(s, d, "customer"), F.expr("o_custkey = c_custkey"), "left")
    return j.select("o_orderkey", "o_orderdate", "c_name").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


@query
def job_phases(s, d):
    """Jobs with their first and last phase and the phases' total."""
    l = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("phases"), F.round(F.sum("l_quantity"), 2).alias("total"), F.max(F.struct("l_linenumber", "l_linestatus"))["l_linestatus"].alias("last"))  # noqa: E741
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus").join(l, F.expr("o_orderkey = l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.coalesce("phases", F.lit(0)).alias("phases"), "total", "last")


@query
def queue_head(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("next_job"))


@query
def merge_counts(s, d):
    """Branches count by agent, in maps of one entry per agent, which are merged by adding."""
    branch = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return branch.select(F.explode("m").alias("agent", "v")).groupBy("agent").agg(F.sum("v").alias("n"))


@query
def late_results(s, d):
    """A later result counts only if it has more words than any before it from the same source."""
    w = documents(s, d).select("source", "doc_id", F.size(X.tokens(F.col("text"))).alias("words"))
    before = F.max("words").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return w.withColumn("best", before).where("words > coalesce(best, 0)").select("source", "doc_id", F.col("words").cast("long").alias("words"))


@query
def hourly_windows(s, d):
    return jobs.windowed(table(s, d, "events"))


@query
def worker_leases(s, d):
    return jobs.leases(table(s, d, "events"), "3600 seconds")


@query
def distinct_messages(s, d):
    return jobs.distinct_messages(table(s, d, "events")).groupBy("event_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- pages


@query
def page_hosts(s, d):
    return table(s, d, "pages").select(web.host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("pages"))


@query
def url_dates(s, d):
    p = table(s, d, "pages").select("page_id", web.url_date(F.concat("url", F.lit("/2024-01-"), F.lpad(((F.col("page_id") % 28) + 1).cast("string"), 2, "0"))).alias("day"))
    return p.select("page_id", F.round(X.recency(F.col("day"), F.lit("2024-01-20").cast("timestamp"), 240), 6).alias("score"))


@query
def blocked_pages(s, d):
    return table(s, d, "pages").select("page_id", web.blocked(F.col("html")).alias("blocked"), F.length("html").cast("long").alias("chars"))


@query
def page_extract(s, d):
    return web.extract(table(s, d, "pages"))


@query
def page_links(s, d):
    return web.page_links(table(s, d, "pages"))


@query
def chunk_prose(s, d):
    return chunking.chunk(documents(s, d))


@query
def html_tables(s, d):
    return web.table_rows(table(s, d, "pages")).select("page_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query
def page_content(s, d):
    """What a page gives to a context: its tables, then its text."""
    pages = table(s, d, "pages")
    rows = web.table_rows(pages).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "row_no", "cells"))), lambda r: F.array_join(r["cells"], " | ")), "\n").alias("tables"))
    return web.extract(pages).select("page_id", "text").join(rows, "page_id", "left").select("page_id", context.compose(F.col("text"), F.col("tables")).alias("content"))


@query
def page_alternates(s, d):
    amp = F.regexp_extract("html", r'(?i)<link[^>]*rel="?amphtml"?[^>]*href="([^"]+)"', 1)
    return table(s, d, "pages").select("page_id", F.array_join(context.alternates(F.col("url"), amp), " ").alias("others"))


@query
def chunk_code(s, d):
    return chunking.chunk(documents(s, d), "code")


# ---------------------------------------------------------------- context of a question


@query
def porter_bm25(s, d):
    found = retrieval.bm25(documents(s, d), questions(s, d), stems=stem.stems)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query
def artifact_packing(s, d):
    files = documents(s, d).select(F.col("source").alias("scope"), "doc_id", F.octet_length("text").alias("bytes"), F.length("text").alias("chars"))
    return context.pack_files(files).select("scope", "doc_id", "captured")


@query
def latest_revision(s, d):
    docs = documents(s, d)
    files = docs.select(F.col("source").alias("scope"), "doc_id", F.concat(F.lit("doc"), F.col("n_chars") % 40, F.lit(".txt")).alias("file_name"), F.col("doc_id").alias("created"))
    wanted = docs.select(F.col("doc_id").alias("request"), F.col("source").alias("scope"), F.concat(F.lit(" Doc"), F.col("n_chars") % 60, F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise("")).alias("name"))
    return context.resolve_file(wanted, files)


@query
def prompt_blocks(s, d):
    hits = _fused(s, d).select("query_id", "rank", F.col("source").alias("file_name"), F.col("modified").cast("string").alias("modified"), F.col("doc_id").cast("string").alias("chunk"), F.round(F.col("score") * 1000000).cast("long").alias("score"), "text")
    return context.prompt_blocks(hits).select("query_id", "rank", F.md5("block").alias("block"))


@query
def hydrate_facts(s, d):
    return context.hydrate(_fused(s, d), graphs.mentions(documents(s, d)))


@query
def question_context(s, d):
    """All that a question is given: its best document whole if it is short, excerpts of its other hits, and facts around them."""
    from gneiss.streaming.replay import new_folder

    folder = new_folder(s, "hits")
    _fused(s, d).write.parquet(folder)  # read three times
    hits = s.read.parquet(folder)
    name = F.concat(F.lit("doc"), "doc_id", F.lit(".txt"))
    whole = hits.where((F.col("rank") == 1) & (F.length("text") <= 8000)).select("query_id", name.alias("file_name"), "text")
    said = hits.where("rank <= 6").select("query_id", "rank", name.alias("file_name"), F.col("modified").cast("string").alias("modified"), F.col("doc_id").cast("string").alias("chunk"), F.round(F.col("score") * 1000000).cast("long").alias("score"), "text")
    facts = context.hydrate(hits, graphs.mentions(documents(s, d)))
    return context.question_context(said, whole, facts).select("query_id", "place", "kind", F.md5("block").alias("block"))


@query
def trace_node_cap(s, d):
    return graphs.cap_nodes(hydrate_facts(s, d).select("query_id", "a", "b", "weight"), 15)


# ---------------------------------------------------------------- relations of the vocabulary


RELATION_RULES = {"alternativeTo": (["Licence"], ["Licence"], ["same_class", "symmetric"]), "supersedes": (["Licence"], ["Licence"], ["same_class"]), "governedBy": (["Vendor"], ["Licence"], [])}


def _scanned(s, d):
    return relations.scan(documents(s, d), VOCABULARY)


@query
def cascade_relations(s, d):
    return relations.judged(_scanned(s, d), ontology.constraints(s, RELATION_RULES)).select("doc_id", "start", "subject", "predicate", "object", "decision", "why")


@query
def cascade_funnel(s, d):
    return relations.funnel(_scanned(s, d), ontology.constraints(s, RELATION_RULES), 1)


@query
def trigger_filter(s, d):
    return documents(s, d).select("doc_id", relations.has_trigger(F.col("text")).alias("relational"))


@query
def calibration(s, d):
    out = relations.separation(table(s, d, "lineitem").select((F.col("l_returnflag") == "N").alias("valid"), F.col("l_discount").alias("score")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query
def escalations(s, d):
    """Relations by why they may not be settled cheaply."""
    g = ontology.type_gate(_relations(s, d), ontology.constraints(s))
    why = relations.must_escalate(F.when(F.col("predicate") == "USES", "supersedes").otherwise(F.col("predicate")), F.col("ok"), F.col("l_linenumber") < 5, F.col("predicate") == "OTHER")
    return g.groupBy(why.alias("why")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- control, files and changes


@query
def critic_routes(s, d):
    e = table(s, d, "events").where("event_type = 'view'").select("user_id", "event_id", "value")
    return control.review(e, "user_id", "event_id", "value").select("user_id", "event_id", "review", "route")


@query
def reclaim_jobs(s, d):
    o = table(s, d, "orders")
    jobs_ = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("claimed").alias("status"), F.col("o_orderdate").alias("heartbeat"))
    return control.reclaim(jobs_, F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", "status", "reclaimed")


@query
def field_stream(s, d):
    """Every turn as a JSON object that arrives in pieces of seven characters, decoded again."""
    c = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("run"), F.to_json(F.struct("role", F.col("text").alias("final_response"))).alias("j"))
    tokens = c.select("run", F.posexplode(F.regexp_extract_all("j", F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "token"))
    said = control.field_deltas(tokens, "final_response").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("p"))
    return said.select("run", F.md5(F.array_join(F.transform("p", lambda x: x["delta"]), "")).alias("field"))


@query
def span_conversations(s, d):
    id_ = F.concat(F.lit("c"), F.col("user_id"))
    attributes = F.when(F.col("event_type") == "view", F.create_map(F.lit("attributes.metadata.conversation_id"), id_)).when(F.col("event_type") == "click", F.create_map(F.lit("attributes.metadata"), F.concat(F.lit('{"conversation_id": "'), id_, F.lit('"}')))).when(
        F.col("event_type") == "error", F.create_map(F.lit("attributes.tag.tags"), F.concat(F.lit('["turn", "conversation:'), id_, F.lit('"]')))
    )
    return table(s, d, "events").select("event_id", control.conversation_of(attributes).alias("conversation"))


@query
def upload_checks(s, d):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    cap = F.when(F.col("lang") != "es", 20_000)
    docs = documents(s, d).select("doc_id", F.length("text").alias("size"), "lang", n.alias("n"))
    return docs.select("doc_id", control.upload_reason(F.col("lang"), F.col("size"), cap, F.col("n"), 40).alias("refused"))


@query
def code_scores(s, d):
    q = code.code_quality(F.col("text"), "python")
    return documents(s, d).select("doc_id", q["score"].alias("score"), F.array_join(q["warnings"], ",").alias("warnings"))


@query
def safe_names(s, d):
    return table(s, d, "pages").select("page_id", code.safe_name(F.col("url")).alias("name"), code.vendored(F.col("url")).alias("vendored"))


@query
def merge_rows(s, d):
    """Suppliers merged into customers by key; an account balance below zero leaves the old one."""
    new = table(s, d, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("c_acctbal"))
    return sinks.merge(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), new, ["c_custkey"], ["c_acctbal"])


@query
def cascade_delete(s, d):
    """Orders and lines that are left once the customers of the first nation are gone."""
    gone = table(s, d, "customer").where("c_nationkey = 1").select("c_custkey")
    o, l = sinks.cascade(gone, [(table(s, d, "orders"), "o_orderkey", "o_custkey"), (table(s, d, "lineitem"), "l_orderkey", "l_orderkey")])  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.count("*").alias("lines")).join(o.select("o_orderkey"), F.expr("o_orderkey = l_orderkey"), "full_outer").select(F.coalesce("o_orderkey", "l_orderkey").alias("o_orderkey"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query
def tsv_report(s, d):
    return sinks.report(table(s, d, "benchmark").select("item_id", "text"))
