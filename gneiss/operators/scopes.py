"""Scopes, collections, folders and runs as tables, and reports over mentions, clusters and validations."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entities that a chunk must name, those it lists at most, the cap of the report's histogram, and of an event's message.
STRONG, LISTED, HISTOGRAM, MESSAGE = 2, 12, 6, 2000
SETTLED = ("indexed", "failed", "skipped", "quarantined", "duplicate")
GONE = ("SUPERSEDED", "ABSORBED")


# ---------------------------------------------------------------- scopes and collections


def attach(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges (scope, collection) with new ones; one that is there already is not doubled."""
    return edges.select("scope", "collection").unionByName(new.select("scope", "collection")).dropDuplicates()


def detach(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("scope", "collection"), ["scope", "collection"], "left_anti")


def scopes_for(scopes: DataFrame, edges: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(scope, rank, id): what a scope reads: itself, then its attached rows of the catalogue (id, kind, title) that are collections, by title."""
    held = edges.join(catalogue.where("kind = 'collection'").select(F.col("id").alias("collection"), "title"), "collection")
    rank = F.row_number().over(Window.partitionBy("scope").orderBy("title", "collection")).cast("long")
    own = scopes.select("scope", F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("id"))
    return own.unionByName(held.join(scopes, "scope", "left_semi").select("scope", rank.alias("rank"), F.col("collection").cast("long").alias("id")))


def namespaces(scopes: DataFrame, mapping: DataFrame) -> DataFrame:
    """scopes (id, title) with the namespace of their title (any case, trimmed) from mapping (title, namespace); null where a scope is skipped."""
    key = F.lower(F.trim("title"))
    return scopes.withColumn("__t", key).join(F.broadcast(mapping.select(key.alias("__t"), "namespace")), "__t", "left").drop("__t")  # a configuration table


def in_namespace(rows: DataFrame, namespace: str, known: tuple[str, ...]) -> DataFrame:
    """rows of one namespace; raises for an unknown one at once, and while running for a row without any."""
    if namespace not in known:
        raise ValueError(f"unknown namespace {namespace!r}")
    ok = rows.where(F.coalesce(F.col("namespace"), F.raise_error(F.lit("a row without a namespace")).cast("string")) == namespace)
    return ok


def clear_namespace(rows: DataFrame, namespace: str) -> DataFrame:
    return rows.where(~F.col("namespace").eqNullSafe(namespace))


def graph_status(before: Column, outcome: Column) -> Column:
    """What a build leaves behind: a failure keeps an older ready graph."""
    return F.when(outcome == "ok", "ready").when((outcome == "failed") & before.eqNullSafe(F.lit("ready")), "ready").when(outcome == "failed", "failed").otherwise("building")


def suffixes(given: Column) -> Column:
    """File suffixes in one form: a dot before them, lower case, blank ones left out."""
    clean = F.filter(F.transform(given, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.transform(clean, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))


def within(path: str, roots: list[str]) -> bool:
    """The path, its dots resolved, is one of the roots or lies below one."""
    parts: list[str] = []
    for p in PurePosixPath(path).parts:
        parts = parts[:-1] if p == ".." and len(parts) > 1 else parts if p == ".." else [*parts, p]
    return any(tuple(parts[: len(PurePosixPath(r).parts)]) == PurePosixPath(r).parts for r in roots)


#: Reasons for which a file was not read, by the code before a colon.
REASONS = {
    "unsupported_media_type": "This kind of file cannot be read.", "deferred_tabular": "Tables are read later.", "empty_file": "The file is empty.", "too_large": "The file is too large.",
    "encrypted": "The file is protected by a password.", "no_text": "No text was found in the file.",
}


def reason_text(code: Column) -> Column:
    """A sentence for a reason code (``code`` or ``code:detail``); an unknown code in plain words."""
    head = F.split_part(F.coalesce(code, F.lit("")), F.lit(":"), F.lit(1))
    words = F.regexp_replace(head, "_+", " ")
    plain = F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)), F.lit("."))
    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.when(head == "", "").otherwise(F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, v: k == head)), F.lit(0)), plain))


# ---------------------------------------------------------------- runs


def ingest_counters(results: DataFrame) -> DataFrame:
    """(job, ok, failed, quarantined, done, logged) of results (job, status): a degraded result counts as ok; every fiftieth is logged."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = results.groupBy("job").agg(n("ok", "degraded").alias("ok"), n("failed").alias("failed"), n("quarantined").alias("quarantined"), F.count("*").alias("done"))
    return out.withColumn("logged", F.floor(F.col("done") / 50))


def all_settled(parts: DataFrame) -> DataFrame:
    """(upload, settled): every part (upload, status) has come to an end; one that still expands has not."""
    return parts.groupBy("upload").agg(F.bool_and(F.coalesce(F.col("status").isin(*SETTLED), F.lit(False))).alias("settled"))


def event_rows(events: DataFrame) -> DataFrame:
    """events with their message cut to MESSAGE characters, ready to append."""
    return events.withColumn("message", F.substring(F.coalesce("message", F.lit("")), 1, MESSAGE))


def pseudonym(value: Column, salt: bytes) -> Column:
    """HMAC-SHA256 of a value under a salt, in hexadecimal digits; null for null."""
    import hashlib

    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in key)), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


# ---------------------------------------------------------------- chunks for a model, and reports


def without_superseded(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """docs without those whose role (doc_id, role) retires them."""
    return docs.join(roles.where(F.col("role").isin(*GONE)).select("doc_id"), "doc_id", "left_anti")


def select_chunks(ms: DataFrame, done: DataFrame, roles: DataFrame, weak: tuple[str, ...] = ("Vendor",)) -> DataFrame:
    """(doc_id, strong, listed): chunks with STRONG strong entities or more that are neither done (doc_id) nor retired, and at most LISTED of
    their entities, strong ones first, then by first place.  Ambiguous mentions count for nothing and are not listed."""
    left = without_superseded(ms.where("class <> 'ambiguous'"), roles).join(done.select("doc_id"), "doc_id", "left_anti")
    one = left.groupBy("doc_id", "canonical").agg(F.min("start").alias("at"), F.bool_or(~F.col("class").isin(*weak)).alias("strong"))
    some = one.groupBy("doc_id").agg(F.count_if("strong").alias("strong"), F.array_sort(F.collect_list(F.struct((~F.col("strong")).alias("later"), "at", "canonical"))).alias("es")).where(F.col("strong") >= STRONG)
    return some.select("doc_id", "strong", F.array_join(F.transform(F.slice("es", 1, LISTED), lambda e: e["canonical"]), "|").alias("listed"))


def gazetteer_report(docs: DataFrame, ms: DataFrame) -> DataFrame:
    """(part, key, n): mentions, per class, documents per term, mentions per document capped at HISTOGRAM, ambiguous mentions."""
    row = lambda df, part, key, n: df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    per = docs.select("doc_id").join(ms.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select(F.least(F.coalesce("n", F.lit(0)), F.lit(HISTOGRAM)).alias("n"))
    parts = [
        row(ms.agg(F.count("*").alias("n")), "mentions", F.lit(""), F.col("n")), row(ms.groupBy("class").agg(F.count("*").alias("n")), "class", F.col("class"), F.col("n")),
        row(ms.groupBy("canonical").agg(F.count_distinct("doc_id").alias("n")), "documents", F.col("canonical"), F.col("n")), row(per.groupBy("n").agg(F.count("*").alias("c")), "histogram", F.col("n"), F.col("c")),
        row(ms.agg(F.count_if(F.col("class") == "ambiguous").alias("n")), "ambiguous", F.lit(""), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def term_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents, mentions): how many texts hold a known term (term, in lower case, of letters and digits) as a word, and how often."""
    from gneiss.functions import text as X

    words = docs.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return terms.join(words, "term", "left").groupBy("term").agg(F.count("doc_id").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))


def merged_entities(shards: DataFrame) -> DataFrame:
    """(key, aliases, documents, mentions) of entities (key, alias, doc_id, n) found apart, united."""
    return shards.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"), F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("mentions"))


def validation_counts(judged: DataFrame) -> DataFrame:
    """(kind, key, n) of judged relations (rejected, predicate, proposed, status): reasons, predicates, statuses and proposals."""
    kinds = {"rejected": F.nullif(F.col("rejected"), F.lit("")), "predicate": F.col("predicate"), "status": F.col("status"), "proposed": F.nullif(F.col("proposed"), F.lit(""))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()]))
    return judged.select(each.alias("e")).where("e.key is not null").groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """(size, clusters, retired) of duplicate clusters (cluster, doc_id): how many have that size, and how many members they retire."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return size.groupBy("size").agg(F.count("*").alias("clusters")).withColumn("retired", (F.col("size") - 1) * F.col("clusters"))


def writable_claims(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """claims (namespace, subject, object) whose ends are both entities (namespace, id) of their namespace."""
    out = claims
    for end in ("subject", "object"):
        out = out.join(entities.select("namespace", F.col("id").alias(end)), ["namespace", end], "left_semi")
    return out


# ---------------------------------------------------------------- pages to read


def first_source(found: DataFrame, order: tuple[str, ...] = ("sitemap", "feed", "homepage")) -> DataFrame:
    """Of the pages (site, via, url, published, score) found for a site those of its first source that gave any, dated ones first, then by score."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("via"))
    kept = found.withColumn("__r", rank).where("__r > 0").withColumn("__b", F.min("__r").over(Window.partitionBy("site"))).where("__r = __b")
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.col("published").isNotNull().desc(), F.desc_nulls_last("score"), "url"))
    return kept.withColumn("place", place.cast("long")).drop("__r", "__b")


def routed(chunks: DataFrame, prose, code) -> DataFrame:
    """Chunks of documents (doc_id, text, extractor): source code by ``code``, all else by ``prose``; both are functions of a DataFrame."""
    native = F.coalesce(F.col("extractor").rlike("^(native_code|html_source)"), F.lit(False))
    return prose(chunks.where(~native)).unionByName(code(chunks.where(native)))


def flowchart_edges(charts: DataFrame) -> DataFrame:
    """(chart, pos, a, b, label) of flowcharts (chart, text): the arrows of each line, in order."""
    end = r"[A-Za-z0-9_]+"
    shape = r"(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})?"
    arrow = rf"({end})\s*{shape}\s*(?:-->|---|-\.->|==>)\s*(?:\|([^|]*)\|)?\s*(?=({end}))"
    rows = charts.select("chart", F.posexplode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(arrow), F.lit(i)).alias(n) for i, n in ((1, "a"), (3, "b"), (2, "label"))])).alias("pos", "e"))
    return rows.select("chart", "pos", "e.a", "e.b", F.coalesce("e.label", F.lit("")).alias("label"))


def deferred(requests: DataFrame, most: int = 6) -> DataFrame:
    """requests (run, key, seq, seconds, waited) with outcome: the first of a key in a run is scheduled while fewer than ``most`` are, a repeated
    one is a duplicate and one too many refused; a scheduled one that takes longer than it is waited for is dropped, else done."""
    first = F.row_number().over(Window.partitionBy("run", "key").orderBy("seq")) == 1
    n = F.sum(F.col("__first").cast("int")).over(Window.partitionBy("run").orderBy("seq"))
    late = F.when(F.col("seconds") > F.col("waited"), "dropped").otherwise("done")
    out = requests.withColumn("__first", first).withColumn("__n", n)
    return out.withColumn("outcome", F.when(~F.col("__first"), "duplicate").when(F.col("__n") > most, "refused").otherwise(late)).drop("__first", "__n")


def backfilled(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (path, modified) with modified filled from the files found (path, modified), and the outcome of each."""
    f = found.select("path", F.col("modified").alias("__f"), F.lit(True).alias("__there"))
    out = docs.join(f, "path", "left")
    what = F.when(F.col("modified").isNotNull(), "kept").when(F.col("__there").isNull(), "missing_file").when(F.col("__f").isNull(), "no_date").otherwise("filled")
    return out.withColumn("outcome", what).withColumn("modified", F.coalesce("modified", "__f")).drop("__f", "__there")


#: What the path of an article looks like to the crawler.
CRAWLED = (r"/\d{4}/\d{2}/\d{2}/", r"/\d{4}-\d{2}-\d{2}[/-]", r"[/-](news|article|story|post|blog)[/-]", r"[/-](markets|stocks|economy|business|finance|politics)[/-]", r"-\d{7,}[/-]?$")


def crawl_links(links: DataFrame, now: Column, hours: int, most: int = 100) -> DataFrame:
    """Of the links (page_id, base, url, text) of a front page those of its own host that carry a day of any century in their path, by how new it is
    within 24 times ``hours``, or look like an article's (0.4): (page_id, place, url, score), each once."""
    from gneiss.functions import text as X

    host = lambda c: F.regexp_extract(c, r"^https?://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    own = links.where(host(F.col("url")) == host(F.col("base"))).select("page_id", "url").distinct().withColumn("path", path)
    part = lambda i: F.regexp_extract("path", r"(\d{4})[/-](\d{2})[/-](\d{2})", i)
    day = F.when(part(1) != "", F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")))
    new = X.recency(day, now, hours * 24)
    scored = own.withColumn("score", F.when(new > 0, new).when(F.col("path").rlike("(?i)" + "|".join(CRAWLED)), 0.4)).where("score is not null")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "url")).cast("long")
    return scored.select("page_id", place.alias("place"), "url", F.round("score", 6).alias("score")).where(F.col("place") <= most)


def result_label(words: Column, failed: Column, rendering: Column, late: Column, cut: Column, least: int = 80) -> Column:
    """How far a page's result can be trusted, the most serious reason first."""
    return F.when(failed, "error").when(rendering, "partial, still rendering").when(late, "late").when(words < least, "insufficient content").when(cut, "cut to fit the budget").otherwise("complete")
