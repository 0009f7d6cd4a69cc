"""Queries of scopes, runs, reports and file rules, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import code
from gneiss.functions import text as X
from gneiss.operators import chunking, context, graphs, ontology, retrieval, scopes, web
from gneiss.sources import files, providers
from gneiss.sources.tables import documents, table

_all: dict = {}
_sql: dict[str, str] = {}


def query(sql: str):
    """Register a query and the SQL that gives its rows."""

    def put(f):
        _all[f.__name__], _sql[f.__name__] = f, sql
        return f

    return put


def queries() -> dict:
    return dict(_all)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---------------------------------------------------------------- scopes: customers read the nations that they are attached to


def _edges(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("scope"), (F.col("o_orderkey") % 25).alias("collection"))


def _catalogue(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 1, "collection").otherwise("draft").alias("kind"), F.col("n_name").alias("title"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS scope, o_orderkey % 25 AS collection FROM orders), s AS (SELECT DISTINCT scope FROM e)
SELECT scope, 0::BIGINT AS rank, (-1)::BIGINT AS id FROM s UNION ALL
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY n_name, collection) AS rank, collection::BIGINT AS id FROM e JOIN nation ON n_nationkey = collection WHERE n_regionkey <> 1""")
def attached_scopes(s, d):
    edges = _edges(s, d)
    return scopes.scopes_for(edges.select("scope").distinct(), scopes.attach(edges.limit(0), edges), _catalogue(s, d)).fillna(-1, ["id"])


@query("""SELECT scope, count(*) AS n FROM (SELECT DISTINCT o_custkey AS scope, o_orderkey % 25 AS collection FROM orders) WHERE collection <> scope % 25 GROUP BY scope""")
def detached_scopes(s, d):
    edges = scopes.attach(_edges(s, d), _edges(s, d))
    return scopes.detach(edges, edges.where("collection = scope % 25")).groupBy("scope").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS id, r_name AS namespace FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON lower(substr(r_name, 1, 1)) = lower(substr(n_name, 1, 1))""")
def scope_namespaces(s, d):
    titles = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit(" "), F.substring("n_name", 1, 1), F.lit("  ")).alias("title"))
    mapping = table(s, d, "region").where("r_regionkey < 3").select(F.lower(F.substring("r_name", 1, 1)).alias("title"), F.col("r_name").alias("namespace"))
    return scopes.namespaces(titles, mapping).select("id", "namespace")


@query("SELECT c_custkey, c_mktsegment AS namespace FROM customer WHERE c_mktsegment = 'BUILDING'")
def namespace_guard(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("namespace"))
    return scopes.in_namespace(rows, "BUILDING", ("BUILDING", "MACHINERY"))


@query("SELECT c_mktsegment AS namespace, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def namespace_clear(s, d):
    return scopes.clear_namespace(table(s, d, "customer").select(F.col("c_mktsegment").alias("namespace")), "BUILDING").groupBy("namespace").agg(F.count("*").alias("n"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'ready' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'building' END AS status FROM orders) GROUP BY 1""")
def graph_states(s, d):
    o = table(s, d, "orders")
    before = F.when(F.col("o_orderpriority") == "1-URGENT", "ready")
    outcome = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed")
    return o.select(scopes.graph_status(before, outcome).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey % 100 = 7")
def documents_by_job(s, d):
    return table(s, d, "orders").where("o_custkey % 100 = 7").select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def public_columns(s, d):
    """The catalogue without what only its owner may see."""
    return table(s, d, "supplier").drop("s_acctbal").select("s_suppkey", "s_name", "s_nationkey")


# ---------------------------------------------------------------- runs


@query("""SELECT user_id AS job, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'signup') AS quarantined, count(*) AS done, (count(*) // 50)::BIGINT AS logged FROM events GROUP BY 1""")
def ingest_counters(s, d):
    status = F.create_map(*map(F.lit, ["view", "ok", "click", "degraded", "error", "failed", "signup", "quarantined"]))
    return scopes.ingest_counters(table(s, d, "events").select(F.col("user_id").alias("job"), F.try_element_at(status, F.col("event_type")).alias("status")))


@query("SELECT user_id AS upload, bool_and(event_type <> 'error') AS settled FROM events GROUP BY 1")
def settled_uploads(s, d):
    return scopes.all_settled(table(s, d, "events").select(F.col("user_id").alias("upload"), F.when(F.col("event_type") == "error", "expanding").otherwise("indexed").alias("status")))


@query("SELECT doc_id, least(length(coalesce(text, '')), 2000)::BIGINT AS kept FROM documents")
def event_messages(s, d):
    return scopes.event_rows(documents(s, d).select("doc_id", F.col("text").alias("message"))).select("doc_id", F.length("message").cast("long").alias("kept"))


_PAD = [bytes(b ^ x for b in b"salt".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f"SELECT c_custkey, sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || encode(c_name)))) AS token FROM customer")
def pseudonyms(s, d):
    return table(s, d, "customer").select("c_custkey", scopes.pseudonym(F.col("c_name"), b"salt").alias("token"))


# ---------------------------------------------------------------- chunks and reports; copies of a text retire to its first document


_RETIRED = "gone AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) > 1)"


def _roles(s, d):
    docs = documents(s, d).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "h").select("doc_id", F.when(F.col("doc_id") == F.col("first"), "CANONICAL").otherwise("SUPERSEDED").alias("role"))


@query(f"WITH {_RETIRED} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)")
def active_documents(s, d):
    return scopes.without_superseded(documents(s, d).select("doc_id"), _roles(s, d))


def _part_mentions(s, d):
    """Lines of orders as mentions: parts are things, suppliers of little account."""
    li = table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), F.concat(F.lit("p"), F.col("l_partkey") % 9).alias("canonical"), F.when(F.col("l_partkey") % 9 > 6, "Vendor").when(F.col("l_partkey") % 9 == 3, "ambiguous").otherwise("Part").alias("class"))


_M = "m AS (SELECT l_orderkey AS doc_id, l_linenumber AS start, 'p' || (l_partkey % 9) AS canonical, CASE WHEN l_partkey % 9 > 6 THEN 'Vendor' WHEN l_partkey % 9 = 3 THEN 'ambiguous' ELSE 'Part' END AS class FROM lineitem)"


@query(f"""WITH {_M}, e AS (SELECT doc_id, canonical, min(start) AS place, bool_or(class = 'Part') AS strong FROM m WHERE class <> 'ambiguous' AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 GROUP BY 1, 2)
SELECT doc_id, count(*) FILTER (WHERE strong) AS strong, array_to_string(list_slice(list(canonical ORDER BY (NOT strong), place, canonical), 1, 12), '|') AS listed FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE strong) >= 2""")
def select_chunks(s, d):
    ids = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return scopes.select_chunks(_part_mentions(s, d), ids.where("doc_id % 5 = 0"), ids.where("doc_id % 7 = 0").withColumn("role", F.lit("ABSORBED")))


@query(f"""WITH {_M}, per AS (SELECT o_orderkey, least(count(m.doc_id), 6) AS n FROM orders LEFT JOIN m ON m.doc_id = o_orderkey GROUP BY 1)
SELECT 'mentions' AS part, '' AS key, count(*) AS n FROM m UNION ALL SELECT 'class', class, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'documents', canonical, count(DISTINCT doc_id) FROM m GROUP BY 2
UNION ALL SELECT 'histogram', n::VARCHAR, count(*) FROM per GROUP BY 2 UNION ALL SELECT 'ambiguous', '', count(*) FROM m WHERE class = 'ambiguous'""")
def gazetteer_report(s, d):
    return scopes.gazetteer_report(table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")), _part_mentions(s, d))


@query(f"""WITH t AS (SELECT unnest(['license', 'the', 'email', 'unheard']) AS term), w AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{X.ACCENTS}', '{X.PLAIN}'), '[a-z0-9]+')) AS term FROM documents)
SELECT t.term, count(DISTINCT doc_id) AS documents, count(w.term) AS mentions FROM t LEFT JOIN w USING (term) GROUP BY 1""")
def term_hits(s, d):
    return scopes.term_hits(documents(s, d), s.createDataFrame([("license",), ("the",), ("email",), ("unheard",)], "term string"))


@query("SELECT l_suppkey AS key, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS aliases, count(DISTINCT l_orderkey) AS documents, sum(l_linenumber)::BIGINT AS mentions FROM lineitem GROUP BY 1")
def merged_entities(s, d):
    return scopes.merged_entities(table(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.concat("l_returnflag", "l_linestatus").alias("alias"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("n")))


@query("WITH c AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) SELECT size, count(*) AS clusters, ((size - 1) * count(*))::BIGINT AS retired FROM c GROUP BY 1")
def cluster_summary(s, d):
    return scopes.cluster_summary(table(s, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("doc_id")))


@query("SELECT count(*) AS written FROM lineitem WHERE l_partkey % 10 < 8 AND l_suppkey % 10 < 8")
def writable_claims(s, d):
    claims = table(s, d, "lineitem").select(F.lit("n").alias("namespace"), F.concat(F.lit("p"), "l_partkey").alias("subject"), F.concat(F.lit("s"), "l_suppkey").alias("object"))
    ids = claims.select("namespace", F.explode(F.array("subject", "object")).alias("id")).distinct().where("substring(id, 2) % 10 < 8")
    return scopes.writable_claims(claims, ids).agg(F.count("*").alias("written"))


@query("""WITH f AS (SELECT o_custkey AS site, o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 4 = 1 THEN 2 WHEN o_orderkey % 4 = 2 THEN 3 END AS r, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS published, o_totalprice AS score FROM orders),
g AS (SELECT *, min(r) OVER (PARTITION BY site) AS b FROM f WHERE r IS NOT NULL)
SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY (published IS NOT NULL) DESC, score DESC NULLS LAST, url) AS place FROM g WHERE r = b""")
def first_source(s, d):
    via = F.get(F.array(*map(F.lit, ["sitemap", "feed", "homepage", "guess"])), (F.col("o_orderkey") % 4).cast("int"))
    found = table(s, d, "orders").select(F.col("o_custkey").alias("site"), via.alias("via"), F.col("o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("published"), F.col("o_totalprice").alias("score"))
    return scopes.first_source(found).select("site", "url", "place")


# ---------------------------------------------------------------- rules over rows made from the tables; tests/test_rules.py has single cases


_LISTED = """f AS (SELECT page_id, '/lib/' || CASE WHEN page_id % 4 = 0 THEN 'node_modules/' ELSE 'docs/' END || page_id || '.' || ['md', 'xlsx', 'bin', 'txt', 'pdf', 'tmp'][1 + page_id % 6] AS path, ['md', 'xlsx', 'bin', 'txt', 'pdf', 'tmp'][1 + page_id % 6] AS suffix,
  CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 11534336 ELSE length(html) END AS size FROM pages),
s AS (SELECT path, suffix, size, CASE suffix WHEN 'md' THEN 'text' WHEN 'txt' THEN 'text' WHEN 'xlsx' THEN 'table' WHEN 'pdf' THEN 'office' END AS track, CASE WHEN suffix = 'bin' THEN 'unsupported_media_type' WHEN suffix = 'xlsx' THEN 'deferred_tabular' WHEN size = 0 THEN 'empty_file' WHEN size > 10485760 THEN 'too_large' END AS reason FROM f WHERE page_id % 4 <> 0 AND suffix <> 'tmp')"""


def _listed(s, d):
    """Pages as files of several kinds, some in a vendored folder, some empty or too large."""
    suffix = F.get(F.array(*map(F.lit, ["md", "xlsx", "bin", "txt", "pdf", "tmp"])), (F.col("page_id") % 6).cast("int"))
    p = table(s, d, "pages").withColumn("suffix", suffix)
    path = F.concat(F.lit("/lib/"), F.when(F.col("page_id") % 4 == 0, "node_modules/").otherwise("docs/"), F.col("page_id").cast("string"), F.lit("."), "suffix")
    return p.select(path.alias("path"), F.when(F.col("page_id") % 5 == 0, 0).when(F.col("page_id") % 5 == 1, 11 << 20).otherwise(F.length("html")).cast("long").alias("size"), "suffix")


@query(f"WITH {_LISTED} SELECT path, track, reason FROM s")
def select_files(s, d):
    return files.select_files(_listed(s, d), ["node_modules", "*.tmp"]).select("path", "track", "reason")


@query(f"WITH {_LISTED} SELECT suffix, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE reason IS NULL) AS ingestible FROM s GROUP BY 1")
def preview_files(s, d):
    return files.preview(files.select_files(_listed(s, d), ["node_modules", "*.tmp"]))


@query("""SELECT CASE event_type WHEN 'error' THEN 'too_large:' || (event_id % 3) WHEN 'view' THEN 'empty_file' WHEN 'signup' THEN '' ELSE 'odd_' || event_type || '_code' END AS code, CASE event_type WHEN 'error' THEN 'The file is too large.' WHEN 'view' THEN 'The file is empty.' WHEN 'signup' THEN '' ELSE 'Odd ' || event_type || ' code.' END AS said, count(*) AS n FROM events GROUP BY 1, 2""")
def reason_texts(s, d):
    kind = F.col("event_type")
    code = F.when(kind == "error", F.concat(F.lit("too_large:"), (F.col("event_id") % 3).cast("string"))).when(kind == "view", "empty_file").when(kind == "signup", "").otherwise(F.concat(F.lit("odd_"), kind, F.lit("_code")))
    return table(s, d, "events").select(code.alias("code")).select("code", scopes.reason_text(F.col("code")).alias("said")).groupBy("code", "said").agg(F.count("*").alias("n"))


@query("SELECT p_type AS given, '.' || lower(replace(p_type, ' ', '|.')) AS clean, count(*) AS n FROM part GROUP BY 1, 2")
def suffix_forms(s, d):
    """The words of part types as suffixes that a user lists: with and without a dot, in capitals, with blanks and an empty one."""
    given = F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit(", .")), F.lit(", "))
    p = table(s, d, "part").select(F.col("p_type").alias("given"), F.array_join(scopes.suffixes(F.split(F.upper(given), ",")), "|").alias("clean"))
    return p.groupBy("given", "clean").agg(F.count("*").alias("n"))


@query("""SELECT page_id // 50 AS feed, url, CASE WHEN page_id // 50 % 2 = 0 THEN 'Page ' || page_id END AS title, CASE WHEN page_id % 4 <> 1 THEN strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INT), '%Y-%m-%d') END AS day FROM pages""")
def feed_entries(s, d):
    """Pages as entries of feeds with mail dates and of sitemaps, a quarter of them undated."""
    day, dated, feed = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), F.col("page_id") % 4 != 1, F.floor(F.col("page_id") / 50)
    item = F.concat(F.lit("<item><title>"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<![CDATA[Page "), "page_id", F.lit("]]>"))).otherwise(F.concat(F.lit("Page "), "page_id")), F.lit("</title><link>"), "url", F.lit("</link>"), F.when(dated, F.concat(F.lit("<pubDate>"), F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT</pubDate>"))).otherwise(""), F.lit("</item>"))
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc>"), F.when(dated, F.concat(F.lit("<lastmod>"), F.date_format(day, "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    feeds = table(s, d, "pages").select(feed.alias("feed"), F.when(feed % 2 == 0, item).otherwise(entry).alias("x")).groupBy("feed").agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list("x"), "\n"), F.lit("</rss>")).alias("xml"))
    return web.feed_entries(feeds).select("feed", "url", "title", F.date_format("published", "yyyy-MM-dd").alias("day"))


@query("""SELECT 'part ' || l_partkey AS subject_label, CASE WHEN l_linestatus = 'O' THEN 'USES' ELSE 'NEEDS' END AS predicate, 'supplier ' || l_suppkey AS object_label, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2 AND l_partkey % 3 <> 0 AND l_suppkey % 4 <> 1 GROUP BY ALL""")
def claim_neighbours(s, d):
    """Lines as claims of a part about its supplier in three namespaces; a third of the parts and a quarter of the suppliers are unknown."""
    li = table(s, d, "lineitem")
    claims = li.select(F.col("l_returnflag").alias("namespace"), F.concat(F.lit("p"), "l_partkey").alias("subject"), F.when(F.col("l_linestatus") == "O", "USES").otherwise("NEEDS").alias("predicate"), F.concat(F.lit("s"), "l_suppkey").alias("object"), F.when(F.col("l_linenumber") == 2, "quarantined").otherwise("valid").alias("status"))
    names = table(s, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("part "), "p_partkey").alias("label")).unionByName(table(s, d, "supplier").where("s_suppkey % 4 <> 1").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("supplier "), "s_suppkey").alias("label")))
    ends = names.withColumn("namespace", F.explode(F.array(*map(F.lit, "RAN"))))
    return ontology.neighbours(claims, ends, "R").groupBy("subject_label", "predicate", "object_label").agg(F.count("*").alias("n"))


_JUDGED = r"""v AS (SELECT doc_id, doc_id % 6 AS k, regexp_replace(regexp_replace(substr(text, 1, 40), '^\s*"*\s*', ''), '\s*"*\s*$', '') AS q FROM documents),
j AS (SELECT doc_id AS chunk_id, CASE k WHEN 1 THEN 'self_relation' WHEN 2 THEN 'unparseable_json' WHEN 3 THEN 'empty_response' WHEN 5 THEN 'index_out_of_range' ELSE CASE WHEN coalesce(length(q), 0) < 8 THEN 'evidence_not_found' ELSE '' END END AS rejected, k, q FROM v),
judged AS (SELECT chunk_id, rejected, CASE WHEN rejected = '' THEN CASE k WHEN 0 THEN 'USES' ELSE 'OTHER' END END AS predicate, CASE WHEN rejected = '' THEN CASE k WHEN 0 THEN '' ELSE 'FEEDS' END END AS proposed, CASE WHEN rejected = '' THEN CASE k WHEN 0 THEN 'valid' ELSE 'proposed' END ELSE 'rejected' END AS status FROM j)"""


def _validated(s, d):
    """Answers about documents that a model might give, good and bad, with the text's first characters as evidence."""
    k = F.col("doc_id") % 6
    said = lambda a, b, p: F.to_json(F.struct(F.array(F.struct(F.lit(a).alias("subject"), F.lit(b).alias("object"), F.lit(p).alias("predicate"), F.substring("text", 1, 40).alias("evidence"), F.lit(0.9).alias("confidence"))).alias("relations")))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), said(0, 1, "USES"), F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), said(0, 0, "USES"))).when(k == 2, "no json").when(k == 3, " ").when(k == 4, said(0, 1, "FEEDS")).otherwise(said(0, 7, "USES"))
    ends = F.array(F.struct(F.lit("Gateway").alias("name"), F.lit("Service").alias("class")), F.struct(F.lit("Queue").alias("name"), F.lit("Tool").alias("class")))
    return ontology.validate_relations(documents(s, d).select(F.col("doc_id").alias("chunk_id"), "text", raw.alias("raw"), ends.alias("entities")), ontology.constraints(s))


@query(f"WITH {_JUDGED} SELECT * FROM judged")
def validate_relations(s, d):
    return _validated(s, d).select("chunk_id", "rejected", "predicate", "proposed", "status")


@query(f"WITH {_JUDGED} SELECT 'rejected' AS kind, rejected AS key, count(*) AS n FROM judged WHERE rejected <> '' GROUP BY 2 UNION ALL SELECT 'predicate', predicate, count(*) FROM judged WHERE predicate IS NOT NULL GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM judged GROUP BY 2 UNION ALL SELECT 'proposed', proposed, count(*) FROM judged WHERE proposed <> '' GROUP BY 2")
def validation_counts(s, d):
    return scopes.validation_counts(_validated(s, d))


@query("SELECT l_orderkey AS chart, 'p' || l_partkey AS a, 's' || l_suppkey AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS label FROM lineitem")
def flowchart_edges(s, d):
    """Orders as flowcharts from parts to suppliers."""
    line = F.concat(F.lit(" p"), "l_partkey", F.lit("[Part] "), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("-->|"), "l_returnflag", F.lit("|"))).otherwise("==>"), F.lit(" s"), "l_suppkey", F.lit("{Who?}"))
    charts = table(s, d, "lineitem").select(F.col("l_orderkey").alias("chart"), F.struct("l_linenumber", line.alias("x")).alias("l")).groupBy("chart").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    text = F.concat(F.lit("graph TD\n"), F.array_join(F.transform("ls", lambda x: x["x"]), "\n"))
    return scopes.flowchart_edges(charts.select("chart", text.alias("text"))).select("chart", "a", "b", "label")


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'prose' ELSE 'code' END AS kind, count(*) AS documents FROM documents WHERE length(trim(text, ' ' || chr(10) || chr(9))) >= 200 GROUP BY 1")
def routed_chunks(s, d):
    """Documents of some length by the chunker that they are sent to."""
    kind = F.when(F.col("doc_id") % 3 == 0, "markdown").when(F.col("doc_id") % 3 == 1, "native_code_v1").otherwise("html_source")
    docs = documents(s, d).where(F.length(F.trim("text", F.lit(" \n\t"))) >= 200).select("doc_id", "text", kind.alias("extractor"))
    out = scopes.routed(docs, lambda x: chunking.chunk(x), lambda x: chunking.chunk(x, "code"))
    return out.select("doc_id", F.split_part("chunker", F.lit("-"), F.lit(1)).alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("documents"))


@query("""SELECT doc_id, 'doc' || doc_id || ' (edit ' || (doc_id % 5 + 1) || ')' || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '' END AS following FROM documents""")
def next_revisions(s, d):
    mark = F.get(F.array(*map(F.lit, ["", " (edited)", " (edit 2)"])), (F.col("doc_id") % 3).cast("int"))
    name = F.concat(F.lit("doc"), "doc_id", mark, F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(""))
    return documents(s, d).select("doc_id", context.next_revision(name, F.col("doc_id") % 5).alias("following"))


def name_pairs(s, d):
    """Names in documents of which one may be another's short form."""
    names = graphs.mentions(documents(s, d)).select(F.lit("p").alias("label"), "name").distinct()
    return graphs.name_pairs(names).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))


_all["name_pairs"] = name_pairs


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id || '|g|C' || doc_id ELSE 't.x' || doc_id || '|v' END AS names FROM documents")
def declared_symbols(s, d):
    docs = documents(s, d).select("doc_id", F.col("doc_id").cast("string").alias("i"))
    python = F.concat(F.lit("class C"), "i", F.lit(":\n    def f"), "i", F.lit("(self):\n        pass\n\ndef g():\n    pass\n"))
    sql = F.concat(F.lit("create table if not exists t.x"), "i", F.lit(" (a int); CREATE VIEW v AS SELECT 1"))
    one = lambda rest, lang, text: docs.where(F.col("doc_id") % 2 == rest).withColumn("text", text).select("doc_id", F.array_join(code.symbols(F.col("text"), lang), "|").alias("names"))
    return one(0, "python", python).unionByName(one(1, "sql", sql))


@query("""WITH f AS (SELECT doc_id, n_chars % 160 AS words, doc_id % 11 = 3 AS failed, doc_id % 7 = 2 AS rendering, doc_id % 13 = 5 AS late, doc_id % 5 = 1 AS cut FROM documents)
SELECT CASE WHEN failed THEN 'error' WHEN rendering THEN 'partial, still rendering' WHEN late THEN 'late' WHEN words < 80 THEN 'insufficient content' WHEN cut THEN 'cut to fit the budget' ELSE 'complete' END AS label, count(*) AS n FROM f GROUP BY 1""")
def result_labels(s, d):
    mod = lambda n, k: F.col("doc_id") % n == k
    return documents(s, d).select(scopes.result_label(F.col("n_chars") % 160, mod(11, 3), mod(7, 2), mod(13, 5), mod(5, 1)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings WHERE label % 3 <> 0 GROUP BY label), flipped AS (SELECT label, CASE WHEN label % 3 = 2 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM i),
c AS (SELECT e.label, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings e JOIN flipped USING (label)), k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS r FROM c WHERE score >= 0.99),
b AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE label % 3 = 0)
SELECT label, vec_id AS doc_id, true AS had_any_match FROM k WHERE r <= 2 UNION ALL SELECT label, vec_id, true FROM b WHERE r <= 2 UNION ALL SELECT label, -1, false FROM flipped WHERE label NOT IN (SELECT label FROM k)""")
def relevance_flags(s, d):
    """Vectors by label: a third of the labels has no intent, a third one that points away from all of its vectors."""
    v = table(s, d, "embeddings").select("label", F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = v.where("label % 3 <> 0").groupBy("label").agg(F.min_by("embedding", "doc_id").alias("v"))
    intents = first.select("label", F.when(F.col("label") % 3 == 2, F.transform("v", lambda x: -x)).otherwise(F.col("v")).alias("intent"))
    return retrieval.relevant(v, intents, 0.99, 2).select("label", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "had_any_match")


@query(r"""WITH l AS (SELECT DISTINCT page_id, url AS base, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h || CASE (length(h) + page_id) % 6 WHEN 0 THEN '/2024-01-1' || (page_id % 9) || '/x' WHEN 1 THEN '/news/a' WHEN 2 THEN '-1234567' WHEN 3 THEN '/2001/01/01/' WHEN 4 THEN '/economy.html' ELSE '' END ELSE h END AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages)),
o AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM l WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) = regexp_extract(base, '^https?://([^/?#]+)', 1)),
n AS (SELECT *, try_cast(nullif(regexp_replace(regexp_extract(path, '\d{4}[/-]\d{2}[/-]\d{2}'), '/', '-', 'g'), '') AS DATE) AS day, regexp_matches(path, '(?i)/\d{4}/\d{2}/\d{2}/|/\d{4}-\d{2}-\d{2}[/-]|[/-](news|article|story|post|blog)[/-]|[/-](markets|stocks|economy|business|finance|politics)[/-]|-\d{7,}[/-]?$') AS article FROM o),
s AS (SELECT page_id, url, CASE WHEN 1 - (epoch(TIMESTAMP '2024-01-20') - epoch(day)) / 3600 / 2400 > 0 THEN least(1, 1 - (epoch(TIMESTAMP '2024-01-20') - epoch(day)) / 3600 / 2400) WHEN article THEN 0.4 END AS score FROM n)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS place, url, round(score, 6)::DOUBLE AS score FROM s WHERE score IS NOT NULL""")
def crawl_links(s, d):
    """The links of pages, their paths made longer as articles' are, that lead to articles of their own host."""
    p = table(s, d, "pages")
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    links = p.select("page_id", F.col("url").alias("base"), href.alias("h"))
    more = F.get(F.array(F.concat(F.lit("/2024-01-1"), (F.col("page_id") % 9).cast("string"), F.lit("/x")), *map(F.lit, ["/news/a", "-1234567", "/2001/01/01/", "/economy.html", ""])), ((F.length("h") + F.col("page_id")) % 6).cast("int"))
    links = links.withColumn("url", F.when(F.col("h").startswith("/"), F.concat(F.regexp_extract("base", r"^(https?://[^/?#]+)", 1), "h", more)).otherwise(F.col("h")))
    return scopes.crawl_links(links.select("page_id", "base", "url", F.lit("").alias("text")), F.lit("2024-01-20").cast("timestamp"), 100)


@query("""WITH r AS (SELECT user_id AS run, event_type AS key, event_id AS seq, value AS seconds FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq) = 1 AS first FROM r),
n AS (SELECT *, sum(first::INT) OVER (PARTITION BY run ORDER BY seq) AS n FROM f) SELECT CASE WHEN NOT first THEN 'duplicate' WHEN n > 3 THEN 'refused' WHEN seconds > 50 THEN 'dropped' ELSE 'done' END AS outcome, count(*) AS n FROM n GROUP BY 1""")
def deferred_work(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("seconds"), F.lit(50.0).alias("waited"))
    return scopes.deferred(e, 3).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT outcome, count(*) AS n, count(modified) AS dated FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN c_custkey IS NULL THEN 'missing_file' WHEN c_acctbal < 0 THEN 'no_date' ELSE 'filled' END AS outcome, CASE WHEN o_orderkey % 3 = 0 OR c_acctbal >= 0 THEN 1 END AS modified
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey) GROUP BY 1""")
def backfilled_dates(s, d):
    docs = table(s, d, "orders").select(F.col("o_custkey").alias("path"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(1.0)).alias("modified"))
    found = table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("path"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("double")).alias("modified"))
    return scopes.backfilled(docs, found).groupBy("outcome").agg(F.count("*").alias("n"), F.count("modified").alias("dated"))


@query("SELECT doc_id, 8 AS size, 'hashed' AS model FROM documents")
def provider_vectors(s, d):
    return providers.apply(documents(s, d).select("doc_id", "text"), "hashed", "text", "embedding", "array<double>").select("doc_id", F.size("embedding").alias("size"), "model")
