"""Queries of sitemaps, layers, traces and graphs that are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import frontier, graphs, traces
from gneiss.plans.registry import Registry
from gneiss.sources import graph_sink
from gneiss.sources.tables import documents, table
from gneiss.streaming.replay import new_folder

registry = Registry()


def _maps(s, d):
    """Pages listed in sets of 50, sets in indexes of 10, indexes in a root, to which every third index leads back; each seventh set is in no index."""
    p = table(s, d, "pages").select(F.floor(F.col("page_id") / 50).alias("set"), F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 40).cast("int")).cast("string"), F.lit("</lastmod></url>")).alias("x"))
    name = lambda kind, c: F.concat(F.lit(f"https://maps.example/{kind}"), c)
    xml = lambda kind, c: F.concat(F.lit(f"<?xml version='1.0'?><{kind}>"), F.array_join(F.sort_array(F.collect_list(c)), ""), F.lit(f"</{kind}>"))
    loc = lambda c: F.concat(F.lit("<sitemap><loc> "), c, F.lit(" </loc></sitemap>"))
    sets = p.groupBy("set").agg(xml("urlset", F.col("x")).alias("xml"))
    numbers = p.select("set").distinct()
    indexes = numbers.where("set % 7 <> 3").withColumn("index", F.floor(F.col("set") / 10)).groupBy("index").agg(xml("sitemapindex", loc(name("set", F.col("set")))).alias("xml"))
    back = F.when(F.col("index") % 3 == 0, loc(F.lit("https://maps.example/root"))).otherwise("")
    indexes = indexes.withColumn("xml", F.concat("xml", back))
    root = indexes.agg(xml("sitemapindex", loc(name("index", F.col("index")))).alias("xml")).select(F.lit("https://maps.example/root").alias("url"), "xml")
    return sets.select(name("set", F.col("set")).alias("url"), "xml").unionByName(indexes.select(name("index", F.col("index")).alias("url"), "xml")).unionByName(root)


@registry.query("""WITH RECURSIVE p AS (SELECT page_id // 50 AS n, url, DATE '2024-01-01' + CAST(page_id % 40 AS INT) AS day FROM pages), n AS (SELECT DISTINCT n FROM p), listed AS (SELECT n FROM n WHERE n % 7 <> 3),
edges AS (SELECT 'i' || (n // 10) AS a, 's' || n AS b FROM listed UNION SELECT 'root', 'i' || (n // 10) FROM listed UNION SELECT 'i' || (n // 10), 'root' FROM listed WHERE n // 10 % 3 = 0),
reached AS (SELECT 'root' AS m, 0 AS depth UNION SELECT b, depth + 1 FROM reached JOIN edges ON a = m WHERE depth < 6),
near AS (SELECT m, min(depth) AS depth FROM reached GROUP BY m),
e AS (SELECT url, min((depth, m, CAST(day AS TIMESTAMP))) AS x FROM p JOIN near ON m = 's' || n GROUP BY url),
f AS (SELECT url, x[3] AS published, x[1]::BIGINT AS depth, round(greatest(0, 1 - (epoch(TIMESTAMP '2024-02-05') - epoch(x[3])) / 3600 / 480), 4)::DOUBLE AS score FROM e)
SELECT * FROM f WHERE score > 0""")
def sitemap_entries(s, d):
    """The pages of the last twenty days that a root map leads to."""
    roots = s.createDataFrame([("https://maps.example/root",)], "url string")
    return frontier.sitemap_entries(_maps(s, d), roots, F.lit("2024-02-05").cast("timestamp"), 480).select("url", F.col("published").cast("timestamp").alias("published"), "depth", "score")


def _chart(s, d):
    """Charts of suppliers with twelve boxes; two of three have no cycle."""
    l = table(s, d, "lineitem").select(F.col("l_suppkey").alias("chart"), (F.col("l_partkey") % 12).alias("x"), (F.col("l_orderkey") % 12).alias("y")).where("x <> y and (x + y) % 3 = 0").distinct()  # noqa: E741
    straight = F.col("chart") % 3 != 0
    return l.select("chart", F.when(straight, F.least("x", "y")).otherwise(F.col("x")).alias("a"), F.when(straight, F.greatest("x", "y")).otherwise(F.col("y")).alias("b")).distinct()


@registry.query("""WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS chart, l_partkey % 12 AS x, l_orderkey % 12 AS y FROM lineitem), e AS (SELECT DISTINCT chart, CASE WHEN chart % 3 <> 0 THEN least(x, y) ELSE x END AS a, CASE WHEN chart % 3 <> 0 THEN greatest(x, y) ELSE y END AS b FROM l WHERE x <> y AND (x + y) % 3 = 0),
nodes AS (SELECT chart, a AS node FROM e UNION SELECT chart, b FROM e), tops AS (SELECT * FROM nodes WHERE (chart, node) NOT IN (SELECT (chart, b) FROM e)),
reach AS (SELECT chart, a, b FROM e UNION SELECT r.chart, r.a, e.b FROM reach r JOIN e ON e.chart = r.chart AND e.a = r.b), knotted AS (SELECT DISTINCT chart FROM reach WHERE a = b),
far AS (SELECT chart, node, 0 AS layer FROM tops WHERE chart NOT IN (SELECT chart FROM knotted) UNION SELECT f.chart, e.b, f.layer + 1 FROM far f JOIN e ON e.chart = f.chart AND e.a = f.node),
starts AS (SELECT * FROM tops WHERE chart IN (SELECT chart FROM knotted) UNION SELECT chart, min(node) FROM nodes WHERE chart IN (SELECT chart FROM knotted) AND chart NOT IN (SELECT chart FROM tops) GROUP BY chart),
near AS (SELECT chart, node, 0 AS layer FROM starts UNION SELECT f.chart, e.b, f.layer + 1 FROM near f JOIN e ON e.chart = f.chart AND e.a = f.node WHERE f.layer < 12),
first AS (SELECT chart, node, min(layer) AS layer FROM near GROUP BY 1, 2)
SELECT chart, node, max(layer)::BIGINT AS layer, false AS cyclic FROM far GROUP BY 1, 2 UNION ALL
SELECT n.chart, n.node, coalesce(f.layer, 1 + (SELECT max(layer) FROM first g WHERE g.chart = n.chart))::BIGINT, true FROM nodes n LEFT JOIN first f ON f.chart = n.chart AND f.node = n.node WHERE n.chart IN (SELECT chart FROM knotted)""")
def chart_layers(s, d):
    e = _chart(s, d)
    return frontier.layers(e.select("chart", F.col("a").alias("node")).limit(0), e)


def _spans(s, d):
    """Twelve events in a row are a trace, its first the root; users are conversations."""
    e = table(s, d, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.lit("t"), F.expr("event_id div 12")).alias("trace_id"), F.col("event_id").alias("span_id"), F.when(F.col("event_id") % 17 != 5, F.col("event_type")).alias("name"), ts.alias("start_time"),
        F.when(F.col("event_id") % 19 != 7, F.timestamp_micros(F.unix_micros(ts) + F.col("event_id") % 977 * 1300)).alias("end_time"), F.when(F.col("event_type") == "error", "Error").otherwise("OK").alias("status"),
        F.when(F.col("user_id") % 9 != 4, F.col("user_id")).alias("conversation"), (F.col("event_id") % 12 == 0).alias("root"),
    )


_TRACES = """WITH s AS (SELECT 't' || (event_id // 12) AS trace_id, event_id AS span_id, CASE WHEN event_id % 17 <> 5 THEN event_type ELSE 'unknown' END AS name, ts, CASE WHEN event_id % 19 <> 7 THEN round(event_id % 977 * 1.3, 1)::DOUBLE END AS ms, event_type = 'error' AS err, CASE WHEN user_id % 9 <> 4 THEN user_id END AS conversation, event_id % 12 = 0 AS root FROM events),
by_name AS (SELECT trace_id, name, count(*) AS n, round(coalesce(sum(ms), 0), 0) AS total FROM s WHERE NOT root GROUP BY 1, 2),
per AS (SELECT trace_id, sum(n)::BIGINT AS n, string_agg(name || ':' || n || ':' || total::BIGINT, '|' ORDER BY total DESC, name) AS lines FROM by_name GROUP BY 1),
turns AS (SELECT s.*, coalesce(n, 0) AS span_count, coalesce(lines, '') AS lines FROM s LEFT JOIN per USING (trace_id) WHERE root)"""


@registry.query(_TRACES + """ SELECT conversation, (row_number() OVER w - 1)::INT AS turn, count(*) OVER (PARTITION BY conversation) AS turn_count, max(ts) OVER (PARTITION BY conversation) AS last_seen, trace_id, ms AS latency_ms, err AS had_error, span_count, lines AS breakdown
FROM turns WHERE conversation IS NOT NULL WINDOW w AS (PARTITION BY conversation ORDER BY ts DESC, trace_id)""")
def conversation_traces(s, d):
    spans = _spans(s, d)
    by = traces.conversations(traces.turns(spans.where("root"), spans))
    line = F.array_join(F.transform("t.breakdown", lambda b: F.concat_ws(":", b["name"], b["count"].cast("string"), b["total_ms"].cast("long").cast("string"))), "|")
    rows = by.select("conversation", "turn_count", "last_seen", F.posexplode("turns").alias("turn", "t"))
    return rows.select("conversation", "turn", "turn_count", "last_seen", "t.trace_id", "t.latency_ms", "t.had_error", "t.span_count", line.alias("breakdown"))


@registry.query(_TRACES + " SELECT count(*) AS total, count(conversation) AS matched, count(*) - count(conversation) AS unmatched FROM turns")
def unmatched_roots(s, d):
    spans = _spans(s, d)
    return traces.unmatched(traces.turns(spans.where("root"), spans))


@registry.query()
def graph_written(s, d):
    """The edges of each language's documents, written to a namespace of their own, one of them twice, and read back."""
    folder, docs = new_folder(s, "graph"), documents(s, d)
    edges = {n: graphs.cooccurrence(graphs.mentions(docs.where(F.col("lang") == n))) for n in ("en", "de")}
    for n, e in edges.items():
        graph_sink.write_graph(e, folder, n)
    graph_sink.write_graph(edges["de"], folder, "de")  # takes the place of the first
    return graph_sink.read_graph(s, folder, edges["en"].schema, ["en", "de"])
