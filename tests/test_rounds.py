"""Maps of maps, layers, traces, aliases, rules and the graph sink against plain Python."""

import random
from functools import reduce
from operator import add

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.operators import aliases, frontier, rules, traces
from gneiss.plans import catalog
from gneiss.sources import graph_sink


def test_maps_end(spark):
    maps = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "r"), ("c", "c"), ("b", "gone"), ("x", "y"), (None, "q")], "url string, child string")
    got = {r.url: r.depth for r in frontier.follow_maps(maps, spark.createDataFrame([("r",), (None,)], "url string")).collect()}
    assert got == {"r": 0, "a": 1, "b": 1, "c": 2, "gone": 2}


def test_sitemap_entries(spark):
    index = "<sitemapindex><sitemap><loc> m1 </loc><lastmod>2024-01-01</lastmod></sitemap><sitemap>\n<loc>m2</loc></sitemap></sitemapindex>"
    one = "<urlset><url><loc>u1</loc><lastmod>2024-01-09</lastmod></url><url><loc>old</loc><lastmod>2023-01-01</lastmod></url><url><loc>undated</loc></url></urlset>"
    two = "<urlset><url><loc>u1</loc></url><url><news:title>t</news:title><loc>u2</loc></url></urlset>"
    pages = spark.createDataFrame([("root", index), ("m1", one), ("m2", index + two), ("m3", one), ("bad", None)], "url string, xml string")
    got = {r.url: (r.depth, r.score) for r in frontier.sitemap_entries(pages, spark.createDataFrame([("root",)], "url string"), F.lit("2024-01-10").cast("timestamp"), 48).collect()}
    assert got == {"u1": (1, 0.5), "undated": (1, 0.5), "u2": (1, 0.5)}


def plain_layers(nodes, edges):
    nodes = sorted({*nodes, *(x for e in edges for x in e)})
    left, live, out, k = set(nodes), set(edges), {}, 0
    while free := left - {b for _, b in live}:
        out |= {n: (k, False) for n in free}
        left, live, k = left - free, {e for e in live if e[0] not in free}, k + 1
    if not left:
        return out
    frontier_, seen, depth = sorted(set(nodes) - {b for _, b in edges}) or nodes[:1], {}, 0
    while frontier_:
        seen |= {n: depth for n in frontier_}
        frontier_ = sorted({b for a, b in edges if a in frontier_} - set(seen))
        depth += 1
    return {n: (seen.get(n, depth), True) for n in nodes}


def test_layers(spark):
    r = random.Random(5)
    nodes, edges = [], []
    for chart in range(12):
        edges += [(chart, *(sorted(r.sample("abcdefgh", 2)) if chart % 2 else r.sample("abcdefgh", 2))) for _ in range(r.randint(1, 14))]
        nodes.append((chart, "alone"))
    edges += [(20, "a", "b"), (20, "b", "a"), (21, "x", "x"), (22, None, "y"), (None, "a", "b")]
    got = {}
    for x in frontier.layers(spark.createDataFrame(nodes, "chart int, node string"), spark.createDataFrame(edges, "chart int, a string, b string")).collect():
        got.setdefault(x.chart, {})[x.node] = (x.layer, x.cyclic)
    want = {c: plain_layers([n for k, n in nodes if k == c], [(a, b) for k, a, b in edges if k == c]) for c in [*range(12), 20, 21]}
    assert got == want


def test_traces(spark):
    t = [(pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=x)).to_pydatetime() for x in range(0, 4000, 250)]
    kind = "trace_id string, span_id long, name string, start_time timestamp, end_time timestamp, conversation string, status string"
    rows = [
        ("a", 1, "root", t[0], t[8], "c1", "OK"), ("a", 2, "search", t[1], t[2], None, "OK"), ("a", 3, "search", t[2], t[4], None, "OK"), ("a", 4, "critic", t[4], None, None, "ERROR"), ("a", 5, None, t[4], t[5], None, "OK"),
        ("b", 6, "root", t[9], t[10], "c1", "status_error"), ("c", 7, "root", t[3], None, None, None), (None, 8, "lost", t[0], t[1], None, "OK"), ("d", 9, "no root", t[0], t[1], None, "OK"),
    ]
    spans = spark.createDataFrame(rows, kind)
    turns = traces.turns(spans.where("name = 'root'"), spans)
    got = traces.conversations(turns).collect()
    assert [(r.conversation, r.turn_count, str(r.last_seen)) for r in got] == [("c1", 2, str(t[9]))]
    b, a = got[0].turns
    assert (b.trace_id, b.latency_ms, b.had_error, b.span_count, b.breakdown) == ("b", 250.0, True, 0, [])
    assert (a.trace_id, a.latency_ms, a.had_error, a.span_count) == ("a", 2000.0, False, 4)
    assert [tuple(x) for x in a.breakdown] == [("search", 2, 750.0), ("unknown", 1, 250.0), ("critic", 1, 0.0)]
    assert tuple(traces.unmatched(turns).first()) == (3, 2, 1)



def test_times_are_added_in_the_order_of_ids(spark):
    """Sums of floating-point numbers differ by their order, and so do the halves that are rounded."""
    start = F.lit("2024-01-01").cast("timestamp")
    spans = spark.range(12 * 2000).select(F.floor(F.col("id") / 12).alias("trace_id"), F.col("id").alias("span_id"), F.lit("a").alias("name"), start.alias("start_time"), F.timestamp_micros(F.unix_micros(start) + F.col("id") * 389 % 977 * 1300).alias("end_time"), F.lit("OK").alias("status"), F.lit(1).alias("conversation"))
    want = {t: reduce(add, [round(i * 389 % 977 * 1.3, 1) for i in range(12 * t + 1, 12 * t + 12)]) for t in range(2000)}
    for rows in (spans, spans.orderBy(F.desc("span_id")), spans.repartition(7)):
        got = {r.trace_id: r.breakdown[0] for r in traces.turns(spans.where("span_id % 12 = 0"), rows).collect()}
        assert all(got[t]["count"] == 11 and got[t]["total_ms"] == int(s + 0.5) for t, s in want.items())


def test_traces_of_long_ids(spark, tmp_path):
    """Ids that a floating-point number can't hold stay in their traces."""
    spark.range(4800).selectExpr(
        "id + id div 240 * 1000000000000000 - 1000000000000000 AS event_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id % 40 AS user_id", "element_at(array('view', 'error', 'click'), int(id % 3) + 1) AS event_type",
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("conversation_traces", "unmatched_roots"):
        got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
        assert sorted(map(repr, got[list(want.columns)].astype(str).values.tolist())) == sorted(map(repr, want.astype(str).values.tolist()))


def test_the_last_writer_has_an_alias(spark):
    entities = spark.createDataFrame([("Blue Lantern", ["BL", "lantern"], 1), ("Lantern", [" ", None], 2), ("Old", ["bl"], 0), ("Plain", None, 5)], "canonical string, aliases array<string>, seq int")
    index = aliases.alias_index(entities)
    assert {r.alias: r.canonical for r in index.collect()} == {"blue lantern": "Blue Lantern", "bl": "Blue Lantern", "lantern": "Lantern", "old": "Old", "plain": "Plain"}
    ms = spark.createDataFrame([(1, "BL"), (1, "Plain"), (1, "nobody"), (2, "blue  LANTERN"), (2, "plain"), (2, "Plain"), (3, None)], "doc_id long, name string")
    edges = aliases.canonical_edges(ms, index)
    assert [tuple(r) for r in edges.collect()] == [("Blue Lantern", "Plain", 5, 2, [1, 2])]
    assert sorted(map(tuple, aliases.canonical_mentions(ms, index, keep=True).collect()), key=str)[-1] == (3, None) and aliases.canonical_mentions(ms, index, keep=True).count() == 7
    asked = spark.createDataFrame([("bl",), ("LANTERN",), ("zzz",)], "asked string")
    assert sorted(map(tuple, aliases.find_by_label(entities, asked).collect())) == [("LANTERN", "Blue Lantern"), ("LANTERN", "Lantern"), ("bl", "Blue Lantern"), ("bl", "Old")]
    assert [tuple(r) for r in aliases.neighbourhood(edges, index, spark.createDataFrame([("bL",), ("plain",)], "seed string")).orderBy("seed").collect()] == [("bL", "Plain", 5, 1), ("plain", "Blue Lantern", 5, 1)]


def test_rules_of_a_table(spark):
    docs = spark.createDataFrame([(1, "a Secret plan", "x"), (2, "write to a.b@c.org", "x"), (3, None, "secret.txt"), (4, "public words", "x"), (5, "y" * 30000 + " secret", "x")], "id int, text string, file string").withColumn("level", F.lit("old"))
    levels = spark.createDataFrame([("public", 0), ("internal", 1), ("confidential", 2), ("top", 9)], "level string, rank int")
    given = spark.createDataFrame([("top", r"\bsecret\b"), ("public", "public"), ("confidential", None)], "level string, pattern string")
    say = lambda **k: {r.id: r.level for r in rules.classify(docs, given, levels, name="file", **k).collect()}
    assert say() == {1: "top", 2: "confidential", 3: "top", 4: "internal", 5: "internal"}
    assert say(base="public", lifted=None) == {1: "top", 2: "public", 3: "top", 4: "public", 5: "public"}
    with pytest.raises(ValueError, match="without a rank"):
        rules.classify(docs, given.withColumn("level", F.lit("unheard")), levels)


def test_graph_sink(spark, tmp_path):
    path, kind = str(tmp_path / "graph"), "a string, b string, weight long"
    edges = spark.range(1, 1301).select(F.concat(F.lit("n"), F.col("id")).alias("a"), F.lit("hub").alias("b"), F.col("id").alias("weight")).repartition(3)
    graph_sink.write_graph(edges, path, "one/two", batch=100)
    graph_sink.write_graph(edges.limit(5), path, "other")
    read = lambda *n: graph_sink.read_graph(spark, path, kind, list(n))
    assert sorted(map(tuple, read("one/two").drop("namespace").collect())) == sorted(map(tuple, edges.collect()))
    assert {r.namespace: r["count"] for r in read("one/two", "other", "nothing").groupBy("namespace").count().collect()} == {"one/two": 1300, "other": 5}
    import pyarrow.parquet as pq

    files = graph_sink.manifest(path, "one/two")["files"]
    sizes = [pq.ParquetFile(f"{path}/ns-one%2Ftwo/{f}").metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f"{path}/ns-one%2Ftwo/{f}").metadata.num_row_groups)]
    assert max(sizes) == 100 and sum(sizes) == 1300
    graph_sink.write_graph(edges.limit(7), path, "one/two", replace=False)
    assert read("one/two").count() == 1307
    graph_sink.write_graph(edges.limit(2), path, "one/two")
    assert read("one/two").count() == 2 and read("other").count() == 5


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "graph")
    good = spark.range(50).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"), F.col("id").alias("weight"))
    graph_sink.write_graph(good, path, "n")
    before = sorted(str(p) for p in (tmp_path / "graph").rglob("*"))
    bad = spark.range(0, 4000, 1, 2).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"), F.when(F.col("id") == 3900, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("weight"))
    with pytest.raises(Exception, match="lost"):
        graph_sink.write_graph(bad, path, "n")
    assert sorted(str(p) for p in (tmp_path / "graph").rglob("*")) == before
    assert graph_sink.read_graph(spark, path, good.schema, ["n"]).count() == 50
    with pytest.raises(Exception, match="namespace"):
        graph_sink.write_graph(good, path, " ")
