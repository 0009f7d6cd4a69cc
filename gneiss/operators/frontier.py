"""Rounds over a graph: maps of maps that are followed to their entries, and the layers of a diagram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.graphs import _checkpoints

MOST_ROUNDS = 200


def follow_maps(maps: DataFrame, roots: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(url, depth): the maps that are reached from roots (url), and in how few steps; a map lists other maps (url, child).

    Each round joins the frontier with what it lists and leaves out what was reached before, so a cycle ends, and a map of which there is no
    content is reached and leads nowhere.  A round is checkpointed: a lost executor repeats one round at most.
    """
    _checkpoints(maps.sparkSession)
    lists = maps.where("url IS NOT NULL AND child IS NOT NULL").select("url", "child").distinct()
    seen = roots.where("url IS NOT NULL").select("url", F.lit(0).cast("long").alias("depth")).distinct().checkpoint()
    edge = seen
    for depth in range(1, most_rounds + 1):
        edge = edge.join(lists, "url").select(F.col("child").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth).cast("long")).checkpoint()
        if edge.isEmpty():
            return seen
        seen = seen.unionByName(edge).checkpoint()
    raise RuntimeError(f"maps did not end in {most_rounds} rounds")


def sitemap_entries(pages: DataFrame, roots: DataFrame, now, hours: int = 48, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(url, title, published, depth, score) of the entries of all sitemaps (url, xml) that roots (url) lead to, through indexes of any depth.

    An entry is taken once, from the nearest map; its score falls with its age within ``hours`` before ``now`` from 1 to 0, older ones are left out
    and undated ones have 0.5.  Maps that are no XML hold nothing.
    """
    from gneiss.operators import web

    child = F.explode(F.regexp_extract_all(F.coalesce("xml", F.lit("")), F.lit(r"(?s)<sitemap\b[^>]*>.*?<loc>\s*([^<]*?)\s*</loc>.*?</sitemap>"), F.lit(1)))
    reached = follow_maps(pages.select("url", child.alias("child")), roots, most_rounds)
    entries = web.feed_entries(pages.join(reached, "url").select(F.struct("depth", "url").alias("feed"), "xml"))
    age = (F.unix_seconds(now) - F.unix_seconds("published")) / 3600
    score = F.when(F.col("published").isNull(), 0.5).otherwise(F.round(F.greatest(F.lit(0.0), 1 - age / hours), 4))
    one = entries.groupBy("url").agg(F.min_by(F.struct("title", "published", F.col("feed.depth").alias("depth")), "feed").alias("e")).select("url", "e.*").withColumn("score", score)
    return one.where((F.col("score") > 0) | F.col("published").isNull())


def layers(nodes: DataFrame, edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(chart, node, layer, cyclic): the layers in which the nodes (chart, node) of charts are drawn; edges (chart, a, b).

    Without a cycle a node's layer is the longest way to it.  A round takes away the nodes that nothing left points to; what stays when a round takes none is
    a cycle and what hangs on it.  A chart with a cycle is laid out by the fewest steps from the nodes that nothing points to (or from the smallest node if
    there is none), and what those don't reach stands in a last layer.  Layers are numbered without gaps.  Ends of edges are nodes, too; nulls are left out.
    """
    _checkpoints(edges.sparkSession)
    e = edges.where("chart IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select("chart", "a", "b").distinct().checkpoint()
    ends = e.select("chart", F.col("a").alias("node")).unionByName(e.select("chart", F.col("b").alias("node")))
    every = nodes.where("chart IS NOT NULL AND node IS NOT NULL").select("chart", "node").unionByName(ends).distinct().checkpoint()
    left, live, done = every, e, None
    for layer in range(most_rounds):
        free = left.join(live.select("chart", F.col("b").alias("node")).distinct(), ["chart", "node"], "left_anti").withColumn("layer", F.lit(layer).cast("long")).checkpoint()
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free).checkpoint()
        left = left.join(free, ["chart", "node"], "left_anti").checkpoint()
        live = live.join(free.select("chart", F.col("node").alias("a")), ["chart", "a"], "left_anti").checkpoint()
    else:
        if not left.isEmpty():
            raise RuntimeError(f"layers did not end in {most_rounds} rounds")
    done = done if done is not None else every.limit(0).withColumn("layer", F.lit(0).cast("long"))
    knotted = left.select("chart").distinct().checkpoint()
    straight = done.join(knotted, "chart", "left_anti").withColumn("cyclic", F.lit(False))
    if knotted.isEmpty():
        return straight.select("chart", "node", "layer", "cyclic")
    mine, own = every.join(knotted, "chart"), e.join(knotted, "chart")
    tops = mine.join(own.select("chart", F.col("b").alias("node")).distinct(), ["chart", "node"], "left_anti")
    none = mine.join(tops.select("chart").distinct(), "chart", "left_anti").groupBy("chart").agg(F.min("node").alias("node"))
    pair = F.struct("chart", "node")
    steps = follow_maps(own.select(F.struct("chart", F.col("a").alias("node")).alias("url"), F.struct("chart", F.col("b").alias("node")).alias("child")), tops.unionByName(none).select(pair.alias("url")), most_rounds)
    placed = mine.join(steps.select("url.chart", "url.node", F.col("depth").alias("layer")), ["chart", "node"], "left")
    last = placed.groupBy("chart").agg((F.coalesce(F.max("layer"), F.lit(-1)) + 1).alias("last"))
    knots = placed.join(last, "chart").select("chart", "node", F.coalesce("layer", "last").cast("long").alias("layer"), F.lit(True).alias("cyclic"))
    return straight.select("chart", "node", "layer", "cyclic").unionByName(knots)
