"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm._store import discard, materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a long, b long); label is the smallest node reachable.

    Alternating large-star and small-star steps: each round is an aggregate by node, which combines before the
    shuffle, and a join of the edges with it, whose hot nodes adaptive execution can split.  Rounds grow with the logarithm
    of the longest chain.  Each round is written to the shared folder.  Loops and repeated edges are ignored.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u goes to the smallest node around u
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialise(small, "edges")
        discard(now)
        now = new
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label"))
