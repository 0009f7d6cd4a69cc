"""Near-duplicate documents by shared chunk fingerprints, families of file names, and survivors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as X

JACCARD, CONTAINED, RATIO, LEAST_DF, SHARE, MOST_DF, CLUSTER, THOROUGH = 0.55, 0.85, 1.5, 3, 0.03, 12, 8, 0.7


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h): distinct fingerprints of each document's lines, without boilerplate, which is in at least
    max(3, 3 % of the documents) of them."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    raw = lines.select("doc_id", X.fingerprint(F.col("line")).alias("h")).distinct()
    cut = docs.agg(F.greatest(F.lit(LEAST_DF), F.floor(F.count("*") * SHARE)).alias("cut"))
    df = raw.groupBy("h").agg(F.count("*").alias("df"))
    kept = df.crossJoin(F.broadcast(cut)).where("df < cut").select("h", "df")  # cut is one row
    return raw.join(kept, "h").select("doc_id", "h", "df")


def shared(prints: DataFrame) -> DataFrame:
    """(a, b, n, size_a, size_b): pairs a < b with n common fingerprints; only those in 2 to 12 documents count, so each gives at
    most 66 pairs."""
    size = prints.groupBy("doc_id").agg(F.count("*").alias("size"))
    some = prints.where(F.col("df").between(2, MOST_DF)).select("doc_id", "h")
    pairs = some.select(F.col("doc_id").alias("a"), "h").join(some.select(F.col("doc_id").alias("b"), "h"), "h").where("a < b")
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.join(size.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a")), "a").join(size.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b")), "b")


def near(pairs: DataFrame, least: float = JACCARD) -> DataFrame:
    j = F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n"))
    return pairs.select("a", "b", j.alias("jaccard")).where(F.col("jaccard") >= least)


def contained(pairs: DataFrame, least: float = CONTAINED, ratio: float = RATIO) -> DataFrame:
    """(big, small, coverage): most of the small document stands in a much larger one."""
    first = F.col("size_a") >= F.col("size_b")
    out = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("small"), (F.col("n") / F.least("size_a", "size_b")).alias("coverage"), F.greatest("size_a", "size_b").alias("large"), F.least("size_a", "size_b").alias("little"))
    return out.where((F.col("coverage") >= least) & (F.col("large") >= ratio * F.col("little"))).select("big", "small", "coverage")


def absorbed(contains: DataFrame) -> DataFrame:
    """Each small document once, in the one that covers most of it; ties go to the smaller id."""
    w = Window.partitionBy("small").orderBy(F.desc(F.round("coverage", 9)), "big")
    return contains.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def families(files: DataFrame) -> DataFrame:
    """(family, members, first): names that differ in their version only."""
    return files.select("doc_id", X.family_key(F.col("file_name")).alias("family")).groupBy("family").agg(F.count("*").alias("members"), F.min("doc_id").alias("first"))


def linkage(links: DataFrame, component: DataFrame, most: int = CLUSTER) -> DataFrame:
    """(cluster, doc_id): complete-linkage clusters within the connected components (node, label) of links (a, b).

    A document joins only if it links to every member; documents with more links come first, then smaller ids; a cluster has at most ``most``.
    A component is handled in one task; components come from links of bounded degree.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        near_: dict[int, set[int]] = {}
        for a, b in zip(p["a"], p["b"], strict=True):
            near_.setdefault(a, set()).add(b)
            near_.setdefault(b, set()).add(a)
        rank = sorted(near_, key=lambda d: (-len(near_[d]), d))
        placed, rows = set(), []
        for d in rank:
            if d in placed:
                continue
            group = [d]
            for c in sorted(near_[d], key=lambda x: (-len(near_[x]), x)):
                if c not in placed and len(group) < most and all(c in near_[m] for m in group):
                    group.append(c)
            if len(group) > 1:
                placed.update(group)
                rows += [(min(group), m) for m in group]
        return pd.DataFrame(rows, columns=["cluster", "doc_id"])

    return links.join(component.select(F.col("node").alias("a"), "label"), "a").groupBy("label").applyInPandas(run, "cluster long, doc_id long")


def survivors(clusters: DataFrame, meta: DataFrame, thorough: float = THOROUGH) -> DataFrame:
    """clusters with role KEEP or SUPERSEDED: of the members with at least 70 % of the largest's size, the latest, then the largest."""
    w = Window.partitionBy("cluster")
    rows = clusters.join(meta, "doc_id").withColumn("__ok", F.col("size") >= thorough * F.max("size").over(w))
    first = F.row_number().over(w.orderBy(F.desc("__ok"), F.desc_nulls_last("modified"), F.desc("size"), "doc_id"))
    return rows.withColumn("role", F.when(first == 1, "KEEP").otherwise("SUPERSEDED")).drop("__ok")


def content_duplicates(docs: DataFrame) -> DataFrame:
    """(source, sha, copies, first): identical contents within a scope."""
    keyed = docs.select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return keyed.groupBy("source", "sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")
