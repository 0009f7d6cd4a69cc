"""Names under which entities are known: one index of labels and aliases, used where mentions meet entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import graphs


def folded(name: Column) -> Column:
    """A name as it is compared: without regard to case and outer or repeated blanks."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def alias_index(entities: DataFrame) -> DataFrame:
    """(alias, canonical) of entities (canonical, aliases array, seq): who a name stands for.

    The canonical name is an alias, too.  Where several entities claim a name, the one written last (the largest seq) has it, of one seq the
    greatest canonical name.  Null and blank names are left out.
    """
    each = entities.select("canonical", "seq", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    each = each.select(folded(F.col("alias")).alias("alias"), "canonical", "seq").where("alias <> ''")
    return each.groupBy("alias").agg(F.max_by("canonical", F.struct("seq", "canonical")).alias("canonical"))


def canonical_mentions(ms: DataFrame, index: DataFrame, keep: bool = False) -> DataFrame:
    """ms (doc_id, name, ...) under canonical names; a name that is nobody's is left out, or with ``keep`` stays as it is."""
    key = F.struct(folded(F.col("name")).alias("f"))
    known = index.select(F.struct(F.col("alias").alias("f")).alias("__key"), F.col("canonical").alias("__canonical"))
    out = ms.withColumn("__key", key).join(known, "__key", "left" if keep else "inner")
    return out.withColumn("name", F.coalesce("__canonical", "name")).select(*ms.columns)


def canonical_edges(ms: DataFrame, index: DataFrame, mode: str = "reference") -> DataFrame:
    """(a, b, weight, docs, doc_ids): canonical names that occur in one document; doc_ids are the documents, in order."""
    known = canonical_mentions(ms, index)
    edges = graphs.cooccurrence(known, mode)
    per = known.select("doc_id", "name").distinct()
    pairs = per.select("doc_id", F.col("name").alias("a")).join(per.select("doc_id", F.col("name").alias("b")), "doc_id").where("a < b")
    return edges.join(pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids")), ["a", "b"])


def find_by_label(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, canonical) of asked (asked): every entity whose label or one of whose aliases is the name asked for, whoever else has it."""
    each = entities.select("canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    named = each.select("canonical", folded(F.col("alias")).alias("__f")).where("__f <> ''").distinct()
    return asked.select("asked", folded(F.col("asked")).alias("__f")).distinct().join(named, "__f").select("asked", "canonical")


def neighbourhood(edges: DataFrame, index: DataFrame, seeds: DataFrame, most: int = 12) -> DataFrame:
    """(seed, other, weight, rank) of seeds (seed), each a label or alias, around the entities that they stand for."""
    who = seeds.select("seed", folded(F.col("seed")).alias("alias")).join(index, "alias").select("seed", "canonical").distinct()
    both = edges.select(F.col("a").alias("canonical"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("canonical"), F.col("a").alias("other"), "weight"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "other")).cast("long")
    return who.join(both, "canonical").select("seed", "other", "weight", rank.alias("rank")).where(F.col("rank") <= most)
