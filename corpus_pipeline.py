"""The corpus pipeline: quality, near duplicates, benchmark contamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; what it gives is written as Parquet
and read again.  All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import decontam, mixing, quality, sharding, simhash
from gneiss.llm._store import materialise, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, by a network trained on the labels outside the held-out rows.

    Null and empty texts are scored as empty ones, texts of any length whole; equal texts are kept or left together.  An empty table gives
    an empty one.  No column is added, so none can clash.
    """
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), net) >= quality.BAR)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-shingles, similarity 0.8 or more): the smallest doc_id, null last.

    Near fingerprints, then MinHash bands give the candidates; exact sets of shingles decide.
    Null, empty and blank texts are copies of each other.  Repeated rows are one document.  Texts of any length are compared whole.  An
    empty table gives an empty one.  The columns that simhash names in _USED are left out of a table that has them.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, that is, of none at least half of the words in tiles.

    Null, empty and wordless texts and items match nothing; texts of any length are read whole; equal texts are kept or left together.  An
    empty table or benchmark leaves the table as it is.  Columns named __found or __text are left out.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of the target weights takes them: no more than twice, in whole epochs and a seeded prefix.

    A null lang or source is a leaf of its own; null and empty texts cost nothing.  Equal rows are taken equally often.  An empty table
    gives an empty one.
    """
    return mixing.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it, by equal bytes.

    A null text counts 8 bytes, a null doc_id sorts first, repeated rows have slots of their own, a long text is one row of its shard.  An
    empty table gives an empty one.  Columns named shard or slot are replaced.
    """
    return sharding.shard(docs)


STAGES = [("quality", quality_filter), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]
#: The classifier is trained and its rows can't be had from SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
