"""Tables of a data folder in the roles that the operators give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their scope (source), size and a modification day, which every seventh document lacks."""
    d = table(spark, sf_dir, "documents")
    return d.withColumn("modified", F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") * 37 % 365).cast("long")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as questions; an item's vector is the one with its number."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
