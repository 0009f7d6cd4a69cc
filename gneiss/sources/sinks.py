"""Changes to tables as new tables: merges, cascading deletes, replaced documents, resumable work, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(base: DataFrame, changes: DataFrame, keys: list[str], keep_if_null: list[str] = ()) -> DataFrame:
    """base with changes by key: rows are inserted or replaced; in ``keep_if_null`` columns a null leaves the old value.

    Columns that changes does not have keep their value.  Keys of changes are taken once, with the greatest row.
    """
    other = [c for c in base.columns if c not in keys]
    given = [c for c in other if c in changes.columns]
    once = changes.groupBy(*keys).agg(F.max(F.struct(*given) if given else F.lit(1)).alias("__new")).withColumn("__is", F.lit(True))
    both = base.withColumn("__old", F.lit(True)).join(once, keys, "full_outer")
    value = lambda c: F.col(c) if c not in given else F.coalesce(F.col(f"__new.{c}"), F.col(c)) if c in keep_if_null else F.when(F.col("__is"), F.col(f"__new.{c}")).otherwise(F.col(c))
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in base.columns])


def cascade(gone: DataFrame, children: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Children (table, its id, its parent's id) without all that hang on gone (id), one level after the other."""
    out, above = [], gone.select(F.col(gone.columns[0]).alias("__id")).distinct()
    for table, own, parent in children:
        hit = table.join(above, table[parent] == above["__id"], "left_semi")
        out.append(table.join(above, table[parent] == above["__id"], "left_anti"))
        above = hit.select(F.col(own).alias("__id")).distinct()
    return out


def replace_documents(chunks: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """chunks with all of a document's chunks replaced by new ones, so that none of an older version is left."""
    return chunks.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that no checkpoint names yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def write_checkpoint(rows: DataFrame, folder: str) -> None:
    """Append rows as JSON lines; ``remaining`` with what spark.read.json gives resumes from there."""
    rows.write.mode("append").json(folder)


def report(rows: DataFrame) -> DataFrame:
    """Cells without tabs and line breaks, all as text."""
    return rows.select(*[F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ")).alias(c) for c in rows.columns])


def write_report(rows: DataFrame, folder: str) -> None:
    report(rows).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(folder)
