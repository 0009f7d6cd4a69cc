"""Tables as streams: files that arrive one after the other, sinks that may see a batch twice."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; in local mode a temporary one if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrive(df: DataFrame, order: str, folder: str, parts: int = 4) -> None:
    """Write df in parts files, one after the other, by ranges of the column ``order`` of equal width; nulls come first."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    width = max(1, -(-(hi - lo + 1) // parts))
    place = F.coalesce(F.floor((F.col(order) - lo) / width), F.lit(0)).cast("int")
    for k in range(parts):
        df.where(place == k).coalesce(1).write.mode("append").parquet(folder)


@contextmanager
def with_state(spark: SparkSession, shuffles: int | None = None):
    """The session with the state store that arbitrary state needs; what was set before comes back."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ({"spark.sql.shuffle.partitions": str(shuffles)} if shuffles else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def commit_batches(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append", after: Callable[[int], bool] | None = None) -> int:
    """Read a stream to its end, each micro-batch into a folder of its own named by its number; gives the number of batches seen.

    A batch that comes again, since its task or the driver was lost before it was noted, takes the place of what it wrote before, so every
    row counts once.  ``after`` is told a batch's number when it is written, and ends the stream by giving False; the next start goes on there.
    """
    seen = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal seen
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        seen += 1
        if after is not None and not after(number):
            raise _Stop(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    except Exception as e:
        if not re.search(r"\b_Stop\b", str(e)):
            raise
    return seen


class _Stop(Exception):
    """Ends a stream between two batches."""


def committed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all batches; those of a batch that was begun and not ended are not among them."""
    return spark.read.schema(schema).parquet(f"{folder}/batch=*")
