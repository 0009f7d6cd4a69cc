"""Tables in the cluster's shared folder, and the Arrow batch limits of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, from which on it is sent: this bounds what a Python worker holds at once, but for a single longer text.
BATCH_BYTES = 2 << 20
_own: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch holds whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="gneiss-")
    return _own[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_gneiss_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keeps(*own: str):
    """Of an operator (docs, ...) that uses the column names ``own`` in its work: columns of docs with such names come back unchanged, in their place.

    They have other names meanwhile.  A name that the operator gives a result of its own is the result's.  Names are compared as Spark does, without case.
    """

    def wrap(f):
        @functools.wraps(f)
        def run(docs: DataFrame, *args, **how) -> DataFrame:
            away = {c: f"kept_{uuid.uuid4().hex}" for c in docs.columns if c.lower() in own}
            if not away:
                return f(docs, *args, **how)
            out = f(docs.withColumnsRenamed(away), *args, **how)
            made = {c.lower() for c in out.columns}
            return out.drop(*[n for c, n in away.items() if c.lower() in made]).withColumnsRenamed({n: c for c, n in away.items() if c.lower() not in made})

        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
