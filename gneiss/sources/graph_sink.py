"""A sink for nodes and edges of graphs: batches of rows, one namespace at a time, all of it or nothing.

``spark.dataSource.register(GraphSink)``, then ``df.write.format("gneiss_graph").options(path=..., namespace=...).mode("overwrite").save()``.  The folder must be
one that the driver and all executors share; ``read_graph`` reads what is committed.
"""

from __future__ import annotations

import json
import posixpath
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BATCH = 500


def _at(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _name(namespace: str) -> str:
    """A namespace as the name of a folder."""
    return "ns-" + urllib.parse.quote(namespace, safe="")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    files: list[str]
    rows: int
    batches: int


class GraphWriter(DataSourceArrowWriter):
    """Each task writes its rows in batches into the attempt's own folder; the commit makes them the namespace's by one file that lists them."""

    def __init__(self, path: str, namespace: str, replace: bool, batch: int):
        self.path, self.namespace, self.replace, self.batch, self.attempt = path.rstrip("/"), namespace, replace, batch, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, top = _at(f"{self.path}/{_name(self.namespace)}/{self.attempt}")
        fs.create_dir(top)
        name, writer, held, rows, batches = f"{uuid.uuid4().hex}.parquet", None, [], 0, 0

        def put(some: list) -> None:
            nonlocal writer, batches
            table = pa.Table.from_batches(some)
            writer = writer or pq.ParquetWriter(f"{top}/{name}", table.schema, filesystem=fs)
            writer.write_table(table, row_group_size=self.batch)
            batches += 1

        for got in iterator:
            rows += got.num_rows
            while got.num_rows:
                need = self.batch - sum(b.num_rows for b in held)
                held.append(got.slice(0, need))
                got = got.slice(need)
                if sum(b.num_rows for b in held) == self.batch:
                    put(held)
                    held = []
        if held:
            put(held)
        if writer:
            writer.close()
        return Written([f"{self.attempt}/{name}"] if rows else [], rows, batches)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = _at(f"{self.path}/{_name(self.namespace)}")
        fs.create_dir(top)
        before = [] if self.replace else manifest(self.path, self.namespace)["files"]
        new = {"namespace": self.namespace, "files": before + [f for m in messages if m for f in m.files], "rows": sum(m.rows for m in messages if m)}
        with fs.open_output_stream(f"{top}/{self.attempt}.json") as f:
            f.write(json.dumps(new).encode())
        fs.move(f"{top}/{self.attempt}.json", f"{top}/manifest.json")
        if self.replace:  # what stood there is cleared once the new rows are in
            self._clear(fs, top, {self.attempt})

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = _at(f"{self.path}/{_name(self.namespace)}/{self.attempt}")
        import pyarrow.fs as pafs

        if fs.get_file_info(top).type == pafs.FileType.Directory:
            fs.delete_dir(top)

    def _clear(self, fs, top: str, but: set[str]) -> None:
        import pyarrow.fs as pafs

        for f in fs.get_file_info(pafs.FileSelector(top)):
            if f.type == pafs.FileType.Directory and f.base_name not in but:
                fs.delete_dir(f.path)


class GraphSink(DataSource):
    """Options: path, namespace, batch (rows of a batch, 500)."""

    @classmethod
    def name(cls) -> str:
        return "gneiss_graph"

    def writer(self, schema, overwrite: bool) -> GraphWriter:
        if not self.options.get("path") or not self.options.get("namespace", "").strip():
            raise ValueError("a path and a namespace are needed")
        return GraphWriter(self.options["path"], self.options["namespace"], overwrite, int(self.options.get("batch", BATCH)))


def manifest(path: str, namespace: str) -> dict:
    """What is committed of a namespace: its files and the rows of the last write."""
    fs, top = _at(f"{path.rstrip('/')}/{_name(namespace)}")
    if not fs.get_file_info(f"{top}/manifest.json").is_file:
        return {"namespace": namespace, "files": [], "rows": 0}
    with fs.open_input_stream(f"{top}/manifest.json") as f:
        return json.loads(f.read())


def write_graph(df: DataFrame, path: str, namespace: str, replace: bool = True, batch: int = BATCH) -> None:
    """Write the rows of one namespace: replaced as a whole, or added to."""
    df.sparkSession.dataSource.register(GraphSink)
    df.write.format("gneiss_graph").options(path=path, namespace=namespace, batch=str(batch)).mode("overwrite" if replace else "append").save()


def read_graph(spark: SparkSession, path: str, schema, namespaces: list[str]) -> DataFrame:
    """The committed rows of namespaces, with their namespace; those of a write that was not committed are not among them."""
    out = spark.createDataFrame([], schema).withColumn("namespace", F.lit("").cast("string"))
    for n in namespaces:
        files = [posixpath.join(path.rstrip("/"), _name(n), f) for f in manifest(path, n)["files"]]
        if files:
            out = out.unionByName(spark.read.schema(schema).parquet(*files).withColumn("namespace", F.lit(n)))
    return out
