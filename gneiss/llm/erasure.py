"""Cascading erasure: tables laid out in files by the hash of their owner are rewritten by a merge scan with the victims of the same order.

Files and victims are sorted by the same hash.  A task takes a file, whose blocks have known first and last keys, and the victims of that
range, and advances a cursor over each; hashes that two owners share are resolved by comparing the identities.  Survivors go straight to the new
file, so no table is shuffled, and what is erased from a parent comes out in order as the victims of its children.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm._store import discard, materialise, shared_dir, table

FILES, BLOCK, SHARE = 350, 1 << 16, 400
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def key_of(owner: Column) -> Column:
    """The hash that tables are sorted by: of the identity in decimal, of the empty string for null."""
    return F.crc32(F.coalesce(owner.cast("string"), F.lit("")))


@dataclass
class Laid:
    """A table in files: its folder, its columns, and per file the keys of its blocks (file_no, path, blocks)."""

    name: str
    folder: str
    columns: list[str]
    index: DataFrame
    n_files: int
    owner: str
    by_id: bool


def lay_out(df: DataFrame, key: str, name: str, root: str, owner: str, files: int = FILES, by_id: bool = False) -> Laid:
    """Write df sorted by key, then by all other columns, nulls first, into files of 1 + floor(n / files) rows, of the last the rest.

    The key is no column of the files.  Rows are sorted by ranges of key and columns together, so the rows of one owner, however many, are
    split over tasks; what a task has counted gives each row its place.  A file is written by one task, which streams it.  ``by_id`` says
    that the owner's column is the first one, so that the blocks' keys hold it, too.  Equal rows keep no order among themselves.  An empty table gives no file.
    """
    columns = [c for c in df.columns if c != key]
    at, spot, number = (f"__{x}_{uuid.uuid4().hex}" for x in ("at", "spot", "number"))
    ordered = df.repartitionByRange(key, *columns).sortWithinPartitions(key, *columns)
    ordered = materialise(ordered.withColumn(at, F.monotonically_increasing_id()), f"sorted-{name}")
    part = F.shiftright(F.col(at), 33)
    sizes = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    total, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    rows, folder, written = 1 + total // files, f"{root}/final/{name}", f"{root}/work/written-{name}"
    n_files = -(-total // rows)
    placed = ordered.withColumn(spot, F.get(F.array(*map(F.lit, starts or [0])).cast("array<long>"), part.cast("int")) + F.col(at).bitwiseAND((1 << 33) - 1))
    placed = placed.withColumn(number, F.floor(F.col(spot) / rows).cast("int"))
    placed.drop(at).repartitionById(max(1, n_files), F.col(number)).sortWithinPartitions(number, spot).withColumnRenamed(number, "file_no").select(*columns, "file_no").write.partitionBy("file_no").parquet(written)
    one = F.struct(F.col(key).alias("crc"), (F.col(columns[0]) if by_id else F.lit(0)).cast("long").alias("id"))
    blocks = placed.groupBy(F.col(number).alias("file_no"), F.floor((F.col(spot) % rows) / BLOCK).cast("int").alias("block")).agg(F.count("*").alias("n"), F.min(one).alias("lo"), F.max(one).alias("hi"))
    blocks = blocks.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("block", "n", "lo", "hi"))).alias("blocks"))
    spark = df.sparkSession
    paths = [(int(p.split("file_no=")[1].split("/")[0]), p) for p in _files(written)]
    fs, inside = _at(folder)
    fs.create_dir(inside)
    for number_, p in paths:  # no reader shall take a folder's name for a column
        fs.move(_at(p)[1], f"{inside}/{number_:06d}.parquet")
    paths = spark.createDataFrame([(n, f"{folder}/{n:06d}.parquet") for n, _ in paths], "file_no int, path string")
    index = materialise(blocks.join(F.broadcast(paths), "file_no"), f"index-{name}")  # a row for each file, of which there are ``files`` and one at most
    discard(ordered)
    return Laid(name, folder, columns, index, n_files, owner, by_id)


def _files(folder: str) -> list[str]:
    """Data files below a folder, in order, with the folder's scheme."""
    fs, path = _at(folder)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(folder + f.path.removeprefix(path) for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_")))


class Cursor:
    """Victims (crc, id), sorted, of several files (path, least and greatest hash or null) in order; batches are read as they are needed."""

    def __init__(self, files: list[tuple[str, int | None, int | None]], first: tuple[int, int], last: tuple[int, int]):
        paths = [p for p, lo, hi in files if (lo is None or lo <= last[0]) and (hi is None or hi >= first[0])]
        self.keys = np.zeros(0, [("crc", np.int64), ("id", np.int64)])
        self.batches: Iterator = iter(())
        if paths:
            crc = pc.field("crc")
            self.batches = ds.dataset([_at(p)[1] for p in paths], filesystem=_at(paths[0])[0], format="parquet").scanner(columns=["crc", "id"], filter=(crc >= first[0]) & (crc <= last[0]), batch_size=BLOCK).to_batches()

    def between(self, lo: tuple[int, int], hi: tuple[int, int]) -> np.ndarray:
        """The victims from lo to hi; the cursor stays at hi, and never goes back."""
        edge = np.array([hi], self.keys.dtype)
        while not len(self.keys) or self.keys[-1].item() <= hi:
            batch = next(self.batches, None)
            if batch is None:
                break
            new = np.empty(batch.num_rows, self.keys.dtype)
            new["crc"], new["id"] = batch.column(0), batch.column(1)
            self.keys = np.concatenate([self.keys[np.searchsorted(self.keys, np.array([lo], self.keys.dtype))[0] :], new])
        a, b = np.searchsorted(self.keys, np.array([lo], self.keys.dtype))[0], np.searchsorted(self.keys, edge, side="right")[0]
        self.keys = self.keys[a:]
        return self.keys[: b - a]


def _range(key: dict, by_id: bool, low: bool) -> tuple[int, int]:
    return key["crc"], key["id"] if by_id and key["id"] is not None else _LEAST if low else _MOST


def _hits(path: str, blocks: list[dict], victims: list[tuple], owner: str, by_id: bool, columns: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of a file's rows, a mark for those whose owner is a victim, and the victims of the run: the file and the victims are read side by side."""
    fs, inside = _at(path)
    cursor = Cursor(victims, _range(blocks[0]["lo"], by_id, True), _range(blocks[-1]["hi"], by_id, False))
    left, keys, turn = 0, None, iter(blocks)
    with fs.open_input_file(inside) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=BLOCK, columns=columns):
            start = 0
            while start < batch.num_rows:
                if not left:
                    block = next(turn)
                    left, keys = block["n"], cursor.between(_range(block["lo"], by_id, True), _range(block["hi"], by_id, False))
                run = batch.slice(start, min(left, batch.num_rows - start))
                own = run.column(run.schema.get_field_index(owner))
                yield run, pc.is_in(own, pa.array(keys["id"], own.type)).fill_null(False).to_numpy(zero_copy_only=False) & ~np.asarray(own.is_null()), keys
                start, left = start + run.num_rows, left - run.num_rows


def _may_hold(blocks: list[dict], victims: list[tuple], by_id: bool) -> bool:
    cursor = Cursor(victims, _range(blocks[0]["lo"], by_id, True), _range(blocks[-1]["hi"], by_id, False))
    return any(len(cursor.between(_range(b["lo"], by_id, True), _range(b["hi"], by_id, False))) for b in blocks)


def merge_scan(laid: Laid, victims: list[tuple], work: str, emit: bool = False) -> DataFrame:
    """What the files of a table become: (file_no, path, n_rows, n_erased, new_path, erased_path, lo, hi), of files that hold a victim.

    victims: files of (crc, id), sorted as one, each with its least and greatest hash or null.  new_path is null where no row survives.  With ``emit`` the hash and first column of the erased rows are
    written in order, as victims of a child table.  An attempt writes under a name of its own, so a lost executor leaves nothing that counts.
    """
    owner, by_id, kind = laid.owner, laid.by_id, "file_no int, path string, n_rows long, n_erased long, new_path string, erased_path string, lo long, hi long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            path, blocks = row["path"], row["blocks"]
            if not _may_hold(blocks, victims, by_id):
                continue
            rows = sum(b["n"] for b in blocks)
            erased = sum(int(hit.sum()) for _, hit, _ in _hits(path, blocks, victims, owner, by_id, [owner]))
            if not erased:
                continue
            out = {"file_no": row["file_no"], "path": path, "n_rows": rows - erased, "n_erased": erased, "new_path": None, "erased_path": None, "lo": blocks[0]["lo"]["crc"], "hi": blocks[-1]["hi"]["crc"]}
            name = f"{row['file_no']:06d}-{uuid.uuid4().hex}.parquet"
            fs, _ = _at(work)
            fs.create_dir(_at(work)[1])
            keep = gone = None
            for batch, hit, keys in _hits(path, blocks, victims, owner, by_id, None):
                if erased < rows:
                    keep = keep or pq.ParquetWriter(_at(f"{work}/new-{name}")[1], batch.schema, filesystem=fs)
                    if not hit.all():
                        keep.write_batch(batch.filter(pa.array(~hit)))
                if emit and hit.any():
                    lost = batch.filter(pa.array(hit))
                    owners = lost.column(lost.schema.get_field_index(owner)).to_pylist()
                    by = dict(zip(keys["id"].tolist(), keys["crc"].tolist(), strict=True))
                    schema = pa.schema([("crc", pa.int64()), ("id", pa.int64())])
                    gone = gone or pq.ParquetWriter(_at(f"{work}/erased-{name}")[1], schema, filesystem=fs)
                    some = pc.is_valid(lost.column(0))
                    gone.write_batch(pa.record_batch([pa.array([by[o] for o in owners], pa.int64()), lost.column(0).cast(pa.int64())], schema=schema).filter(some))
            for writer, what in ((keep, "new_path"), (gone, "erased_path")):
                if writer:
                    writer.close()
                    out[what] = f"{work}/{'new' if what == 'new_path' else 'erased'}-{name}"
            yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_erased", pa.int64()), ("new_path", pa.string()), ("erased_path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))

    tasks = max(1, min(laid.n_files, 8 * laid.index.sparkSession.sparkContext.defaultParallelism))
    return laid.index.repartition(tasks).mapInArrow(run, kind)


def replace(done: list) -> dict[str, str]:
    """Put rewritten files in the place of the old ones; gives the new path of each old one (empty: removed).

    The new file is there before the old one goes.
    """
    out = {}
    for r in done:
        fs, old = _at(r.path)
        new = ""
        if r.new_path is not None:
            new = f"{posixpath.dirname(r.path)}/{r.file_no:06d}-survivors.parquet"
            fs.move(_at(r.new_path)[1], _at(new)[1])
        fs.delete_file(old)
        out[r.path] = new
    return out


def describe(files: DataFrame) -> DataFrame:
    """files (path, money, ...) with what the file holds: n_rows, cents, ids_sha256, columns.  A file is streamed by one task."""
    kind = "path string, n_rows long, cents long, ids_sha256 string, columns string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            fs, inside = _at(row["path"])
            digest, cents, n = hashlib.sha256(), 0, 0
            with fs.open_input_file(inside) as f:
                file = pq.ParquetFile(f)
                names = file.schema_arrow.names
                for batch in file.iter_batches(batch_size=BLOCK, columns=list(dict.fromkeys([names[0], row["money"]]))):
                    ids = batch.column(batch.schema.get_field_index(names[0])).to_pylist()
                    digest.update(("," * bool(n) + ",".join("" if i is None else str(i) for i in ids)).encode())
                    n += len(ids)
                    x = batch.column(batch.schema.get_field_index(row["money"])).to_numpy(zero_copy_only=False).astype(np.float64)
                    cents += int(np.floor(100 * x[np.isfinite(x)] + 0.5).astype(np.int64).sum())
            yield pa.RecordBatch.from_pylist([{"path": row["path"], "n_rows": n, "cents": cents, "ids_sha256": digest.hexdigest(), "columns": ",".join(names)}], schema=pa.schema([("path", pa.string()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("ids_sha256", pa.string()), ("columns", pa.string())]))

    return files.select("path", "money").mapInArrow(run, kind)


def victim_masters(clients: DataFrame, clicks: DataFrame, share: int = SHARE) -> DataFrame:
    """(master_id): those whose hash is a multiple of share, and the one whose clients have most clicks (of equals the smallest)."""
    own = clients.where("master_id IS NOT NULL").select("master_id", "client_id").distinct()
    counts = clicks.where("client_id IS NOT NULL").groupBy("client_id").agg(F.count("*").alias("n"))
    most = own.join(counts, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).orderBy(F.desc("n"), "master_id").limit(1)
    return own.select("master_id").distinct().where(F.crc32(F.col("master_id").cast("string")) % share == 0).unionByName(most.select("master_id")).distinct()


def erase(spark: SparkSession, clients: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame, masters: Callable[[DataFrame, DataFrame], DataFrame] = victim_masters, files: int = FILES) -> DataFrame:
    """Lay the four tables out in a new shared folder, erase the masters' clients with all that is theirs, and list the final files.

    Rows without an owner, and lines without a sale, are sorted under the empty identity and never erased.  Repeated rows stay or go
    together.  Texts of any length and further columns are carried along, whatever their names.  Of an empty table there is no file.
    """
    root, key = f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}", f"__key_{uuid.uuid4().hex}"
    work = f"{root}/work"
    own = sales.where("sale_id IS NOT NULL AND client_id IS NOT NULL").groupBy("sale_id").agg(F.min("client_id").alias(f"{key}o"))
    own = materialise(own, "owners")  # sums up by the same key as the join, which could not split a sale with most of the lines otherwise
    keyed = lines.join(own.withColumnRenamed("sale_id", f"{key}s"), F.col("sale_id") == F.col(f"{key}s"), "left").withColumn(key, key_of(F.col(f"{key}o"))).drop(f"{key}o", f"{key}s")
    laid = [lay_out(df.withColumn(key, key_of(F.col("client_id"))), key, name, root, "client_id", files) for name, df in (("clients", clients), ("clicks", clicks), ("sales", sales))]
    laid.append(lay_out(keyed, key, "sale_lines", root, "sale_id", files, by_id=True))
    discard(own)
    found = masters(clients, clicks)
    theirs = clients.join(found, "master_id", "left_semi").where("client_id IS NOT NULL").select(key_of(F.col("client_id")).alias("crc"), F.col("client_id").cast("long").alias("id")).distinct()
    theirs.repartitionByRange("crc", "id").sortWithinPartitions("crc", "id").write.parquet(f"{work}/victims")
    victims = [(p, None, None) for p in _files(f"{work}/victims")]
    money = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
    final: list[tuple] = []
    for one in laid:
        done = merge_scan(one, victims, f"{work}/{one.name}", emit=one.name == "sales").collect()  # a row for each rewritten file
        moved, erased = replace(done), {r.path: r.n_erased for r in done}
        for r in one.index.select("file_no", "path").collect():
            if path := moved.get(r.path, r.path):
                final.append((one.name, r.file_no, path, erased.get(r.path, 0), r.path in moved, money[one.name]))
        discard(one.index)
        if one.name == "sales":
            victims = [(r.erased_path, r.lo, r.hi) for r in sorted(done, key=lambda r: r.file_no) if r.erased_path]
    fs, inside = _at(work)
    fs.delete_dir(inside)
    kind = "table_name string, file_no long, path string, n_erased long, rewritten boolean, money string"
    listed = spark.createDataFrame(final, kind).repartition(max(1, min(len(final), 8 * spark.sparkContext.defaultParallelism)))
    said = listed.join(F.broadcast(describe(listed)), "path").drop("money")  # both have a row for each file
    return materialise(said.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), "erased-files")


def op13_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final files after the erasure: their rows, sums and digests, read from the files."""
    out = erase(spark, *(table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")))
    return out.select("table_name", "file_no", "n_rows", "n_erased", "cents", "rewritten", "ids_sha256", "columns", "path")
