"""Files: discovery, exclusions, types, archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Track by suffix.
TRACKS = {
    "text": ["md", "markdown", "txt", "rst"], "office": ["docx", "pdf"], "table": ["xlsx", "xls", "csv", "tsv"], "web": ["html", "htm"],
    "image": ["png", "jpg", "jpeg", "webp", "gif"], "code": ["py", "js", "ts", "css", "sql", "java", "go", "c", "cpp", "rs", "sh", "yaml", "yml", "json", "toml"], "archive": ["zip"],
}
MAX_BYTES, ENTRIES, UNPACKED, RATIO, DEPTH = 10 << 20, 5000, 200 << 20, 120, 3


def file_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t) for t, ss in TRACKS.items() for s in ss], "suffix string, track string")


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, size, modified, suffix) of the files below a folder, without their contents; Spark lists no empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"))


def excluded(path: Column, patterns: list[str]) -> Column:
    """A bare name excludes a whole part of the path, one with a slash a folder by its beginning, one with * ? [ by its shape."""
    out = F.lit(False)
    for p in patterns:
        p = p.replace("\\", "/")
        if any(c in p for c in "*?["):
            shape = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]-" or c.isalnum() else "\\" + c) for c in p)
            hit = path.rlike(f"^{shape}$") | path.rlike(f"(^|/){shape}$")
        elif "/" in p.strip("/"):
            q = p.strip("/")
            hit = (F.ltrim(path, F.lit("/")) == q) | F.ltrim(path, F.lit("/")).startswith(q + "/") | F.contains(path, F.lit(f"/{q}/"))
        else:
            hit = F.array_contains(F.split(path, "/"), p.strip("/"))
        out = out | hit
    return out


def select_files(files: DataFrame, exclude: list[str] = (), most: int | None = None) -> DataFrame:
    """files with track and reason (null if it can be read), excluded ones left out."""
    kept = files.where(~excluded(F.col("path"), list(exclude))) if exclude else files
    out = kept.join(F.broadcast(file_types(files.sparkSession)), "suffix", "left")  # a fixed list
    reason = F.when(F.col("track").isNull(), "unsupported_media_type").when(F.col("track") == "table", "deferred_tabular").when(F.col("size") == 0, "empty_file").when(F.col("size") > MAX_BYTES, "too_large")
    out = out.withColumn("reason", reason).dropDuplicates(["path"])
    return out.orderBy("path").limit(most) if most else out


def preview(files: DataFrame) -> DataFrame:
    """(suffix, files, bytes, ingestible) by falling count."""
    return files.groupBy("suffix").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("reason").isNull()).alias("ingestible")).orderBy(F.desc("files"), "suffix")


def expand(data: bytes, name: str, depth: int = 0) -> list[tuple[str, bytes | None, str | None]]:
    """(uri, content, reason) of the members of an archive; nested archives are opened too.  Members that leave the folder, are links, too large or
    packed too tightly are refused."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        infos = z.infolist()
    except zipfile.BadZipFile:
        return [(name, None, "bad_archive")]
    if len(infos) > ENTRIES:
        return [(name, None, "too_many_entries")]
    if sum(i.file_size for i in infos) > UNPACKED:
        return [(name, None, "uncompressed_too_large")]
    out = []
    for i in infos:
        uri = f"{name}!/{i.filename}"
        if i.is_dir():
            continue
        if i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/"):
            out.append((uri, None, "path_traversal"))
        elif (i.external_attr >> 16) & 0o170000 == 0o120000:
            out.append((uri, None, "symlink"))
        elif i.file_size > MAX_BYTES:
            out.append((uri, None, "member_too_large"))
        elif i.file_size > RATIO * max(i.compress_size, 1):
            out.append((uri, None, "compression_ratio"))
        elif i.filename.lower().endswith(".zip"):
            out += expand(z.read(i), uri, depth + 1) if depth + 1 < DEPTH else [(uri, None, "nested_too_deep")]
        else:
            out.append((uri, z.read(i), None))
    return out


def expand_archives(files: DataFrame) -> DataFrame:
    """(uri, content, reason) of files (path, content) that are archives."""

    def run(batches):
        for p in batches:
            yield pd.DataFrame([r for n, c in zip(p["path"], p["content"], strict=True) for r in expand(bytes(c), n)], columns=["uri", "content", "reason"])

    return files.select("path", "content").mapInPandas(run, "uri string, content binary, reason string")
