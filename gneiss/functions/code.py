"""Source files: symbols, quality, vendored paths, safe names."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What declares a symbol, by language, and what marks a path as vendored or generated.
_SCRIPT = [
    r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)",
    r"(?m)^\s*(?:export\s+)?class\s+(\w+)",
    r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\(|function)",
]
_TYPED = [*_SCRIPT, r"(?m)^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"]
_STYLE = [r"(?m)^\s*([.#@][\w-]+[^{]*)\{"]
SYMBOLS = {
    "python": [r"(?m)^\s*(?:async\s+)?def\s+(\w+)", r"(?m)^\s*class\s+(\w+)"],
    "javascript": _SCRIPT, "jsx": _SCRIPT, "typescript": _TYPED, "tsx": _TYPED, "css": _STYLE, "scss": _STYLE,
    "sql": [r"(?i)(?:CREATE|ALTER)\s+(?:TABLE|VIEW|PROCEDURE|FUNCTION)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)"],
}
VENDORED = "node_modules site-packages dist build .git .venv venv __pycache__ .mypy_cache .pytest_cache vendor bower_components .next .nuxt coverage target .tox .eggs".split()
GENERATED = r"(?i)(?:package-lock\.json|yarn\.lock|poetry\.lock|pnpm-lock\.yaml|\.min\.(?:js|css)|\.bundle\.(?:js|css)|\.map)$"


def symbols(text: Column, lang: str, most: int = 60) -> Column:
    """Names that a source declares: by kind, then in order, each once; none for other languages and null."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx), F.lit(1)) for rx in SYMBOLS.get(lang, [])]
    if not found:
        return F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(*found), lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def code_quality(text: Column, lang: str) -> Column:
    """struct(score, warnings) of a source: long lines, broken characters and files without content lower it."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, r"\r\n|\n|\r"), lambda x: F.length(F.trim(x)) > 0)
    sizes = F.transform(lines, lambda x: F.length(x))
    mean = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x) / F.greatest(F.size(lines), F.lit(1))
    long_ = (mean > 250) | (F.array_max(sizes) > 5000)
    broken = (F.length(t) - F.length(F.replace(t, F.lit("�")))) / F.greatest(F.length(t), F.lit(1)) > 0.002
    trivial = (F.size(lines) < 3) & (F.size(symbols(text, lang)) == 0)
    remarks = (F.size(lines) > 3) & F.forall(lines, lambda x: F.ltrim(x).rlike(r"^(?:#|//|/\*|\*|--)"))
    flag = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    warned = F.concat(flag(long_, "likely_minified_or_generated"), flag(broken, "replacement_chars_present"), flag(trivial, "trivial_file"), flag(remarks, "comment_only_file"))
    lost = F.when(long_, 0.55).otherwise(0.0) + F.when(broken, 0.35).otherwise(0.0) + F.when(trivial, 0.25).otherwise(0.0)
    useless = F.when(F.length(t) == 0, "empty_extraction").when(F.contains(t, F.lit("\x00")), "binary_content_in_text_file").when(F.size(lines) == 0, "whitespace_only")
    score = F.when(useless.isNotNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.round(1.0 - lost, 3)))
    return F.struct(score.alias("score"), F.when(useless.isNotNull(), F.array(useless)).otherwise(warned).alias("warnings"))


def vendored(path: Column) -> Column:
    """A path through a folder of dependencies or build results, or a generated file."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, VENDORED))) | path.rlike(GENERATED)


def safe_name(name: Column, most: int = 180) -> Column:
    """The last part of a path with letters decomposed and all but A-Za-z0-9._ - replaced; ``upload`` if nothing is left."""

    @F.arrow_udf("string")
    def run(names: pa.Array) -> pa.Array:
        plain = (unicodedata.normalize("NFKD", (n or "upload").rstrip("/").rsplit("/", 1)[-1]) for n in names.to_pylist())
        return pa.array([(re.sub(r"[^A-Za-z0-9._ -]+", "_", n).strip() or "upload")[:most] for n in plain], pa.string())

    return run(name)
