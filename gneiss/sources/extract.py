"""Texts of files: each suffix has one reader, and every file ends with a text or a reason.

Files come as (path, content) of the binary source.  Bytes are read in Arrow batches; what is judged afterwards (quality, vendored paths,
pages that are source rather than articles) is column expressions.  Formats that need a model or a table store are set aside.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import code
from gneiss.functions import text as X
from gneiss.operators import web
from gneiss.sources.files import TRACKS, UNPACKED

# Languages by suffix, folders of source, and marks of templates.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "css": "css", "scss": "scss", "sql": "sql", "sh": "bash", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml"}
SOURCE_DIRS = "static templates src public assets components views layouts partials".split()
TEMPLATE = ["{%", "{{", "v-for", "ng-repeat", "<template>"]
CODE_NEAR = ["js", "css", "py", "ts", "jsx"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_INLINE = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}inline"


def docx_text(data: bytes) -> str:
    """Paragraphs in order, headings by their level, tables as numbered Markdown, pictures as stubs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        info = z.getinfo("word/document.xml")
        if info.file_size > UNPACKED:
            raise ValueError("document is too large when unpacked")
        body = ElementTree.fromstring(z.read(info)).find(f"{_W}body")

    def said(e) -> str:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n"}
        return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in e.iter()).strip()

    parts, tables, pictures = [], 0, 0
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            for _ in e.iter(_INLINE):
                parts.append(f"<!-- image:pending:{pictures}:inline_shape -->")
                pictures += 1
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"heading\s*([1-6])", (style.get(f"{_W}val") or "").lower()) if style is not None else None
            if line := said(e):
                parts.append("#" * int(level[1]) + " " + line if level else line)
        elif e.tag == f"{_W}tbl":
            rows = [[" ".join(said(c).split()) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if rows := [r for r in rows if r]:
                parts.append(f"<!-- table:{tables} -->\n" + web.markdown(rows))
                tables += 1
    return "\n\n".join(parts)


def html_mode(path: Column, raw: Column, code_near: Column) -> Column:
    """Why a page is source code; ``prose_article`` if it is not."""
    head = F.substring(F.coalesce(raw, F.lit("")), 1, 20_000)
    size = lambda rx, group: F.aggregate(F.regexp_extract_all(head, F.lit(rx), F.lit(group)), F.lit(0), lambda s, x: s + F.length(x))
    template = F.lit(False)
    for mark in TEMPLATE:
        template = template | F.contains(head, F.lit(mark))
    return (
        F.when(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, SOURCE_DIRS))), "path_in_source_dir").when(code_near, "colocated_with_code").when(template, "template_syntax_present")
        .when(size(r"(?is)<(?:script|style)\b[^>]*>(.*?)</(?:script|style)>", 1) > 1000, "embedded_script_or_style")
        .when(size(r"<[^>]{1,400}>", 0) > 0.55 * F.length(head), "high_markup_ratio").otherwise("prose_article")
    )


def extract(files: DataFrame) -> DataFrame:
    """(path, reader, status, reason, text, quality) of files (path, content); status is ok, quarantined or failed.

    Null and empty contents fail as empty; a suffix without a reader as unsupported.  Other columns are left out.
    """
    f = files.select("path", "content").withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))).withColumn("dir", F.regexp_extract("path", r"^(.*)/", 1))
    near = f.groupBy("dir").agg(F.max(F.col("suffix").isin(CODE_NEAR)).alias("near"))

    def read(batches):
        for p in batches:
            rows = []
            for path, content, suffix, near_ in zip(p["path"], p["content"], p["suffix"], p["near"], strict=True):
                content = bytes(content) if content is not None else b""
                raw, reader, reason = None, None, None
                if suffix in TRACKS["table"]:
                    reader, reason = "table", "deferred_tabular"
                elif suffix == "pdf" or suffix in TRACKS["image"]:
                    reader, reason = suffix, f"extractor_unavailable:{suffix}"
                elif suffix == "docx":
                    reader = "docx"
                    try:
                        raw = docx_text(content)
                    except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError):
                        reason = "docx_unreadable"
                elif suffix in ("md", "markdown", "txt", *TRACKS["web"], "xhtml") or suffix in LANGUAGES:
                    reader = "html" if suffix in (*TRACKS["web"], "xhtml") else "native_code" if suffix in LANGUAGES else "markdown"
                    raw = content.decode("utf-8", "replace")
                    if reader != "markdown" and b"\0" in content[:8192]:
                        reason = "binary_content"
                else:
                    reason = "unsupported_media_type"
                article = web.main_text(web.parse(raw)) if reader == "html" and reason is None else None
                rows.append((path, suffix, bool(near_), reader, reason, raw, article))
            yield pd.DataFrame(rows, columns=["path", "suffix", "near", "reader", "reason", "raw", "article"])

    got = f.join(near, "dir").select("path", "content", "suffix", "near").mapInPandas(read, "path string, suffix string, near boolean, reader string, reason string, raw string, article string")
    lang = F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.col("suffix"))
    got = got.withColumn("mode", F.when(F.col("reader") == "html", html_mode(F.col("path"), F.col("raw"), F.col("near"))))
    source = (F.col("reader") == "native_code") | ((F.col("reader") == "html") & (F.col("mode") != "prose_article"))
    got = got.withColumn("reader", F.when(F.col("mode") != "prose_article", "html_source").otherwise(F.col("reader")))
    quality, listed = F.lit(None).cast("double"), F.array().cast("array<string>")
    for group in code.SYMBOLS:
        quality, listed = F.when(lang == group, code.code_quality(F.col("raw"), group)["score"]).otherwise(quality), F.when(lang == group, code.symbols(F.col("raw"), group)).otherwise(listed)
    quality = F.coalesce(quality, code.code_quality(F.col("raw"), "none")["score"])
    fenced = F.concat(F.lit("# "), F.element_at(F.split("path", "/"), -1), F.lit("\n\n"), F.when(F.size(listed) > 0, F.concat(F.lit("symbols: "), F.array_join(listed, ", "), F.lit("\n\n"))).otherwise(""), F.lit("```"), F.coalesce(lang, F.lit("html")), F.lit("\n"), F.col("raw"), F.lit("\n```"))
    out = got.withColumn("quality", F.when(source, quality).otherwise(X.score_text(F.coalesce("article", "raw"))))
    bad = F.coalesce("reason", F.when(source & code.vendored(F.col("path")), "vendored_path").when(F.length(F.coalesce("article", "raw", F.lit(""))) == 0, "empty_extraction").when(source & (F.col("quality") < 0.2), "low_quality"))
    out = out.withColumn("reason", F.coalesce(bad, F.lit("")))
    status = F.when(F.col("reason") == "", "ok").when(F.col("reason") == "deferred_tabular", "quarantined").otherwise("failed")
    text = F.when(F.col("reason") == "", F.when(source, fenced).otherwise(F.coalesce("article", "raw")))
    return out.select("path", "reader", status.alias("status"), "reason", text.alias("text"), F.when(F.col("reason") == "", F.col("quality")).alias("quality"))
