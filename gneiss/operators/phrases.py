"""Terms of any number of words found in texts, by joins: a vocabulary may have any size.

A text is cut into pieces, a term into its words.  A piece that may begin a term meets the lengths of the terms that begin so, what
follows it up to a piece that ends at such a length meets the terms, and what separates the words is compared last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.arrays import running

#: What may stand between the words of a term, or be missing there; with all blanks of the alphabet, not of ASCII alone.
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
LOOSE = {"separator": rf"[-_/{BLANK}]+", "piece": rf"[A-Za-z0-9]+|[-_/{BLANK}]+|[^-_/A-Za-z0-9{BLANK}]", "inner": "[A-Za-z0-9]"}
#: Terms as they are written: they begin and end where no letter, digit, line or hyphen goes on.
LITERAL = {"separator": None, "piece": r"[\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]", "inner": r"[\p{L}\p{N}_-]"}
#: Terms, and first words of terms, up to which all of them are sent to every task; of more, they and the pieces are exchanged.
SENT = 200_000
STEP = 64


def _split(text: Column, how: dict) -> Column:
    return F.regexp_extract_all(text, F.lit(how["piece"]), F.lit(0))


def _between(piece: Column, how: dict) -> Column:
    return F.lit(False) if how["separator"] is None else piece.rlike(f"^{how['separator']}$")


def _ends(pieces: Column) -> Column:
    """Where each of the pieces ends, in characters."""
    return F.transform(F.array(F.transform(pieces, lambda p: F.length(p))), lambda n: F.zip_with(running(n), n, lambda a, b: a + b))[0]


def terms_of(forms: DataFrame, how: dict = LOOSE) -> DataFrame:
    """forms (form, strict, place) with key (in lower case, without separators), exact, joints (where words may part), heads (what a text's first
    piece may be) and steps (its pieces).  Forms that are blank or null are left out."""
    part = F.split(F.col("form"), how["separator"]) if how["separator"] else F.array("form")
    words = F.filter(part, lambda w: w != "")
    f = forms.where("form IS NOT NULL").withColumn("words", words).where(F.size("words") > 0)
    f = f.withColumn("exact", F.array_join("words", "")).withColumn("key", F.lower("exact")).withColumn("joints", _ends(F.col("words")))
    # a first piece may hold several words, where nothing separates them
    first = F.transform(F.sequence(F.lit(1), F.size("words")), lambda k: F.lower(F.get(_split(F.array_join(F.slice("words", F.lit(1), k), ""), how), F.lit(0))))
    f = f.withColumn("heads", F.array_distinct(first)).withColumn("steps", F.aggregate(F.transform("words", lambda w: F.size(_split(w, how))), F.lit(0), lambda a, b: a + b) * (2 if how["separator"] else 1))
    return f.select(*forms.columns, "key", "exact", "joints", "heads", "steps")


def _few(df: DataFrame) -> bool:
    return df.limit(SENT + 1).count() <= SENT


def candidates(texts: DataFrame, terms: DataFrame, how: dict = LOOSE) -> DataFrame:
    """(doc_id, start, end, surface, form, strict, place): every term at every place of texts (doc_id, text) where it stands as words of its own."""
    limits = terms.agg(F.max("steps").alias("steps")).first()
    most = max(limits.steps or 0, 1) + 1
    heads = terms.select(F.explode("heads").alias("head"), F.length("key").alias("len")).distinct().groupBy("head").agg(F.collect_set("len").alias("lens"))
    heads = heads.withColumn("sign", ~F.col("head").rlike(f"^{how['inner']}"))
    cut = texts.select("doc_id", _split(F.coalesce("text", F.lit("")), how).alias("p"))
    # characters before every STEP-th piece; those before another are of the few pieces between
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size("p") - 1) / STEP), F.lit(0)).cast("int"))
    cut = cut.select("doc_id", "p", running(F.transform(blocks, lambda b: F.length(F.array_join(F.slice("p", b * STEP + 1, F.lit(STEP)), "")))).alias("starts"))
    rows = cut.select("doc_id", "p", "starts", F.posexplode("p").alias("i", "x")).where(~_between(F.col("x"), how)).withColumn("head", F.lower("x"))
    block = F.floor(F.col("i") / STEP).cast("int")
    start = F.get("starts", block) + F.length(F.array_join(F.slice("p", block * STEP + 1, F.col("i") - block * STEP), ""))
    around = ["doc_id", start.alias("start"), F.get("p", F.col("i") - 1).alias("before"), F.slice("p", F.col("i") + 1, F.lit(most)).alias("ahead")]
    # what stands around a piece is copied for those that may begin a term; where these are exchanged, before they are
    rows = rows.join(F.broadcast(heads), "head").select(*around, "lens", "sign") if _few(heads) else rows.select(*around, "head").join(heads, "head")
    # a term that begins with a sign must not follow a letter or digit
    rows = rows.where(~F.col("sign") | ~F.coalesce(F.col("before").rlike(how["inner"]), F.lit(False)))
    # n is the pieces up to one that may end a term: what is not a separator is as long as one then
    met = rows.select("doc_id", "start", "ahead", "lens", F.explode(F.sequence(F.lit(1), F.least(F.size("ahead"), F.lit(most - 1)))).alias("n"))
    taken = F.slice("ahead", F.lit(1), F.col("n"))
    surface = F.array_join(taken, "")
    met = met.withColumn("exactly", F.regexp_replace(surface, how["separator"], "") if how["separator"] else surface).where(F.array_contains("lens", F.length("exactly")))
    met = met.where(~_between(F.get("ahead", F.col("n") - 1), how)).select("doc_id", "start", "ahead", "n", "exactly", F.lower("exactly").alias("key"))
    known = terms.select("key", "exact", "joints", "form", "strict", "place")
    hit = met.join(F.broadcast(known) if _few(known) else known, "key").where(~F.col("strict") | (F.col("exactly") == F.col("exact")))
    if how["separator"]:
        # separators stand where words may part
        gaps = F.aggregate(
            taken, F.struct(F.lit(0).alias("bare"), F.array().cast("array<int>").alias("gaps")),
            lambda s, x: F.when(_between(x, how), F.struct(s.bare.alias("bare"), F.concat(s.gaps, F.array(s.bare)).alias("gaps"))).otherwise(F.struct((s.bare + F.length(x)).alias("bare"), s.gaps.alias("gaps"))),
        )["gaps"]
        hit = hit.where(F.size(F.array_except(gaps, "joints")) == 0)
    last, after = F.get("ahead", F.col("n") - 1), F.get("ahead", F.col("n"))
    hit = hit.where(last.rlike(f"{how['inner']}$") | ~F.coalesce(after.rlike(how["inner"]), F.lit(False)))
    hit = hit.withColumn("surface", surface)
    return hit.select("doc_id", "start", (F.col("start") + F.length("surface")).alias("end"), "surface", "form", "strict", "place")


def _islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans with the number of their run of overlapping spans."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    far = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("isle", F.sum(F.when(far > F.col("start"), 0).otherwise(1)).over(by))


def _choose(spans: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each run of overlapping spans those that do not overlap one taken before, in the given order."""
    fields = [c for c in spans.columns if c not in keys]
    run = _islands(spans, keys).groupBy(*keys, "isle").agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *fields))).alias("all"))
    clear = lambda acc, x: ~F.exists(acc, lambda y: (x.start < y.end) & (y.start < x.end))
    taken = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return run.select(*keys, F.explode(taken).alias("x")).select(*keys, *[f"x.{f}" for f in fields])


def find(texts: DataFrame, forms: DataFrame, how: dict = LOOSE) -> DataFrame:
    """(doc_id, start, end, surface, form, strict) of the mentions of forms (form, strict, place) in texts (doc_id, text); no two overlap.

    A strict form is found in its own case only.  Strict and other forms are read from left to right apart, at each place the longest
    form, the next after its end; where a strict and another mention overlap, the longest wins, then the earliest.  Null and empty
    texts and an empty vocabulary give no row.  Texts may be of any length, and documents may repeat: each repeated row counts as one document.
    """
    found = candidates(texts, terms_of(forms, how), how).dropDuplicates(["doc_id", "start", "end", "form"])
    one = Window.partitionBy("doc_id", "strict", "start").orderBy(F.desc(F.length("form")), "place", "form")
    best = found.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k", "place")
    each = _choose(best, ["doc_id", "strict"], [F.col("start")])
    return _choose(each.select("doc_id", "start", "end", "surface", "form", "strict"), ["doc_id"], [F.col("start") - F.col("end"), F.col("start")])


def term_report(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(part, term, documents, chunks) of chunks (doc_id, chunk_id, text) and terms (term, strict).

    part ``term``: how many documents and chunks hold a term, of one or several words as they are written; ``one`` and ``two``: how many chunks
    hold at least one and two different terms; ``all``: how many there are.  A term that is nowhere counts 0.
    """
    key = F.struct("doc_id", "chunk_id")
    forms = terms.select(F.col("term").alias("form"), "strict", F.lit(0).alias("place"))
    hits = find(chunks.select(key.alias("doc_id"), "text"), forms, LITERAL).select(F.col("doc_id").alias("c"), F.lower("form").alias("low")).distinct()
    by = hits.groupBy("low").agg(F.count_distinct("c.doc_id").alias("documents"), F.count("*").alias("chunks"))
    named = terms.select("term", F.lower("term").alias("low")).distinct().join(by, "low", "left")
    rows = named.select(F.lit("term").alias("part"), "term", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "chunks")])
    per = hits.groupBy("c").agg(F.count("*").alias("n"))
    for part, least in (("one", 1), ("two", 2)):
        rows = rows.unionByName(per.where(F.col("n") >= least).agg(F.lit(part).alias("part"), F.lit("").alias("term"), F.count_distinct("c.doc_id").alias("documents"), F.count("*").alias("chunks")))
    return rows.unionByName(chunks.agg(F.lit("all").alias("part"), F.lit("").alias("term"), F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks")))
