"""Entity resolution, co-occurrence graphs, neighbourhoods and connected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import text as X

ABBREVIATED, SAME_DOC, SAME_FOLDER, ENTITIES, KEYWORDS, THRESHOLD = 0.35, 0.40, 0.30, 0.30, 0.15, 0.62
#: Size up to which contexts are held against each size of others by itself.
EXACT = 20


def mentions(docs: DataFrame, most: int | None = 10) -> DataFrame:
    """(doc_id, source, pos, raw, name): one row per entity found in a document, the first ``most`` or all of them, with its normal form."""
    found = docs.select("doc_id", "source", F.posexplode(X.title_entities(F.col("text"), most)).alias("pos", "raw"))
    return found.withColumn("name", X.normal_name(F.col("raw"))).where("name <> ''")


def exact_clusters(ms: DataFrame) -> DataFrame:
    """(name, canonical, mentions, docs): mentions of one normal name; the longest form names them, the first of equal length."""
    best = F.min(F.struct((-F.length("raw")).alias("n"), "doc_id", "pos", "raw"))["raw"]
    return ms.groupBy("name").agg(best.alias("canonical"), F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"))


def compatible(a: list[str], b: list[str]) -> float | None:
    """The last words must be equal; the other words of the shorter name must match words of the longer one in order, where a
    single letter matches what it begins.  In plain Python, for one pair; name_pairs() gives all pairs of a table."""
    if not a or not b or a[-1] != b[-1]:
        return None
    if a == b:
        return 1.0
    short, rest = sorted((a[:-1], b[:-1]), key=len)
    others = iter(rest)
    fits = lambda x, y: x == y or (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y))
    return ABBREVIATED if all(any(fits(s, o) for o in others) for s in short) else None


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(both == 0, 0.0).otherwise(both / F.size(F.array_union(a, b)))


def folder(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(uri, F.lit("")), r"\\", "/"), "/[^/]*$", "")


def name_pairs(names: DataFrame) -> DataFrame:
    """(label, name_a, name_b, base) of the distinct names (label, name) that may be one person's, name_a < name_b.

    The last words must be equal and the other words of the shorter name stand in the longer one in order, where a single letter
    matches what it begins.  So the first word of the shorter name begins with the same letter as some word of the longer one: names meet
    by last word and that letter only.  Names of the last word alone meet all of it.
    """
    parts = names.withColumn("w", F.split("name", " ")).select("label", "name", F.element_at("w", -1).alias("last"), F.slice("w", 1, F.size("w") - 1).alias("w"))
    initials = F.array_distinct(F.transform("w", lambda x: F.substring(x, 1, 1)))
    short = parts.select("label", "last", F.col("name").alias("short"), F.col("w").alias("v"), F.coalesce(F.get(initials, F.lit(0)), F.lit("")).alias("letter"))
    long = parts.select("label", "last", F.col("name").alias("long"), "w", F.explode(F.concat(F.array(F.lit("")), initials)).alias("letter"))
    met = short.join(long, ["label", "last", "letter"]).where((F.size("v") <= F.size("w")) & (F.col("short") != F.col("long")))
    fits = lambda x, y: (x == y) | ((F.length(x) == 1) & F.startswith(y, x)) | ((F.length(y) == 1) & F.startswith(x, y))
    matched = F.aggregate("w", F.lit(0), lambda i, y: i + F.when(F.coalesce(fits(F.get("v", i), y), F.lit(False)), 1).otherwise(0))
    return met.where(matched == F.size("v")).select("label", F.least("short", "long").alias("name_a"), F.greatest("short", "long").alias("name_b"), F.lit(ABBREVIATED).alias("base")).distinct()


def _shared_keys(items: Column, least: float, first: bool) -> Column:
    """Keys of a set (sorted hashes) such that two sets of at least this Jaccard similarity have one in common.

    For each size that the other set may have, the least overlap tells how many of the first values must hold a common one; where only
    equal sets are as similar, the whole set is the key.  Sizes over EXACT are put into ranges, so that the number of keys grows with the
    set and not with its square; the smallest size of a range gives the overlap.  ``first`` tells which of the two sizes is the own one.
    """
    slack, starts = 1e-9, [EXACT + 1]
    while starts[-1] < 1 << 31:
        starts.append(int(starts[-1] * max(1 / least, 1.1)) + 1)
    edges = F.array(*map(F.lit, starts[:-1]))
    size_range = lambda m: F.when(m <= EXACT, m).otherwise(EXACT + F.size(F.filter(edges, lambda e: e <= m)))
    low, high = lambda n: F.ceil(n * least - slack).cast("int"), lambda n: F.floor(n / least + slack).cast("int")
    bound = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  # value is found once, not once for each key

    def keys(s: Column) -> Column:
        def of(other: Column) -> Column:
            m = F.when(other <= EXACT, other).otherwise(F.greatest(low(s["n"]), F.get(edges, other - EXACT - 1)))
            overlap = F.ceil(least / (1 + least) * (s["n"] + m) - slack).cast("int")
            pair = (s["own"], other) if first else (other, s["own"])
            equal = (overlap >= F.greatest(s["n"], m)) & ((F.greatest(s["own"], other) <= EXACT) | F.lit(least >= 1))
            return bound(F.struct(F.xxhash64(*pair).alias("pair"), overlap.alias("overlap"), equal.alias("equal")), each)

        def each(t: Column) -> Column:
            return F.when(t["equal"], F.array(F.xxhash64(t["pair"], s["items"]))).otherwise(F.transform(F.slice(s["items"], F.lit(1), s["n"] - t["overlap"] + 1), lambda x: F.xxhash64(t["pair"], x)))

        return F.when(s["n"] > 0, F.array_distinct(F.flatten(F.transform(F.sequence(size_range(low(s["n"])), size_range(high(s["n"]))), of)))).otherwise(F.array().cast("array<bigint>"))

    sized = lambda x: bound(F.struct(x.alias("items"), F.size(x).alias("n"), size_range(F.size(x)).alias("own")), keys)
    return bound(items, sized)


def _context_keys(need: float, first: bool) -> Column:
    """Keys of which two contexts (near, keywords) have one in common if their weighted similarities reach ``need``: either both count and the
    greater one reaches its share, or one reaches all of it alone."""
    sets = {c: F.array_sort(F.transform(c, lambda x: F.xxhash64(x))) for c in ("near", "keywords")}
    both = (F.size("near") > 0) & (F.size("keywords") > 0)
    out = []
    for c, weight in (("near", ENTITIES), ("keywords", KEYWORDS)):
        for name, least, where in (("alone", need / weight, F.lit(True)), ("both", need / (ENTITIES + KEYWORDS), both)):
            if least <= 1 + 1e-9:
                tag = F.lit(f"{c} {name}")
                keys = F.transform(_shared_keys(sets[c], min(least, 1.0), first), lambda k: F.xxhash64(tag, k))  # noqa: B023
                out.append(F.when(where, keys).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.concat(*out)) if out else F.array().cast("array<bigint>")


def _united(ms: DataFrame, names: DataFrame) -> DataFrame:
    """(label, name, doc_id, place, near, keywords): of the mentions of these names (label, name), each name's context in a document."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    one = ms.join(names, ["label", "name"], "left_semi").groupBy("label", "name", "doc_id").agg(F.min("uri").alias("uri"), flat("near"), flat("keywords"))
    place = F.when(folder(F.col("uri")) != "", folder(F.col("uri")))
    return one.select("label", "name", "doc_id", place.alias("place"), "near", "keywords")


def name_links(known: DataFrame, ms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows (label, x, y) of ``known`` for which a mention of x and one of y reach the threshold; all names have mentions.

    One pair of mentions is enough for two names, so documents are not paired: names meet by a common document, then a common place, and those
    that are left by keys which any two contexts as similar as needed share; each stage takes only what those before it did not link, and
    only names that are left have their contexts collected.  x should be the rarer name: its rows are repeated for each y, those of y are
    not.  Equal contexts of a name are one; keys go with the numbers of contexts, which are looked at when they meet.
    """
    pair, found = ["label", "x", "y"], None
    if ABBREVIATED >= threshold:  # any two mentions
        return known.select(*pair)
    of = lambda left: left.select("label", F.explode(F.array("x", "y")).alias("name")).distinct()
    seen = _united(ms, of(known)).select("label", "name", "doc_id", "place").checkpoint()
    for at, weight in (("doc_id", SAME_DOC), ("place", SAME_FOLDER), (None, 0.0)):
        on = [at] if at else []
        left = known.select(*pair) if found is None else known.select(*pair).join(found, pair, "left_anti").checkpoint()
        if ABBREVIATED + min(1.0, weight) >= threshold:
            x, y = (seen.where(f"{at} IS NOT NULL").select("label", F.col("name").alias(c), at).distinct() for c in "xy")
            got = left.join(x, ["label", "x"]).join(y, ["label", "y", at], "left_semi").select(*pair).distinct()
        else:
            need = threshold - ABBREVIATED - weight
            rows = _united(ms, of(left))
            rows = (rows.where(f"{at} IS NOT NULL") if at else rows).select("label", "name", *on, "near", "keywords").distinct().withColumn("row", F.monotonically_increasing_id()).checkpoint()
            x, y = (rows.select("label", F.col("name").alias(c), *on, F.col("row").alias(f"row_{c}"), F.explode(_context_keys(need, c == "x")).alias("key")) for c in "xy")
            met = left.join(x, ["label", "x"]).join(y, ["label", "y", *on, "key"]).select(*pair, "row_x", "row_y").distinct()
            for c in "xy":
                met = met.join(rows.select(F.col("row").alias(f"row_{c}"), F.col("near").alias(f"near_{c}"), F.col("keywords").alias(f"keywords_{c}")), f"row_{c}")
            context = F.least(F.lit(1.0), F.lit(weight) + ENTITIES * jaccard(F.col("near_x"), F.col("near_y")) + KEYWORDS * jaccard(F.col("keywords_x"), F.col("keywords_y")))
            got = met.where(ABBREVIATED + context >= threshold).select(*pair).distinct()
        found = (got if found is None else found.unionByName(got)).checkpoint()
    return found


def _resolution(ms: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(mention_id, b, last) of each mention with the first and the last one of its name, and links (a, b) between first ones.

    Mentions of one normal name are one person's.  Of different names that may be one person's, one pair of mentions that reaches the
    threshold joins all of both, so names are linked, not mentions.  The context of a name in one document is united.
    """
    _checkpoints(ms.sparkSession)
    slim = ms.select("mention_id", "label", "name").where("mention_id IS NOT NULL AND label IS NOT NULL AND name IS NOT NULL").checkpoint()
    names = slim.groupBy("label", "name").agg(F.min("mention_id").alias("b"), F.max("mention_id").alias("last"), F.count("*").alias("n")).checkpoint()
    a, b = (names.select("label", F.col("name").alias(f"name_{c}"), F.struct("n", "name").alias(c)) for c in "ab")
    pairs = name_pairs(names.select("label", "name")).join(a, ["label", "name_a"]).join(b, ["label", "name_b"])
    known = pairs.select("label", F.least("a", "b")["name"].alias("x"), F.greatest("a", "b")["name"].alias("y")).checkpoint()
    linked = name_links(known, ms, threshold)
    x, y = (names.select("label", F.col("name").alias(c), F.col("b").alias(f"b_{c}")) for c in "xy")
    between = linked.join(x, ["label", "x"]).join(y, ["label", "y"]).select(F.col("b_x").alias("a"), F.col("b_y").alias("b"))
    return slim.join(names, ["label", "name"]).select("mention_id", "b", "last"), between


def resolution_links(ms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that join the mentions (mention_id, doc_id, uri, label, name, near array, keywords array) of one person: each mention to
    the first one of its name, and the first ones of names that are one person's."""
    of, between = _resolution(ms, threshold)
    return of.where("mention_id <> b").select(F.col("mention_id").alias("a"), "b").unionByName(between).distinct()


def resolved(ms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, label): what components() of resolution_links() gives, but only first mentions go through its rounds.  A mention without any
    other has no row."""
    of, between = _resolution(ms, threshold)
    of = of.groupBy("mention_id").agg(F.collect_set("b").alias("b"), F.max(F.col("b") != F.col("last")).alias("more")).checkpoint()
    several = of.where(F.size("b") > 1).select(F.element_at("b", 1).alias("a"), F.explode("b").alias("b")).where("a <> b")  # a mention of several names
    label = components(between.unionByName(several)).withColumnRenamed("node", "at")
    out = of.select("mention_id", "more", F.element_at("b", 1).alias("b")).join(label, F.col("b") == F.col("at"), "left")
    return out.where("more OR at IS NOT NULL").select(F.col("mention_id").alias("node"), F.coalesce("label", "b").alias("label"))


def _checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())


def checkpointed(df: DataFrame) -> DataFrame:
    """df as written to the shared folder."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label): the smallest node reachable, by passing labels on and jumping ahead until nothing changes.

    Each round is checkpointed to the shared folder.
    """
    _checkpoints(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node").checkpoint()
    for _ in range(most_rounds):
        low = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("low"))
        step = label.join(low, label["node"] == low["a"], "left").select("node", "label", F.least("label", "low").alias("new"))
        ahead = step.select(F.col("node").alias("at"), F.col("new").alias("jump"))
        new = step.join(ahead, step["new"] == ahead["at"], "left").select("node", F.col("label").alias("old"), F.least("new", "jump").alias("label")).checkpoint()
        label = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def cooccurrence(ms: DataFrame, mode: str = "reference") -> DataFrame:
    """(a, b, weight, docs): canonical pairs a < b within a document.  ``reference`` counts from both sides and per mention; ``chunks``
    counts documents."""
    per = ms.groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    pairs = per.select("doc_id", F.col("name").alias("a"), F.col("n").alias("na")).join(per.select("doc_id", F.col("name").alias("b"), F.col("n").alias("nb")), "doc_id").where("a < b")
    weight = F.sum(F.col("na") + F.col("nb")) if mode == "reference" else F.count("*")
    return pairs.groupBy("a", "b").agg(weight.alias("weight"), F.count("*").alias("docs"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, most: int = 12) -> DataFrame:
    """(seed, other, weight, rank): the strongest edges of each seed (seed string), in either direction, without regard to case."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("other"), "weight"))
    found = both.join(seeds.select("seed", F.lower("seed").alias("x")), "x")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "other")).cast("long")
    return found.select("seed", "other", "weight", rank.alias("rank")).where(F.col("rank") <= most)


def candidate_terms(docs: DataFrame, least_docs: int = 2, most: int = 50) -> DataFrame:
    """(term, docs): acronyms, camel-case and versioned names by how many documents have them."""
    shapes = [X.BEFORE + s + X.AFTER for s in (r"[A-Z][A-Z0-9]{1,7}(?:-[A-Z0-9]{1,6})?", r"[A-Z][a-z]+(?:[A-Z][a-z]+)+", r"[A-Z][A-Za-z]+\s?\d+(?:\.\d+)?")]
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(s), F.lit(0)) for s in shapes]))
    return docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).orderBy(F.desc("docs"), "term").limit(most)


def cap_nodes(facts: DataFrame, most: int) -> DataFrame:
    """facts (query_id, a, b, weight) admitted by weight while the distinct nodes stay within ``most``; the first one always is."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        keep = []
        for r in p.sort_values(["weight", "a", "b"], ascending=[False, True, True]).itertuples():
            new = seen | {r.a, r.b}
            if not seen or len(new) <= most:
                seen = new
                keep.append(r.Index)
        return p.loc[keep]

    return facts.groupBy("query_id").applyInPandas(run, facts.schema)


def closure(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(root, node, depth): every node that edges (a, b) lead to from a root, and the fewest steps.  Paths are doubled each round and only the
    shortest of each pair is kept, so cycles end and rounds grow with the logarithm of the longest chain.  Each round is checkpointed."""
    _checkpoints(edges.sparkSession)
    paths = edges.select(F.col("a").alias("root"), F.col("b").alias("node"), F.lit(1).cast("long").alias("depth")).distinct().checkpoint()
    n = paths.agg(F.count("*"), F.sum("depth")).first()
    for _ in range(most_rounds):
        on = paths.select(F.col("root").alias("node"), F.col("node").alias("far"), F.col("depth").alias("more"))
        longer = paths.join(on, "node").select("root", F.col("far").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))
        paths = paths.unionByName(longer).groupBy("root", "node").agg(F.min("depth").alias("depth")).checkpoint()
        now = paths.agg(F.count("*"), F.sum("depth")).first()
        if now == n:
            return paths
        n = now
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")
