"""Mixing sources to target weights by hierarchical budgeting.

Sources are the leaves of a tree domain - language - source.  A budget of tokens is given to the root and handed down: children
share by weight, none gets more than its subtree can give (its tokens times max_epochs), and what one cannot give goes to its
siblings by weight before any of it goes back to the ancestors.  A leaf with budget b and T tokens gives b // T whole epochs and a prefix
of the next one: its documents in the seeded order of that epoch, up to the rest of its budget.

The prefix is found without sorting a leaf: tokens are summed by 4096 buckets of the order, and only the bucket in which the budget ends is
sorted.  Every document then decides alone, against its leaf's last order value, so texts are never exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm._store import discard, keeps, materialise, table, tune

SEED, MAX_EPOCHS, MAX_LEAVES = 17, 2, 20_000
DOMAIN_WEIGHTS = {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}
LANG_WEIGHTS = {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0}
_SHIFT = 52


@dataclass
class Node:
    name: str
    weight: float = 1.0
    tokens: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    budget: int = 0

    def capacity(self, epochs: int) -> int:
        return sum(c.capacity(epochs) for c in self.children.values()) if self.children else self.tokens * epochs


def share_out(total: int, weights: list[float], caps: list[int]) -> list[int]:
    """total by weight, none above its cap; what the capped ones cannot take goes to the others.  Whole numbers; the remainder goes to
    the first ones that can take it.  Children of weight 0 take only what the others cannot."""
    out = [0] * len(caps)
    total = min(total, sum(caps))
    for group in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w <= 0]):
        open_ = list(group)
        while open_ and total > 0:
            w = {i: weights[i] if weights[i] > 0 else 1.0 for i in open_}
            full = [i for i in open_ if total * w[i] / sum(w.values()) >= caps[i] - out[i]]
            if not full:
                part = {i: int(total * w[i] / sum(w.values())) for i in open_}
                for i in open_:
                    out[i] += part[i]
                total -= sum(part.values())
                for i in open_:
                    more = min(total, caps[i] - out[i])
                    out[i], total = out[i] + more, total - more
                break
            for i in full:
                total -= caps[i] - out[i]
                out[i] = caps[i]
                open_.remove(i)
    return out


def hand_down(node: Node, budget: int, epochs: int) -> None:
    node.budget = budget
    kids = list(node.children.values())
    for c, b in zip(kids, share_out(budget, [c.weight for c in kids], [c.capacity(epochs) for c in kids]), strict=True):
        hand_down(c, b, epochs)


def n_tokens(text: Column) -> Column:
    """Words ``[^\x20\x09-\x0D]+`` of the text; none for null."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([len((t or "").encode().split()) for t in texts.to_pylist()], pa.int64())

    return run(text)


def domain_of(source: Column) -> Column:
    """The domain of a source: the number at its end modulo 4; domain0 where there is none."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    return F.concat(F.lit("domain"), F.coalesce(number % 4, F.lit(0)).cast("string"))


#: Columns that the mixture makes for itself or as a result.
_OWN = ("__domain", "__lang", "__source", "__tokens", "__place", "__epochs", "__cut", "__copies")


@keeps(*_OWN)
def mix(docs: DataFrame, share: float = 1.0, seed: int = SEED, max_epochs: int = MAX_EPOCHS, domain_weights: dict[str, float] | None = None, lang_weights: dict[str, float] | None = None, source_weights: dict[str, float] | None = None, domain: Column | None = None) -> DataFrame:
    """docs with __domain, __tokens, __epochs (whole epochs of its leaf), __copies (int, how often the document is taken).

    The budget is ``share`` of all tokens; weights not named are 1.  A null lang or source is a leaf of its own, of weight 1.  A leaf
    without tokens has no whole epochs and gives its documents once, at no cost, if it has a budget share at all (max_epochs
    > 0).  Equal rows stand at one place of the order and are taken or left together.  More than MAX_LEAVES leaves are refused.  A null or
    empty text has no tokens, texts of any length are counted whole, an empty table gives an empty one.  Columns named as a result are replaced, all
    others come back as they are.
    """
    tune(docs.sparkSession)
    dom = domain_of(F.col("source")) if domain is None else domain
    lang, source = (F.coalesce(F.col(c), F.lit("\0null")) for c in ("lang", "source"))
    place = F.xxhash64(F.lit(seed), "doc_id", "text")
    slim = materialise(docs.select(dom.alias("domain"), lang.alias("lang"), source.alias("source"), n_tokens(F.col("text")).alias("tokens"), place.alias("place")), "mix")
    leaves = slim.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    root = Node("")
    dw, lw, sw = (DOMAIN_WEIGHTS if domain_weights is None else domain_weights), (LANG_WEIGHTS if lang_weights is None else lang_weights), source_weights or {}
    for r in sorted(leaves):
        d = root.children.setdefault(r["domain"], Node(r["domain"], dw.get(r["domain"], 1.0)))
        g = d.children.setdefault(r["lang"], Node(r["lang"], lw.get(r["lang"], 1.0)))
        g.children[r["source"]] = Node(r["source"], sw.get(r["source"], 1.0), r["tokens"])
    total = int(sum(r["tokens"] for r in leaves) * share)
    hand_down(root, min(total, root.capacity(max_epochs)), max_epochs)
    spark = docs.sparkSession
    rows = []
    for d in root.children.values():
        for g in d.children.values():
            for s in g.children.values():
                epochs = s.budget // s.tokens if s.tokens else 0
                rows.append((d.name, g.name, s.name, epochs, s.budget - epochs * s.tokens))
    plan = F.broadcast(spark.createDataFrame(rows, "domain string, lang string, source string, epochs int, rest long"))  # at most MAX_LEAVES rows
    leaf = ["domain", "lang", "source"]
    # the order of the epoch that is cut short
    turn = F.xxhash64("place", "epochs")
    placed = slim.join(plan, leaf).withColumn("turn", turn).withColumn("bucket", F.shiftright("turn", _SHIFT))
    sums = placed.groupBy(*leaf, "rest", "bucket").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # 4096 rows a leaf at most
    crossing = sums.withColumn("upto", upto).where("upto > rest").groupBy(*leaf).agg(F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("t"), "bucket").alias("before"))
    inside = placed.join(F.broadcast(crossing), [*leaf, "bucket"])  # one row a leaf
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = {tuple(r[:3]): r for r in inside.withColumn("run", run).groupBy(*leaf).agg(F.max(F.when(F.col("run") <= F.col("rest"), F.col("turn"))).alias("last"), F.first("bucket").alias("bucket")).collect()}
    discard(slim)
    final = []
    for d, g, s, epochs, rest in rows:
        r = last.get((d, g, s))
        # without a crossing bucket the rest takes all; without a document that still fits, all buckets before it
        cut = (1 << 63) - 1 if r is None else r["last"] if r["last"] is not None else (r["bucket"] << _SHIFT) - 1 if r["bucket"] > -(1 << 63 - _SHIFT) else None
        final.append((d, g, s, epochs, cut))
    final_df = F.broadcast(spark.createDataFrame(final, "__domain string, __lang string, __source string, __epochs int, __cut long"))
    keyed = docs.withColumn("__domain", dom).withColumn("__lang", lang).withColumn("__source", source).withColumn("__tokens", n_tokens(F.col("text"))).withColumn("__place", place)
    out = keyed.join(final_df, ["__domain", "__lang", "__source"])
    taken = F.coalesce((F.xxhash64("__place", "__epochs") <= F.col("__cut")), F.lit(False)).cast("int")
    return out.withColumn("__copies", F.col("__epochs") + taken).drop("__lang", "__source", "__place", "__cut")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture takes each document."""
    out = mix(table(spark, sf_dir, "documents"), share=0.6)
    return out.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__tokens").alias("n_tokens"), F.col("__epochs").alias("whole_epochs"), F.col("__copies").alias("copies"))


@keeps(*_OWN, "__turn")
def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of docs."""
    names = docs.columns
    return mix(docs, **how).where("__copies > 0").withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*names)
