"""Relations between vocabulary mentions that stand close together, asserted by patterns or handed on with a reason.

A document is read once, for its mentions; pairs are a range join of the array of mentions with itself, and patterns, scope and types are
judged by column expressions, the types by the gate of ``ontology`` as a join with its small table of rules.  Texts are not exchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.ontology import Gazetteer, Matcher, type_gate

# Fixed values, which must match for right results: what a gap between two mentions may say, by predicate in order of precedence, and the
# words that qualify, negate or relate.
GAPS = {
    "runsOn": r"(?:runs?|running|executes?|deployed?|hosted)\b.{0,20}?\b(?:on|to|in|by)",
    "implements": r"implements?|implementing|provides?|delivers?|enables?|supports?",
    "exposes": r"exposes?|speaks?|serves? over|publishes?|emits?",
    "dependsOn": r"depends? on|relies on|requires?|needs?|built on|based on|backed by",
    "integratesWith": r"integrates? with|works with|connects? to|talks? to",
    "alternativeTo": r"vs\.?|versus|instead of|rather than|as an alternative to|compared (?:to|with)",
    "supersedes": r"replaces?|supersedes?|has replaced",
    "rebrandedAs": r"renamed (?:to|as)|rebranded (?:to|as)|now (?:called|known as)",
    "deprecatedBy": r"deprecated (?:by|in favour of|in favor of)",
    "addressesRisk": r"mitigates?|prevents?|protects? against|addresses|guards? against|reduces?",
    "governedBy": r"complies? with|governed by|subject to|mandated by|regulated by|comply with",
    "measuredBy": r"measured by|tracked by|monitored (?:by|via)|expressed as",
    "partOf": r"part of|component of|module of|belongs to",
    "hasCapability": r"provides?|offers?|has|includes?",
}
LEAD = r"^\W*(?:(?:does|do|did|is|are|was|were|can|could|may|might|will|would|should|must)\s+)?(?:(?:not|never|no\s+longer)\s+)?"
QUALIFIED = r"\b(?:if|when|unless|only|except|provided|assuming|in some cases|typically|usually|may|might|can be)\b"
NEGATED = r"\b(?:not|never|cannot|can't|won't|doesn't|does not|no longer|isn't|is not|without|rather than|instead of)\b"
RELATIONAL = (
    r"\b(?:runs? on|running on|deployed? (?:on|to|in)|hosted (?:on|by|in)|executes? on|implements?|implementing|provides?|delivers?|offers?|enables?"
    r"|supports?|exposes?|speaks?|serves?|publishes?|emits?|depends? on|requires?|needs?|relies on|built on|based on|backed by"
    r"|integrates? with|works with|connects? to|talks? to|replaces?|supersedes?|deprecat(?:es|ed)|renamed|rebranded|migrat(?:es|ed) (?:to|from)"
    r"|alternatives? to|instead of|rather than|versus|vs\.?|compared (?:to|with)|mitigat(?:es|ed)|prevents?|protects? against|addresses|reduces?|guards? against"
    r"|complies? with|governed by|subject to|mandated by|regulated by|measured by|tracked by|monitored by|observed by"
    r"|part of|component of|consists? of|comprises?|includes?|contains?|is a|are a|acts? as|serves? as|used (?:for|as|by|to))\b"
)
HIGH_STAKES = ["supersedes", "rebrandedAs", "deprecatedBy", "contradicts"]
GAP = 60

MENTION = "start int, end int, surface string, canonical string, class string, lead string, rest string, tail string"


def has_trigger(text: Column) -> Column:
    """A relational verb stands in the text; only its absence says anything."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + RELATIONAL)


def in_context(docs: DataFrame, gazetteer: Gazetteer, gap: int = GAP) -> DataFrame:
    """docs (doc_id, text) with ``mentions``: array of MENTION in order of place.  A mention carries its sentence before (lead) and after
    it (rest), and the ``gap`` characters that follow (tail), so that nothing later needs the text."""
    names = [x.split()[0] for x in MENTION.split(", ")]

    def run(batches):
        matcher = Matcher(gazetteer)
        for p in batches:
            found = []
            for text in p["text"].fillna(""):
                edges = [-1, *(m.start() for m in re.finditer(r"[.!?\n]", text)), len(text)]
                rows = []
                for s, e, surface, name, kind in matcher.find(text):
                    left, right = edges[bisect_left(edges, s) - 1] + 1, edges[bisect_left(edges, e)]
                    rows.append(dict(zip(names, (s, e, surface, name, kind, text[left:s], text[e:right], text[e : e + gap]), strict=True)))
                found.append(rows)
            yield pd.DataFrame({"doc_id": p["doc_id"], "relational": p["relational"], "mentions": found})

    fields = ", ".join(f"`{x.split()[0]}`: {x.split()[1]}" for x in MENTION.split(", "))
    return docs.select("doc_id", "text", has_trigger(F.col("text")).alias("relational")).mapInPandas(run, f"doc_id long, relational boolean, mentions array<struct<{fields}>>")


def scan(docs: DataFrame, gazetteer: Gazetteer, weak: tuple[str, ...] = ("Vendor",), gap: int = GAP) -> DataFrame:
    """(doc_id, strong, relational, relations): per document how many strong entities it names, whether it has a relational verb, and the
    relations that stand between its mentions.

    A relation joins a mention with each one that begins within ``gap`` characters of its end, in the same sentence and of another
    thing; the first predicate whose pattern the gap ends in counts.  A document without such a verb has none.  Null and empty texts
    name nothing.
    """
    sure = F.filter("mentions", lambda m: m["class"] != "ambiguous")
    read = in_context(docs, gazetteer, gap).select("doc_id", "relational", sure.alias("ms"))
    strong = F.size(F.array_distinct(F.transform(F.filter("ms", lambda m: ~m["class"].isin(*weak)), lambda m: m["canonical"])))

    def follow(a: Column) -> Column:
        near = F.filter("ms", lambda b: (b["start"] >= a["end"]) & (b["start"] - a["end"] <= gap) & (b["canonical"] != a["canonical"]))
        return F.transform(near, lambda b: F.struct(a.alias("a"), b.alias("b"), F.substr(a["tail"], F.lit(1), b["start"] - a["end"]).alias("gap")))

    def relation(p: Column) -> Column:
        a, b, said = p["a"], p["b"], p["gap"]
        predicate = F.coalesce(*[F.when(said.rlike(f"(?i){LEAD}(?:{words})" + r"\W*$"), name) for name, words in GAPS.items()])
        evidence = F.concat(a["surface"], said, b["surface"])
        scope = F.when(said.rlike("(?i)" + NEGATED), "negated").when(F.concat(a["lead"], evidence, b["rest"]).rlike("(?i)" + QUALIFIED), "qualified").otherwise("")
        return F.struct(a["canonical"].alias("subject"), a["class"].alias("subject_class"), predicate.alias("predicate"), b["canonical"].alias("object"), b["class"].alias("object_class"), a["start"].alias("start"), b["end"].alias("end"), evidence.alias("evidence"), scope.alias("scope"))

    pairs = F.filter(F.flatten(F.transform("ms", follow)), lambda p: ~p["gap"].rlike(r"[.!?]\s"))
    out = read.select("doc_id", strong.alias("strong"), "relational", F.filter(F.transform(pairs, relation), lambda r: r["predicate"].isNotNull()).alias("relations"))
    return out.withColumn("relations", F.when(F.col("relational"), F.col("relations")).otherwise(F.slice("relations", 1, 0)))


def judged(scanned: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per relation: decision asserted or escalate, and why; a relation is never turned round."""
    gated = type_gate(scanned.select("doc_id", F.explode("relations").alias("r")).select("doc_id", "r.*"), rules)
    why = F.when(F.col("scope") != "", F.col("scope")).when(~F.col("ok"), "type_violation").otherwise("")
    return gated.withColumn("why", why).withColumn("decision", F.when(why == "", "asserted").otherwise("escalate")).drop("component", "reason")


def must_escalate(predicate: Column, type_ok: Column, tiers_agree: Column, routed_other: Column) -> Column:
    """Why a claim may not be settled by a cheap tier; empty if it may."""
    return F.when(predicate.isin(HIGH_STAKES), "high_stakes_predicate").when(~type_ok, "type_violation").when(routed_other, "unknown_predicate").when(~tiers_agree, "tier_disagreement").otherwise("")


def funnel(scanned: DataFrame, rules: DataFrame, least: int = 2) -> DataFrame:
    """(step, tier, chunks, share): how many chunks reach each tier, as a share of those with enough strong entities."""
    said = judged(scanned, rules).groupBy("doc_id").agg(F.count_if(F.col("decision") == "asserted").alias("yes"), F.count_if(F.col("decision") == "escalate").alias("up"))
    per = scanned.where(F.col("strong") >= least).select("doc_id", "relational").join(said, "doc_id", "left").fillna(0, ["yes", "up"])
    verb = F.col("relational")
    tiers = {
        "triggered": F.lit(True), "no_verb": ~verb, "to_patterns": verb, "asserted": verb & (F.col("yes") > 0), "to_model": verb & ((F.col("up") > 0) | (F.col("yes") == 0)),
    }
    row = per.agg(*[F.count_if(c).alias(k) for k, c in tiers.items()])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(k).alias("tier"), F.col(k).alias("chunks"), F.col("triggered").alias("base")) for i, k in enumerate(tiers)])).alias("t"))
    return out.select("t.step", "t.tier", "t.chunks", F.round(F.col("t.chunks") / F.greatest("t.base", F.lit(1)), 6).alias("share"))


def separation(scored: DataFrame) -> DataFrame:
    """scored (valid boolean, score): the mean of valid scores, of the others, and the difference."""
    good, bad = F.avg(F.when(F.col("valid"), F.col("score"))), F.avg(F.when(~F.col("valid"), F.col("score")))
    return scored.agg(good.alias("valid_mean"), bad.alias("invalid_mean"), (good - bad).alias("separation"))
