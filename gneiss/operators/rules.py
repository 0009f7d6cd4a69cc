"""Sensitivity rules as a table, in place of constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as X

#: Rules that a table may have: they stand in the plan, each compiled once.
MOST_RULES = 10_000


def level_rule(rules: DataFrame, levels: DataFrame, base: str, lifted: str | None = None):
    """A function of (text, name) that gives the level: rules (level, pattern), levels (level, rank).

    A text starts at ``base``.  Each rule whose pattern is found in its name or its first characters, in lower case, may lift it to the rule's level,
    none lowers it; personal data lifts it to ``lifted``.  A pattern is a regular expression; null or blank ones say nothing.  Unknown levels raise.
    """
    rank = {r.level: r["rank"] for r in levels.select("level", "rank").limit(MOST_RULES).collect()}
    found = rules.where("pattern IS NOT NULL AND trim(pattern) <> ''").select("level", "pattern").distinct().limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if missing := ({r.level for r in found} | {base} | ({lifted} if lifted else set())) - set(rank):
        raise ValueError(f"levels without a rank: {', '.join(sorted(map(str, missing)))}")
    by: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: r.pattern):
        by.setdefault(r.level, []).append(r.pattern)

    def level(text: Column, name: Column | None = None, most: int = 20_000) -> Column:
        head = F.lower(F.concat_ws("\n", F.coalesce(name if name is not None else F.lit(""), F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, most)))
        out = F.lit(base)
        for one in sorted((x for x in rank if rank[x] > rank[base]), key=lambda x: rank[x]):
            hit = [head.rlike("|".join(f"(?:{p})" for p in by[one]))] if one in by else []
            hit += [X.pii_tags(text) != ""] if one == lifted else []
            for h in hit:
                out = F.when(h, one).otherwise(out)
        return out

    return level


def classify(docs: DataFrame, rules: DataFrame, levels: DataFrame, base: str = "internal", lifted: str | None = "confidential", text: str = "text", name: str | None = None) -> DataFrame:
    """docs with ``level``, by the rules of a table; a column of that name is replaced."""
    rule = level_rule(rules, levels, base, lifted)
    return docs.withColumn("level", rule(F.col(text), F.col(name) if name else None))
