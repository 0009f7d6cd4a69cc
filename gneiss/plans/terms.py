"""Queries of terms, aliases and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import aliases, graphs, phrases, rules
from gneiss.plans.registry import Registry
from gneiss.plans.sql import _mentions
from gneiss.sources.tables import documents, table

registry = Registry()


def _phrases(s, d):
    """Every run of two to four plain words of the benchmark is a term: 100,000 of them and more, depending on its size."""
    words = table(s, d, "benchmark").select(F.split("text", " ").alias("w"))

    def runs(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    form = words.select(F.explode(F.concat(*map(runs, (2, 3, 4)))).alias("form")).where(F.col("form").rlike("^[A-Za-z]+( [A-Za-z]+){1,3}$"))
    return form.distinct().select("form", F.lit(False).alias("strict"), F.lit(0).alias("place"))


@registry.query(r"""WITH b AS (SELECT string_split(text, ' ') AS w FROM benchmark), g AS (SELECT unnest(list_concat(list_concat(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + 2], ' '))), list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS form FROM b),
f AS (SELECT DISTINCT form, lower(form) AS low, 2 * len(string_split(form, ' ')) - 1 AS n FROM g WHERE regexp_full_match(form, '[A-Za-z]+( [A-Za-z]+){1,3}')),
p AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]')) AS x, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]'), 1) AS k FROM documents),
l AS (SELECT doc_id, lower(x) AS x0, lead(lower(x), 1) OVER w AS x1, lead(lower(x), 2) OVER w AS x2, lead(lower(x), 3) OVER w AS x3, lead(lower(x), 4) OVER w AS x4, lead(lower(x), 5) OVER w AS x5, lead(lower(x), 6) OVER w AS x6 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, 3 AS n, x0 || x1 || x2 AS low FROM l WHERE x1 = ' ' UNION ALL SELECT doc_id, 5, x0 || x1 || x2 || x3 || x4 FROM l WHERE x1 = ' ' AND x3 = ' ' UNION ALL SELECT doc_id, 7, x0 || x1 || x2 || x3 || x4 || x5 || x6 FROM l WHERE x1 = ' ' AND x3 = ' ' AND x5 = ' ')
SELECT doc_id, count(*) AS places, count(DISTINCT form) AS terms FROM r JOIN f USING (n, low) GROUP BY doc_id""")
def phrase_places(s, d):
    """How often the benchmark's phrases stand in each document, at all places, those within others too."""
    found = phrases.candidates(documents(s, d), phrases.terms_of(_phrases(s, d), phrases.LITERAL), phrases.LITERAL)
    return found.groupBy("doc_id").agg(F.count("*").alias("places"), F.count_distinct("form").alias("terms"))


@registry.query()
def phrase_find(s, d):
    """The benchmark's phrases in documents, the longest of those that overlap."""
    return phrases.find(documents(s, d), _phrases(s, d), phrases.LITERAL)


_TERMS = ["MIT License", "Apache License", "public license", "licensed under", "released under", "email", "nowhere to be found", "the", "GPL"]


def _holds(term: str) -> str:
    return f"SELECT doc_id, chunk_id, '{term}' AS term FROM c WHERE regexp_matches(text, '{'' if term == 'GPL' else '(?i)'}(^|[^\\p{{L}}\\p{{N}}_-]){term}($|[^\\p{{L}}\\p{{N}}_-])')"


@registry.query(rf"""WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS chunk_id, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)), t AS (SELECT unnest({_TERMS!r}) AS term),
h AS ({" UNION ALL ".join(map(_holds, _TERMS))}),
n AS (SELECT doc_id, chunk_id, count(*) AS n FROM h GROUP BY 1, 2)
SELECT 'term' AS part, term, count(DISTINCT doc_id) AS documents, count(doc_id) AS chunks FROM t LEFT JOIN h USING (term) GROUP BY term UNION ALL SELECT 'one', '', count(DISTINCT doc_id), count(*) FROM n UNION ALL SELECT 'two', '', count(DISTINCT doc_id), count(*) FROM n WHERE n >= 2 UNION ALL SELECT 'all', '', count(DISTINCT doc_id), count(*) FROM c""")
def term_mining(s, d):
    """Terms of one and more words in the lines of documents: documents and chunks of each, chunks with one and with two."""
    lines = documents(s, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("chunk_id", "text"))
    return phrases.term_report(lines, s.createDataFrame([(t, t == "GPL") for t in _TERMS], "term string, strict boolean"))


def _entities(s, d):
    """Names that begin with one word are aliases of that word; those with the most letters were written last."""
    names = graphs.mentions(documents(s, d)).select("name").distinct()
    first = F.split_part("name", F.lit(" "), F.lit(1))
    return names.groupBy(first.alias("canonical")).agg(F.collect_set("name").alias("aliases"), F.max(F.length("name")).cast("long").alias("seq"))


_INDEX = f"""WITH {_mentions}, ent AS (SELECT split_part(name, ' ', 1) AS canonical, list(DISTINCT name) AS aliases, max(length(name)) AS seq FROM good GROUP BY 1),
al AS (SELECT lower(trim(regexp_replace(unnest(list_concat([canonical], aliases)), '\\s+', ' ', 'g'))) AS alias, canonical, seq FROM ent), ix AS (SELECT alias, arg_max(canonical, (seq, canonical)) AS canonical FROM al WHERE alias <> '' GROUP BY alias),
m AS (SELECT doc_id, canonical AS name, count(*) AS n FROM good JOIN ix ON alias = lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) GROUP BY 1, 2),
ce AS (SELECT a.name AS a, b.name AS b, sum(a.n + b.n)::BIGINT AS weight, count(*) AS docs, array_to_string(list_sort(list(a.doc_id)), ',') AS doc_ids FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2)"""


@registry.query(_INDEX + " SELECT * FROM ce")
def alias_edges(s, d):
    e = aliases.canonical_edges(graphs.mentions(documents(s, d)), aliases.alias_index(_entities(s, d)))
    return e.withColumn("doc_ids", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ","))


@registry.query(_INDEX + """, seeds AS (SELECT name AS seed, count(*) AS n FROM good GROUP BY name ORDER BY n DESC, name LIMIT 8), who AS (SELECT seed, canonical FROM seeds JOIN ix ON alias = lower(seed)),
two AS (SELECT a AS x, b AS other, weight FROM ce UNION ALL SELECT b, a, weight FROM ce) SELECT seed, other, weight, rank FROM (SELECT seed, other, weight, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, other) AS rank FROM two JOIN who ON x = canonical) WHERE rank <= 12""")
def alias_neighbours(s, d):
    """The strongest neighbours of the eight commonest names, each under whatever entity has the name."""
    ms, index = graphs.mentions(documents(s, d)), aliases.alias_index(_entities(s, d))
    seeds = ms.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(8).select(F.col("name").alias("seed"))
    return aliases.neighbourhood(aliases.canonical_edges(ms, index), index, seeds)


_RULES = [("restricted", r"\bpassword\b|\bapi[_ ]key\b"), ("confidential", r"all rights reserved"), ("confidential", r"\blicen[sc]ed? under\b"), ("internal", "the"), ("public", "never lowered"), ("restricted", None), ("confidential", " ")]
_LEVELS = [("public", 0), ("internal", 1), ("confidential", 2), ("restricted", 3)]


@registry.query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(substr(text, 1, 20000)), '\bpassword\b|\bapi[_ ]key\b') THEN 'restricted' WHEN regexp_matches(lower(substr(text, 1, 20000)), 'all rights reserved|\blicen[sc]ed? under\b') THEN 'confidential' ELSE 'internal' END AS level FROM documents""")
def rule_levels(s, d):
    """Levels by a table of rules in place of the built-in ones."""
    given, levels = s.createDataFrame(_RULES, "level string, pattern string"), s.createDataFrame(_LEVELS, "level string, rank int")
    return rules.classify(documents(s, d), given, levels, "internal", None).select("doc_id", "level")
