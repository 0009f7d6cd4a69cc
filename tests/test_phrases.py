"""Phrases found by joins against a scan by regular expressions, and mentions with their names."""

import random
import re

import pytest

from gneiss.operators import ontology, phrases


def scan(text, forms, how):
    """Strict and other forms by one pattern each, longest first; then the longest of overlapping mentions, then the earliest."""
    if how is phrases.LOOSE:
        sep, pre, post = r"[-_\s/]", r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
        say = lambda f: f"{sep}*".join(re.escape(p) for p in re.split(f"{sep}+", f) if p)
    else:
        pre, post, say = r"(?<![\w-])", r"(?![\w-])", re.escape
    raw = []
    for strict in (True, False):
        own = sorted((f for f, s in forms if s is strict and say(f)), key=len, reverse=True)
        if own:
            raw += [(m.start(), m.end(), m.group(0), strict) for m in re.finditer(f"{pre}(?:{'|'.join(map(say, own))}){post}", text or "", 0 if strict else re.I)]
    kept = []
    for x in sorted(raw, key=lambda x: (x[0] - x[1], x[0])):
        if all(x[1] <= y[0] or x[0] >= y[1] for y in kept):
            kept.append(x)
    return sorted(kept)


@pytest.mark.parametrize("how", [phrases.LOOSE, phrases.LITERAL], ids=["loose", "literal"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_scan(spark, monkeypatch, how, seed):
    monkeypatch.setattr(phrases, "SENT", 10 if seed == 1 else 10_000)  # first words are exchanged, or sent
    r = random.Random(seed)
    words = ["ab", "c", "de", "AB", "x1", "é", "C++", "n.js", "2.0", "(q)"]
    glue = [" ", "-", "_", "/", "", "  ", " ", "\n", ", ", "."]
    forms = list({("".join(r.choice(words) + r.choice([" ", "-", " ", "/"]) for _ in range(r.randint(1, 4))).strip(" -/"), r.random() < 0.3) for _ in range(25)})
    forms = [(f, s) for k, (f, s) in enumerate(forms) if f.strip() and f not in {g for g, _ in forms[:k]}]
    texts = ["".join(r.choice(words).swapcase() * (r.random() < 0.2) or r.choice(words) + r.choice(glue) for _ in range(r.randint(0, 60))) for _ in range(120)] + [None, "", " - ", "ab " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame([(f, s, i) for i, (f, s) in enumerate(forms)] + [(None, False, 0), (" - ", False, 0)][: 1 if how is phrases.LITERAL else 2], "form string, strict boolean, place int")
    got = sorted((x.doc_id, x.start, x.end, x.surface, x.strict) for x in phrases.find(docs, given, how).collect())
    assert got == sorted((i, *m) for i, t in enumerate(texts) for m in scan(t, forms, how))


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    forms = spark.createDataFrame([("some", False, 0)], "form string, strict boolean, place int")
    assert phrases.find(docs, forms.limit(0)).count() == 0 and phrases.find(docs.limit(0), forms).count() == 0


def test_mentions_have_names(spark):
    """Separators, acronyms, prefixes, the longest match, ambiguous forms and aliases."""
    g = ontology.Gazetteer({"Tool": {"Blue Lantern": ["BLT", "lantern-kit"], "Lantern": []}, "Base": {"Data Store": []}}, {"Lantern": ["Blue Lantern"], "Vault": ["a", "b"]}, {"hub"})
    texts = ["the blue_lantern and BLT, not blt", "Lantern kit / LanternKit", "datastore; data-store", "a vault", "bluelanterns hub"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(x) for x in ontology.gazetteer_mentions(docs, g).collect())
    m = ontology.Matcher(g)
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in m.find(t))
    assert {x[4] for x in got} == {"Blue Lantern", "Data Store", "Vault"}


def test_term_report(spark):
    chunks = spark.createDataFrame([(1, 0, "red apple and pear"), (1, 1, "Red Apple, red apple"), (2, 0, "pear-tree"), (2, 1, None), (3, 0, "NASA apple")], "doc_id long, chunk_id int, text string")
    terms = spark.createDataFrame([("red apple", False), ("pear", False), ("NASA", True), ("nowhere here", False)], "term string, strict boolean")
    got = {(x.part, x.term): (x.documents, x.chunks) for x in phrases.term_report(chunks, terms).collect()}
    assert got == {("term", "red apple"): (1, 2), ("term", "pear"): (1, 1), ("term", "NASA"): (1, 1), ("term", "nowhere here"): (0, 0), ("one", ""): (2, 3), ("two", ""): (1, 1), ("all", ""): (3, 5)}


def test_no_text_is_exchanged_for_a_small_vocabulary(spark):
    """Only what ends where a term may end goes on, in generated code; terms go to the tasks."""
    forms = spark.createDataFrame([("green tea", False, 0), ("green tea leaves", False, 0), ("tea", True, 0)], "form string, strict boolean, place int")
    for how in (phrases.LITERAL, phrases.LOOSE):
        docs = spark.createDataFrame([(1, "Green tea leaves, GREEN TEA, teas, tea" + " x" * 200)], "doc_id long, text string").repartition(2)
        found = phrases.candidates(docs, phrases.terms_of(forms, how), how)
        assert sorted((r.start, r.end, r.form) for r in found.collect()) == [(0, 9, "green tea"), (0, 16, "green tea leaves"), (6, 9, "tea"), (18, 27, "green tea"), (35, 38, "tea")]
        plan = found.drop("start")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=broadcast") == 2 and "explode(lens" not in plan
