"""Stemmed retrieval, packing, revisions, relations, control and merges, each against a second source or cases of our own."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from gneiss.functions import code, stem
from gneiss.operators import context, control, ontology, relations, retrieval
from gneiss.sources import sinks

TEXTS = [
    "Relational databases were relating related relations.", "Ponies caress the happy pony; the cats were hopping and hoping.", "École élèves: les étudiants étudient.",
    "Generalizations oscillate, oscillators generalise.", "The quick probate rate, rolling and controlled.", "Cats and dogs; dogs chasing cats, a dog chased.", "", "Running runner runs.",
] + [f"filler text number {i} with nothing to find" for i in range(12)]


def test_stemmed_bm25_like_a_full_text_index(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string")
    asked = ["dog chases cat", "relation of databases", "ecole etudiant", "generalization oscillating runs"]
    got = retrieval.bm25(docs, spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), stems=stem.stems).collect()
    for i, q in enumerate(asked):
        match = " OR ".join(f'"{w}"' for w in q.split() if len(w) > 2)
        want = {r: -s for r, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        assert {r["doc_id"]: r["score"] for r in got if r["query_id"] == i} == pytest.approx(want)


def test_stems_of_empty_and_null(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "ponies ponies")], "i int, t string").select("i", stem.tokens(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [[], [], ["x"], ["poni", "poni"]]


def test_packing_skips_and_goes_on(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.randrange(100), rng.randrange(60)) for s in ("a", "b") for i in range(50)] + [("c", 1, 1, 1000), ("c", 2, 2, 90), ("c", 3, 3, 20), ("c", 4, 4, 10)]
    got = {(r["scope"], r["doc_id"]): r["captured"] for r in context.pack_files(spark.createDataFrame(rows, "scope string, doc_id long, bytes long, chars long"), 100).collect()}
    used = {}
    for scope, doc, _, n in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        fits = used.get(scope, 0) + n <= 100
        used[scope] = used.get(scope, 0) + n * fits
        assert got[scope, doc] == fits
    assert [got["c", i] for i in (1, 2, 3, 4)] == [False, True, False, True]


def test_resolve_file(spark):
    files = spark.createDataFrame([("s", 1, "Plan.md", 1), ("s", 2, "plan.md", 5), ("s", 3, "plan (edit 1).md", 9), ("t", 4, "only.py", 1)], "scope string, doc_id long, file_name string, created long")
    wanted = spark.createDataFrame([(1, "s", "PLAN.md "), (2, "s", "plan"), (3, "s", "none"), (4, "t", "anything"), (5, "t", None), (6, "u", "x")], "request long, scope string, name string")
    assert {(r["request"], r["doc_id"], r["how"]) for r in context.resolve_file(wanted, files).collect()} == {(1, 2, "exact"), (2, 3, "partial"), (4, 4, "only"), (5, 4, "only")}
    row = files.select(context.next_revision(F.lit("a (edit 3).py"), F.lit(3)).alias("a"), context.next_revision(F.lit("b"), F.lit(0)).alias("b")).first()
    assert (row["a"], row["b"]) == ("a (edit 4).py", "b (edit 1)")


def test_prompt_note_and_captured_files(spark):
    hits = spark.createDataFrame([(1, 1, "a", "2024-01-02T", "c1", 0.5, " x "), (1, 2, "b", None, "c2", 0.4, "y"), (2, 1, "a", None, "c1", 0.1, None)], "query_id long, rank long, file_name string, modified string, chunk string, score double, text string")
    got = context.prompt_blocks(hits).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in got] == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert "modified: 2024-01-02\n" in got[0]["block"] and "modified" not in got[1]["block"] and got[2]["block"].startswith("[NOTE]")
    left = context.without_captured(hits.withColumn("scope", F.lit("s")), spark.createDataFrame([("s", "A")], "scope string, file_name string"))
    assert [r["file_name"] for r in left.collect()] == ["b"]


WORDS = ontology.Gazetteer({"Platform": {"Kubernetes": [], "Nomad": []}, "Service": {"Istio": [], "Envoy": []}, "Vendor": {"Acme": []}})
RULES = {"runsOn": (["Service"], ["Platform"], []), "supersedes": (["Service"], ["Service"], ["same_class"]), "alternativeTo": (["Platform", "Service"], ["Platform", "Service"], ["same_class", "symmetric"])}
CASES = [
    ("Istio runs on Kubernetes.", "asserted", ""),
    ("Istio does not run on Kubernetes.", "escalate", "negated"),
    ("Istio runs on Kubernetes only when it is hardened.", "escalate", "qualified"),
    ("Kubernetes runs on Istio.", "escalate", "type_violation"),
    ("Istio. Runs on Kubernetes.", None, None),
    ("Istio, Kubernetes", None, None),
    ("Istio replaces Envoy.", "asserted", ""),
    ("Nomad versus Kubernetes", "asserted", ""),
    ("Istio runs, in a long and winding way that fills the gap with many words, on Kubernetes", None, None),
    (None, None, None),
]


def test_relations_and_funnel(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    rules = ontology.constraints(spark, RULES)
    scanned = relations.scan(docs, WORDS)
    got = {r["doc_id"]: (r["decision"], r["why"]) for r in relations.judged(scanned, rules).collect()}
    assert got == {i: (d, w) for i, (_, d, w) in enumerate(CASES) if d}
    tiers = {r["tier"]: r["chunks"] for r in relations.funnel(scanned, rules).collect()}
    assert tiers["triggered"] == 9 and tiers["no_verb"] == 2 and tiers["asserted"] == 3 and tiers["to_model"] == 4
    assert docs.where(relations.has_trigger(F.col("text"))).count() == 7


def test_review_stops(spark):
    rows = [("a", 1, 50), ("b", 1, 10), ("b", 2, 20), ("b", 3, 30), ("c", 1, 10), ("c", 2, 12)]
    got = control.review(spark.createDataFrame(rows, "run string, n int, score int"), "run", "n", "score").orderBy("run", "n").collect()
    assert [r["route"] for r in got] == ["passed", "supervisor", "supervisor", "review_limit", "supervisor", "plateau"]


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_field_reader_at_any_cut(size):
    said = 'a "quoted" \\ line\nβ\ttab é / \x08 end'
    for raw in (json.dumps({"other": "final", "final": said, "x": "z"}), json.dumps({"final": said}, ensure_ascii=False)):
        reader = control.FieldReader("final")
        assert "".join(reader.feed(raw[i : i + size]) for i in range(0, len(raw), size)) == said
        assert reader.phase == 2 and reader.feed("more") == ""


def test_code_functions(spark):
    src = {"ok": "import os\nclass A:\n    def f(self):\n        pass\nasync def g(): pass\ndef f(): pass\n", "min": "x" * 6000, "blank": " \n ", "nul": "a\x00b", "empty": "", "remarks": "# a\n# b\n# c\n# d", "null": None}
    q = code.code_quality(F.col("t"), "python")
    got = {r["k"]: (r["s"], list(r["w"]), list(r["n"])) for r in spark.createDataFrame(list(src.items()), "k string, t string").select("k", q["score"].alias("s"), q["warnings"].alias("w"), code.symbols(F.col("t"), "python").alias("n")).collect()}
    assert got["ok"] == (1.0, [], ["f", "g", "A"])
    assert got["min"] == (0.2, ["likely_minified_or_generated", "trivial_file"], [])
    assert [got[k][:2] for k in ("blank", "nul", "empty", "null")] == [(0.0, ["whitespace_only"]), (0.0, ["binary_content_in_text_file"]), (0.0, ["empty_extraction"]), (0.0, ["empty_extraction"])]
    assert got["remarks"][:2] == (1.0, ["comment_only_file"])
    names = spark.createDataFrame([("a/b/Ünï çödé?.txt",), (None,), ("x/node_modules/y.js",), ("a.min.js",)], "p string").select(code.safe_name(F.col("p")).alias("n"), code.vendored(F.col("p")).alias("v")).collect()
    assert [r["n"] for r in names][1] == "upload" and names[0]["n"].isascii() and names[0]["n"].endswith(".txt")
    assert [r["v"] for r in names] == [False, None, True, True]


def test_merge_cascade_replace(spark):
    base = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "b", 2.0, "y")], "k int, n string, v double, z string")
    new = spark.createDataFrame([(2, "B", None), (3, "C", 3.0)], "k int, n string, v double")
    assert sorted(map(tuple, sinks.merge(base, new, ["k"], ["v"]).collect())) == [(1, "a", 1.0, "x"), (2, "B", 2.0, "y"), (3, "C", 3.0, None)]
    docs, chunks = spark.createDataFrame([(1, 10), (2, 20)], "d int, s int"), spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "c int, d int")
    left = sinks.cascade(spark.createDataFrame([(10,)], "s int"), [(docs, "d", "s"), (chunks, "c", "d")])
    assert [sorted(map(tuple, x.collect())) for x in left] == [[(2, 20)], [(2, 2), (3, 2)]]
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id int, t string")
    assert sorted(map(tuple, sinks.replace_documents(old, spark.createDataFrame([(1, "z")], old.schema)).collect())) == [(1, "z"), (2, "c")]


def test_checkpoint_resumes_and_report(spark, tmp_path):
    work = spark.createDataFrame([(i, "a\tb\nc") for i in range(6)], "id long, t string")
    sinks.write_checkpoint(work.where("id < 2"), str(tmp_path / "done"))
    sinks.write_checkpoint(work.where("id = 4"), str(tmp_path / "done"))
    assert sorted(r["id"] for r in sinks.remaining(work, spark.read.json(str(tmp_path / "done")), "id").collect()) == [2, 3, 5]
    sinks.write_report(work, str(tmp_path / "report"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "report")).where("t = 'a b c'").count() == 6


def test_alternates_and_compose(spark):
    rows = spark.createDataFrame([("https://www.a.org/x/?q=1", ""), ("https://m.a.org/x", ""), ("https://a.org", "https://a.org/amp")], "u string, amp string")
    got = [list(r["a"]) for r in rows.select(context.alternates(F.col("u"), F.col("amp")).alias("a")).collect()]
    assert got[0] == ["https://www.a.org/x/amp", "https://www.a.org/x?amp=1", "https://m.a.org/x"]
    assert got[1] == ["https://m.a.org/x/amp", "https://m.a.org/x?amp=1"] and got[2][0] == "https://a.org/amp"
    table = "\n".join("| cell | cell |" for _ in range(1000))
    n = spark.range(1).select(F.length(context.compose(F.lit("word " * 3000), F.lit(table))).alias("n"), F.length(context.compose(F.lit("short"), F.lit(None).cast("string"))).alias("m")).first()
    assert n["n"] <= 8002 and n["m"] == 5


def test_uploads_and_spans(spark):
    rows = spark.createDataFrame([(5, 10, 1), (0, 10, 1), (11, 10, 1), (5, None, 1), (5, 10, 11)], "size int, cap int, n int")
    assert [r["x"] for r in rows.select(control.upload_reason(F.lit(""), F.col("size"), F.col("cap"), F.col("n")).alias("x")).collect()] == ["", "empty_file", "file_too_large", "unsupported_media_type", "too_many_files"]
    spans = [{"attributes.metadata": '{"conversation_id": "m"}', "attributes.tag.tags": '["conversation:t"]'}, {"attributes.tag.tags": '["x", "conversation:t"]'}, {"attributes.metadata": "broken"}, {}]
    got = spark.createDataFrame([(m,) for m in spans], "a map<string,string>").select(control.conversation_of(F.col("a")).alias("c")).collect()
    assert [r["c"] for r in got] == ["m", "t", None, None]


def test_bm25_in_parts_of_documents(spark, monkeypatch):
    """A term of all documents is no group of its own, parts grow with documents and questions, and repeated ids are one document."""
    import math
    import re
    from collections import Counter

    from gneiss.operators import retrieval

    monkeypatch.setattr(retrieval, "PAIRS", 10)
    texts = {i: "common " * (i % 3 + 1) + f"word{i % 7} odd{i}" for i in range(40)}
    asked = {0: "common word3", 1: "odd11 word4", 2: "nothing there", 3: "Common", 4: "word1 word2"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = retrieval.bm25(rows, spark.createDataFrame(list(asked.items()), "query_id long, text string"), k=5)
    count = {d: Counter(x.split()) for d, x in texts.items()}
    size = {d: sum(c.values()) for d, c in count.items()}
    mean = sum(size.values()) / len(size)
    for q, x in asked.items():
        score = Counter()
        for w in x.lower().split():
            df = sum(w in c for c in count.values())
            idf = max(math.log((40 - df + 0.5) / (df + 0.5)), 0) or 1e-6
            for d, c in count.items():
                if c[w]:
                    score[d] += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean))
        want = sorted(score, key=lambda d: (-round(score[d], 9), d))[:5]
        assert [r.doc_id for r in found.where(f"query_id = {q}").orderBy("rank").collect()] == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 4 and re.search(r"RepartitionByExpression \[doc_id#\d+L?\], 20", plan)
