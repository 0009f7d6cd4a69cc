"""Golden rows of operators that SQL can't express."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import chunking, dedup, graphs, ontology, web
from gneiss.plans import catalog
from gneiss.sources import files
from gneiss.streaming import jobs


def test_prose_chunks_keep_sections_and_tables():
    text = "# One\nFirst words of the section that are long enough to stand alone, as they have to be here.\n<!-- table:1 -->\n| a | b |\n\n## Two\nMore words."
    got = chunking.prose_chunks("d", text)
    assert [r[6] for r in got] == ["One", "One"]
    assert got[0][3].startswith("# One") and "| a | b |" in got[1][3] and "## Two" in got[1][3]
    assert got[1][4] == got[0][5]


def test_long_blocks_are_packed_by_sentences():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(120))
    got = chunking.prose_chunks("d", text, chunking.Prose(overlap=0))
    assert len(got) > 2 and " ".join(r[3] for r in got) == text and all(len(r[3]) <= 1260 for r in got)


def test_code_chunks_have_real_offsets():
    source = "import os\n\n" + "\n".join(f"def f{i}():\n    return {i}" + "  # pad" * 40 + "\n" for i in range(12))
    got = chunking.code_chunks("d", f"```python\n{source}\n```")
    assert len(got) > 1 and got[1][3].startswith("import os\n\n")
    assert all(source[r[4] :].startswith(r[3].removeprefix("import os\n\n").split("\n")[0]) for r in got[1:])


def test_names():
    assert graphs.compatible(["r", "singh"], ["rachpal", "kumar", "singh"]) == 0.35
    assert graphs.compatible(["singh"], ["rachpal", "singh"]) == 0.35
    assert graphs.compatible(["r", "singh"], ["s", "singh"]) is None
    assert graphs.compatible(["a", "b"], ["a", "c"]) is None


def test_resolution_and_components(spark):
    rows = [(1, 1, "x/a", "P", "ann lee", ["bob"], []), (2, 2, "x/b", "P", "a lee", ["bob"], []), (3, 3, "y/c", "P", "a lee", [], []), (4, 4, "z/d", "P", "ann poe", [], [])]
    ms = spark.createDataFrame(rows, "mention_id long, doc_id long, uri string, label string, name string, near array<string>, keywords array<string>")
    got = {r["node"]: r["label"] for r in graphs.components(graphs.resolution_links(ms)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def plain_links(rows, threshold):
    """All pairs of mentions, in plain Python."""
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) & set(b) else 0.0
    one = {}
    for m, doc, uri, label, name, near, keywords in rows:
        o = one.setdefault((label, name, doc), [[], uri, [], []])
        o[0].append(m)
        o[1] = min(o[1], uri)
        o[2] += near
        o[3] += keywords
    held = [(label, name, doc, *o) for (label, name, doc), o in one.items()]
    out = []
    for i, a in enumerate(held):
        out += [(x, a[3][0]) for x in a[3]]
        for b in held[:i]:
            base = graphs.compatible(a[1].split(" "), b[1].split(" ")) if a[0] == b[0] else None
            place = 0.4 if a[2] == b[2] else 0.3 if a[4].rpartition("/")[0] == b[4].rpartition("/")[0] else 0.0
            if base == 1.0 or base is not None and base + min(1.0, place + 0.3 * share(a[5], b[5]) + 0.15 * share(a[6], b[6])) >= threshold:
                out.append((a[3][0], b[3][0]))
    return out


@pytest.mark.parametrize("threshold", [0.62, 0.72, 0.9])
def test_resolution_is_that_of_all_pairs(spark, threshold):
    import random

    r = random.Random(7)
    names = ["lee", "ann lee", "a lee", "bob ann lee", "b lee", "poe", "x poe", "xi poe", "xi yu poe", "kay", "kim kay", "k kay", "kim lou kay", "t orr", "tom orr", "una vo"]
    near = [[], ["a"], ["a", "b"], ["a", "b", "c"], [f"n{i}" for i in range(9)], [f"n{i}" for i in range(10)], [f"n{i}" for i in range(1, 11)], ["b", "c", "d"]]
    rows = []
    for part in range(6):
        rows += [(100 * part + i, 50 * part + r.randrange(30), f"{part}f{r.randrange(12)}/d{i}", f"P{part}", r.choice(names), r.choice(near), r.choice([[], r.choice(near)])) for i in range(30)]
    rows += [(29, 999, "f90/x", "P0", "una vo", [], [])]  # a mention of two names
    ms = spark.createDataFrame(rows, "mention_id long, doc_id long, uri string, label string, name string, near array<string>, keywords array<string>")
    label = {}
    for a, b in plain_links(rows, threshold):
        if a != b:
            old = {label.setdefault(a, a), label.setdefault(b, b)}
            label = {k: min(old) if v in old else v for k, v in label.items()}
    assert {x.node: x.label for x in graphs.resolved(ms, threshold).collect()} == label
    if threshold == graphs.THRESHOLD:
        assert {x.node: x.label for x in graphs.components(graphs.resolution_links(ms)).collect()} == label


def test_names_beyond_the_tenth_count(spark, tmp_path):
    """Documents of 30 names; the short form of a name stands last, so only whole documents link it."""
    plain = " ".join(f"{a}{b}." for a in ("Ba", "Ce", "Di", "Fo", "Gu") for b in ("lan", "mer", "nos", "pid", "quat", "rus"))
    rows = [(1, f"{plain} Una Vor Lee.", "en", "s"), (2, f"{plain} Una Lee.", "en", "t"), (3, "Una Lee.", "en", None), (4, None, "en", "s"), (5, f"{plain} Vox Lee.", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.mentions for r in catalog.queries()["entity_resolution"](spark, str(tmp_path)).collect())
    assert got == [3] * 31  # each plain name three times; one of three mentions; another alone has no row


@pytest.mark.parametrize("least", [0.6, 0.9, 1.0])
def test_similar_contexts_share_a_key(spark, least):
    import random

    r = random.Random(5)
    rows = []
    for i in range(400):
        n = r.choice([1, 2, 9, 10, 11, 19, 20, 21, 22, 40, 90, 700])
        a = r.sample(range(10_000), n)
        off = r.randrange(int(n * (1 - least)) + 1) if least < 1 else 0
        b = a[off:] if r.random() < 0.5 else a + r.sample(range(10_000, 20_000), int(n / least + 1e-9) - n)
        rows.append((i, a, b))
    h = lambda c: F.array_sort(F.transform(c, lambda x: F.xxhash64(x)))
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>").repartition(4)
    got = df.select("i", graphs._shared_keys(h("a"), least, True).alias("x"), graphs._shared_keys(h("b"), least, False).alias("y")).collect()
    assert len(got) == 400
    for g in got:
        a, b = set(rows[g.i][1]), set(rows[g.i][2])
        assert len(a & b) / len(a | b) < least - 1e-9 or set(g.x) & set(g.y)
        assert len(g.x) <= 22 + 10 * len(a)


def test_resolution_does_not_pair_documents(spark):
    """Two names in 400 documents each are one link, not 160,000."""
    rows = [(2 * i + k, 2 * i + k, "d/x", "P", name, ["c"], []) for i in range(400) for k, name in enumerate(("ann lee", "a lee"))]
    ms = spark.createDataFrame(rows, "mention_id long, doc_id long, uri string, label string, name string, near array<string>, keywords array<string>")
    assert graphs.resolution_links(ms).count() == 799
    assert {(x.label, x.n) for x in graphs.resolved(ms).groupBy("label").agg(F.count("*").alias("n")).collect()} == {(0, 800)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in graphs.components(links).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_complete_linkage_does_not_chain(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long")
    got = {(r["cluster"], r["doc_id"]) for r in dedup.linkage(links, graphs.components(links)).collect()}
    assert got == {(1, 1), (1, 2), (1, 3)}


def test_gazetteer():
    m = ontology.Matcher(ontology.Gazetteer({"Tool": {"Deep Graph": ["deepgraph"], "REST": [], "Graph": []}}, {"Vault": ["A Vault", "B Vault"]}))
    found = lambda t: [(x[3], x[4]) for x in m.find(t)]
    assert found("the deep-graph and a Graph") == [("Deep Graph", "Tool"), ("Graph", "Tool")]
    assert found("take a rest with REST") == [("REST", "Tool")]
    assert found("open the vault") == [("Vault", "ambiguous")]
    assert found("graphs") == []


def test_type_gate(spark):
    rows = [("USES", "Service", "Tool"), ("USES", "Tool", "Service"), ("ALTERNATIVE_TO", "Tool", "Service"), ("OTHER", "X", "Y"), ("FORBIDDEN", "X", "Y"), ("NEW", "X", "Y"), ("MITIGATES", "Risk", "Control")]
    got = ontology.type_gate(spark.createDataFrame(rows, "predicate string, subject_class string, object_class string"), ontology.constraints(spark)).collect()
    by = {(r["predicate"], r["subject_class"]): (r["ok"], r["inversion_valid"], r["component"]) for r in got}
    assert by[("USES", "Service")] == (True, False, 1.0) and by[("USES", "Tool")] == (False, True, 0.15)
    assert by[("ALTERNATIVE_TO", "Tool")][0] is False and by[("OTHER", "X")][0] and by[("FORBIDDEN", "X")] == (False, False, 0.0)
    assert by[("NEW", "X")][0] is False and by[("MITIGATES", "Risk")] == (False, True, 0.15)


def test_validate_relations(spark):
    text = "The billing service uses the queue tool every day."
    good = {"subject": 0, "object": 1, "predicate": "USES", "evidence": "billing service  uses the QUEUE", "confidence": 0.9}
    raws = ["", "no json", "```json\n" + json.dumps({"relations": [good]}) + "\n```", json.dumps({"relations": [good | {"object": 7}, good | {"object": 0}, good | {"evidence": "paraphrased words"}, good | {"subject": "0"}, good | {"predicate": "LIKES"}, good | {"subject": 1, "object": 0, "predicate": "OWNED_BY"}]})]
    df = spark.createDataFrame([(str(i), text, r, [("billing", "Service"), ("queue", "Tool")]) for i, r in enumerate(raws)], "chunk_id string, text string, raw string, entities array<struct<name:string,class:string>>")
    got = ontology.validate_relations(df, ontology.constraints(spark)).collect()
    assert sorted(r["rejected"] for r in got if r["rejected"]) == ["bad_index_type", "empty_response", "evidence_not_found", "index_out_of_range", "self_relation", "unparseable_json"]
    assert {r["predicate"]: r["status"] for r in got if not r["rejected"]} == {"USES": "valid", "OTHER": "proposed", "OWNED_BY": "quarantined"}
    assert [r["confidence"] for r in got if r["predicate"] == "USES"] == [0.98]


def test_namespaces_do_not_mix(spark):
    e = spark.createDataFrame([("a", "n1", "A"), ("b", "n1", "B"), ("c", "n2", "C")], "id string, namespace string, label string")
    c = spark.createDataFrame([("n1", "a", "b", "valid"), ("n1", "a", "c", "valid"), ("n2", "c", "c", "valid"), ("n1", "b", "a", "quarantined")], "namespace string, subject string, object string, status string")
    assert [(r["subject_label"], r["object_label"]) for r in ontology.neighbours(c, e, "n1").collect()] == [("A", "B")]


def test_page(spark):
    html = """<html><head><meta property="og:title" content="Big news"><meta name="author" content="Ann"><script>var x = "</p>";</script></head><body><nav><a href="/x">menu</a></nav>
    <article><h1>Other</h1><p>""" + "Words of the story go on and on here. " * 20 + """</p><div class="ad-box">Buy things</div><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>x</td><td>x</td></tr></table></article></body></html>"""
    df = spark.createDataFrame([(1, "http://a.b/c", html), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in web.extract(df).collect()}
    assert got[1]["title"] == "Big news" and got[1]["author"] == "Ann" and got[1]["page_type"] in ("data", "article")
    assert "Words of the story" in got[1]["text"] and "Buy things" not in got[1]["text"] and "menu" not in got[1]["text"]
    assert got[2]["words"] == 0
    assert [r["cells"] for r in web.table_rows(df).orderBy("row_no").collect()] == [["A", "B"], ["1", "2"]]


def test_feeds(spark):
    xml = ["<urlset><url><loc>http://a/1</loc><lastmod>2024-01-02</lastmod></url><url><loc>http://a/2</loc></url></urlset>", "<rss><item><title><![CDATA[T]]></title><link>http://b</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item></rss>", '<feed><entry><title>E</title><link href="http://c"/><updated>2024-01-02T03:04:05Z</updated></entry></feed>']
    got = {r["url"]: (r["title"], str(r["published"])) for r in web.feed_entries(spark.createDataFrame([(str(i), x) for i, x in enumerate(xml)], "feed string, xml string")).collect()}
    assert got == {"http://a/1": (None, "2024-01-02 00:00:00"), "http://a/2": (None, "None"), "http://b": ("T", "2024-01-02 10:00:00"), "http://c": ("E", "2024-01-02 03:04:05")}


def test_files(spark, tmp_path):
    (tmp_path / "f2").mkdir()
    (tmp_path / "f20").mkdir()
    for p in ("f2/a.md", "f20/b.py", "c.xlsx", "d.bin", "e.md"):
        (tmp_path / p).write_text("x" if p != "e.md" else "")
    found = files.select_files(files.discover(spark, str(tmp_path)), [f"{tmp_path}/f2".lstrip("/"), "*.bin"])
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in found.collect()}
    assert got == {"b.py": None, "c.xlsx": "deferred_tabular"}  # Spark lists no empty files


def test_archives(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.md", "hello")
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("../up.md", "bad")
        z.writestr("bomb.txt", "0" * 500_000)
    got = {u: (c, r) for u, c, r in files.expand(outer.getvalue(), "o.zip")}
    assert got == {"o.zip!/in.zip!/deep.md": (b"hello", None), "o.zip!/../up.md": (None, "path_traversal"), "o.zip!/bomb.txt": (None, "compression_ratio")}
    assert files.expand(b"no", "x.zip") == [("x.zip", None, "bad_archive")]


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    far = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("user_id", F.lit(-1).cast("long"))  # moves the watermark past all others
    events.coalesce(1).write.parquet(src)
    far.coalesce(1).write.mode("append").parquet(src)
    for name, f in (("hours", jobs.windowed), ("leases", lambda e: jobs.leases(e, "3600 seconds"))):
        out = jobs.run_to_end(f(jobs.event_stream(spark, src)), name, str(tmp_path / name))
        want = f(events)
        cols = want.columns
        assert sorted(map(str, out.select(*cols).collect())) == sorted(map(str, want.collect()))


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(X.family_key(F.lit("AI_Costs - intro v2 final (1).docx"))) == "ai costs - intro"
    assert one(X.classify(F.lit("a press release"))) == "internal"
    assert one(X.classify(F.lit("this is Strictly Confidential"))) == "restricted"
    assert one(X.classify(F.lit("mail bob@x.org"))) == "confidential"
    assert one(X.cut_prose(F.lit("a. " * 10), 10)) == "a. a. a"
    assert one(X.autotitle(F.lit("  "))) == "New chat"
    assert one(X.score_text(F.lit(None).cast("string"))) == 0.0


def test_type_gate_exchanges_no_relations(spark):
    rows = spark.range(100).select(F.lit("USES").alias("predicate"), F.lit("Service").alias("subject_class"), F.lit("Tool").alias("object_class"))
    gated = ontology.type_gate(rows, ontology.constraints(spark))
    assert gated.where("ok").count() == 100
    assert "hashpartitioning(predicate" not in gated._jdf.queryExecution().executedPlan().toString()


def test_type_gate_query_sorts_no_relations(spark):
    from gneiss.plans import catalog

    plan = catalog.queries()["type_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
