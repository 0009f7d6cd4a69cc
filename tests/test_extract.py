"""Every kind of file ends with a text or a reason."""

import io
import zipfile

from gneiss.sources import extract

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
XML = f"""<w:document {NS}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Plan</w:t></w:r></w:p><w:p><w:r><w:t>First</w:t><w:tab/><w:t>part</w:t></w:r></w:p><w:p/>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><wp:inline/></w:r></w:p></w:body></w:document>"""


def docx(xml=XML, name="word/document.xml"):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(name, xml)
    return b.getvalue()


def test_docx():
    parts = extract.docx_text(docx()).split("\n\n")
    assert parts[:2] == ["## Plan", "First\tpart"] and parts[2].startswith("<!-- table:0 -->\n") and "1" in parts[2] and parts[3] == "<!-- image:pending:0:inline_shape -->"


def test_all_kinds(spark):
    page = "<html><body><article><h1>T</h1><p>" + "Some prose of an article. " * 30 + "</p></article></body></html>"
    files = {
        "/a/n.md": b"# Title\n\ntext \xff", "/a/w.docx": docx(), "/a/bad.docx": b"PK", "/a/other.docx": docx(name="x"), "/a/t.csv": b"a,b", "/a/p.pdf": b"%PDF", "/a/x.unknown": b"x", "/a/empty.md": b"", "/a/null.md": None,
        "/c/m.py": b"import os\n\ndef f():\n    return 1\n", "/c/page.html": page.encode(), "/d/page.html": page.encode(), "/d/t/page.htm": b"<div>{{ name }}</div>", "/d/nul.html": b"\0abc", "/e/node_modules/z.js": b"function f() {}\n\n\n", "/e/min.css": b"x" * 6000,
        "/f/app.html": ("<p>hello there</p><script>" + "x();" * 300 + "</script>").encode(), "/g/src/page.html": page.encode(), "/h/tags.html": b"<b><i><u><b><i><u>a</u></i></b></u></i></b>" * 5,
    }
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None, 1) for k, v in files.items()], "path string, content binary, reader int")
    got = {r["path"]: r for r in extract.extract(rows).collect()}
    assert set(got) == set(files)
    say = {k: (r["reader"], r["status"], r["reason"]) for k, r in got.items()}
    assert say["/a/n.md"] == ("markdown", "ok", "") and got["/a/n.md"]["text"].endswith("�")
    assert say["/a/w.docx"] == ("docx", "ok", "") and say["/a/bad.docx"][2] == say["/a/other.docx"][2] == "docx_unreadable"
    assert say["/a/t.csv"][1:] == ("quarantined", "deferred_tabular") and say["/a/p.pdf"][2] == "extractor_unavailable:pdf" and say["/a/x.unknown"][2] == "unsupported_media_type"
    assert say["/a/empty.md"][2] == say["/a/null.md"][2] == "empty_extraction"
    assert say["/c/m.py"] == ("native_code", "ok", "") and "symbols: f" in got["/c/m.py"]["text"]
    assert say["/c/page.html"][0] == "html_source" and say["/d/page.html"] == ("html", "ok", "") and "<p>" not in got["/d/page.html"]["text"]
    assert [say[k][0] for k in ("/d/t/page.htm", "/f/app.html", "/g/src/page.html", "/h/tags.html")] == ["html_source"] * 4
    assert say["/d/nul.html"][2] == "binary_content" and say["/e/node_modules/z.js"][2] == "vendored_path" and say["/e/min.css"][1:] == ("ok", "")
