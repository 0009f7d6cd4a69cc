"""Bodies in the state that pages start from."""

import json

import pytest

from gneiss.operators import web

BODY = "<p>" + "A sentence of the story. " * 30 + "</p>"


@pytest.mark.parametrize("wrap", ['<script id="__NEXT_DATA__" type="application/json">{}</script>', "<script>window.__INITIAL_STATE__ = {};var x = 1</script>", "<script>window.__NUXT__={}</script>"])
def test_state_is_found(wrap):
    state = {"props": {"list": [{"short": "x" * 50, "story-content": BODY}, {"storyContent": BODY[:500]}], "brace": "} not the end {"}}
    assert web.embedded_state(wrap.replace("{}", json.dumps(state))) == BODY


def test_state_limits():
    deep = {"body": BODY}
    for _ in range(9):
        deep = {"a": deep}
    page = lambda x: "window.__data = " + (x if isinstance(x, str) else json.dumps(x))
    assert web.embedded_state(page(deep)) is None
    assert web.embedded_state(page({"body": "x" * 400})) is None and web.embedded_state(page({"body": "x" * 401})) == "x" * 401
    assert web.embedded_state(page({"zzz": "No key. " * 300})) is not None and web.embedded_state(page({"zzz": "x" * 3000})) is None
    assert web.embedded_state(page("{broken")) is None and web.embedded_state(None) is None and web.embedded_state("") is None


def test_extract_uses_state(spark):
    html = '<html><body><div id="app"></div><script>window.__data = ' + json.dumps({"body": BODY}) + "</script></body></html>"
    row = web.extract(spark.createDataFrame([(1, "https://a.org", html), (2, None, None)], "page_id long, url string, html string")).where("page_id = 1").first()
    assert row["strategy"] == "embedded_state" and row["words"] == 150 and "<p>" not in row["text"]
