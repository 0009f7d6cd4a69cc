"""Fetched pages: main text, titles, links, tables, page types, headlines, metadata, feeds."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as X

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISE = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "iframe", "svg", "template"}
BREAKS = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ul", "ol", "table"}
_AD = re.compile(r"(^|[\s_-])(ad|ads|advert|sponsor|promo|cookie|banner|popup|newsletter)([\s_-]|$)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self, skip: frozenset | set = frozenset()) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skip and not (skip and _AD.search(n.attrs.get("class") or "")):
                if n.tag in BREAKS:
                    out.append("\n")
                    stack.append("\n")
                stack += reversed(n.kids)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "option") and self.open[-1].tag == tag:
            self.open.pop()
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def squeeze(text: str) -> str:
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def main_text(root: Node) -> str:
    """The longest text of an article, main, section or div, without navigation, forms, scripts and advertisements; else the body's."""
    best = max((squeeze(n.text(NOISE)) for n in root.find("article", "main")), key=len, default="")
    if len(best) < 200:
        best = max((best, *(squeeze(n.text(NOISE)) for n in root.find("section", "div", "body"))), key=len)
    return best or squeeze(root.text(NOISE))


def title(root: Node) -> str | None:
    for n in root.find("meta"):
        if n.attrs.get("property") == "og:title" and n.attrs.get("content"):
            return n.attrs["content"].strip()
    for tag in ("h1", "title"):
        for n in root.find(tag):
            t = " ".join(n.text().split())
            if t:
                return t
    return None


def links(root: Node, base: str) -> list[tuple[str, str]]:
    return [(urljoin(base, a.attrs["href"]), " ".join(a.text().split())) for a in root.find("a") if a.attrs.get("href") and not a.attrs["href"].startswith(("#", "javascript:", "mailto:"))]


def tables(root: Node, most: int = 200) -> list[list[list[str]]]:
    """Rows of cells of each table: empty cells are dropped before alignment, and so are rows whose cells are all equal, a single one
    included, and tables under two columns.  Of a longer table the first ``most`` rows, and a row that says how many are missing."""
    out = []
    for t in root.find("table"):
        rows = [[c for c in (" ".join(x.text().split()) for x in r.find("td", "th")) if c] for r in t.find("tr")]
        rows = [r for r in rows if len(set(r)) > 1]
        if rows:
            more = len(rows) - most
            out.append(rows[:most] + ([[f"… {more} further row(s) omitted (showing {most} of {len(rows)}) …"]] if more > 0 else []))
    return out


def markdown(rows: list[list[str]]) -> str:
    n = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in [*r, *[""] * (n - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * n, *map(line, rows[1:])])


def ld_json(root: Node) -> str | None:
    """The longest article body in linked data."""
    best = None
    for n in root.find("script"):
        if n.attrs.get("type") != "application/ld+json":
            continue
        raw = re.sub(r",\s*([}\]])", r"\1", "".join(k for k in n.kids if isinstance(k, str)))
        try:
            stack = [json.loads(raw)]
        except ValueError:
            continue
        while stack:
            x = stack.pop()
            if isinstance(x, list):
                stack += x
            elif isinstance(x, dict):
                for key in ("articleBody", "text", "description"):
                    if isinstance(x.get(key), str) and len(x[key]) > 200 and len(x[key]) > len(best or ""):
                        best = x[key]
                        break
                stack += [v for v in x.values() if isinstance(v, (dict, list))]
    return best


# Where pages keep the state they start from, and the keys under which it holds bodies.
STATES = [r"""id=["']__NEXT_DATA__["'][^>]*>""", r"window\.__INITIAL_STATE__\s*=", r"window\.__PRELOADED_STATE__\s*=", r"window\.__APOLLO_STATE__\s*=", r"window\.__NUXT__\s*=", r"window\.__data\s*=", r"""id=["']__NUXT_DATA__["'][^>]*>"""]
BODY_KEYS = ["articlebody", "article_body", "storycontent", "story_content", "fullstory", "content_html", "bodyhtml", "body_html", "rendered", "story", "body", "content", "text", "description"]


def embedded_state(html: str | None, deepest: int = 8) -> str | None:
    """The longest body in the state that a page starts from: the first kind of state that holds one counts.

    A body is over 400 characters under a body's key, or over 2000 of prose under any; lists are read in full.
    """
    html = html or ""
    decoder = json.JSONDecoder()
    for kind in STATES:
        bodies: list[str] = []
        for m in re.finditer(kind + r"\s*(?=\{)", html):
            try:
                stack = [("", decoder.raw_decode(html, m.end())[0], 0)]
            except (ValueError, RecursionError):
                continue
            while stack:
                key, x, depth = stack.pop()
                if isinstance(x, str):
                    if len(x) > 2000 and ("<p" in x or ". " in x) or len(x) > 400 and any(k in key for k in BODY_KEYS):
                        bodies.append(x)
                elif depth <= deepest and isinstance(x, dict):
                    stack += [(str(k).lower().replace("-", "_"), v, depth + 1) for k, v in x.items()]
                elif depth <= deepest and isinstance(x, list):
                    stack += [("", v, depth + 1) for v in x if isinstance(v, (dict, list))]
        if bodies:
            return max(bodies, key=len)
    return None


def metadata(root: Node) -> dict[str, str]:
    keys = {"og:title": "title", "og:description": "description", "og:image": "image", "og:site_name": "site", "author": "author", "article:published_time": "published", "description": "description"}
    out: dict[str, str] = {}
    for n in root.find("meta"):
        k = keys.get(n.attrs.get("property") or n.attrs.get("name") or "")
        if k and n.attrs.get("content"):
            out.setdefault(k, n.attrs["content"].strip())
    return out


def images(root: Node, base: str, most: int = 5) -> list[str]:
    found = [n.attrs["content"] for n in root.find("meta") if n.attrs.get("property") == "og:image" and n.attrs.get("content")]
    for n in root.find("img"):
        src, width = n.attrs.get("src") or "", n.attrs.get("width") or ""
        if src and not re.search(r"logo|icon|sprite|pixel|avatar|blank|spacer", src, re.I) and not (width.isdigit() and int(width) < 150):
            found.append(src)
    return list(dict.fromkeys(urljoin(base, f) for f in found))[:most]


def headlines(root: Node, base: str) -> list[tuple[str, str]]:
    """(title, url) of linked headings, 15 to 300 characters, the first of equal titles."""
    out: dict[str, str] = {}
    for h in root.find("h2", "h3", "h4", "article"):
        for a in ([h] if h.tag == "a" else h.find("a")):
            t = " ".join(a.text().split())
            if 15 <= len(t) <= 300 and a.attrs.get("href"):
                out.setdefault(t, urljoin(base, a.attrs["href"]))
    return list(out.items())


# Fixed values, which must match for right results: links to articles, and paths of listings, articles and data.
ARTICLE_LINK = r"(/article|/story|/post|/blog|/news/|/\d{4}/\d{2}/|/read|/p/|/detail|\.html|\.htm|\.cms|-news-|/newsdetail|/storydetail|/articleshow)"
LISTING_PATH = r"^(/|/home|/news|/markets?|/finance|/business|/world|/tech|/sports?|/latest|/top-stories?)$"
ARTICLE_PATH = r"(/article|/story|/post|/blog|/news/\d|/\d{4}/\d{2}|/read|/detail)"
DATA_PATH = r"(indices|index|market|stocks?|screener|quotes?|rates?|data|dashboard|report)"


def page_type(root: Node, url: str) -> tuple[str, float]:
    """data, mixed, homepage, article or unknown, with a confidence.  Tables decide first, then links to articles on a page that lists, then
    marks of an article; a bare listing path is a weak homepage."""
    path = urlparse(url or "").path.rstrip("/")
    said = lambda rule: re.search(rule, path, re.I) is not None
    listing = not path or said(LISTING_PATH)
    grids = sum(bool(t.find("thead")) or len(t.find("th")) >= 2 or len(t.find("tr")) > 2 for t in root.find("table"))
    linked = sum(bool(re.search(ARTICLE_LINK, a.attrs.get("href") or "", re.I)) and len("".join(x.strip() for x in a.text().splitlines())) > 20 for a in root.find("a"))
    every = list(root.walk())
    paged = any(re.search(r"pagination|pager", n.attrs.get("class") or "", re.I) or (n.tag == "nav" and re.search("page", n.attrs.get("aria-label") or "", re.I)) for n in every)
    marked = any(n.tag == "article" or (n.tag == "script" and n.attrs.get("type") == "application/ld+json") or re.search("Article|NewsArticle|BlogPost", n.attrs.get("itemtype") or "", re.I) for n in every)
    words = sum(len(b.text().split()) for b in root.find("body")[:1])
    verdicts = [
        (grids >= 2 or (grids and said(DATA_PATH)), ("mixed" if linked >= 5 else "data", 0.85 if grids >= 2 else 0.7)),
        (linked >= 10 or (linked >= 5 and (listing or paged)), ("homepage", min(0.95, 0.6 + linked * 0.02))),
        (marked or said(ARTICLE_PATH) or words > 400, ("article", 0.8 if marked else 0.65)),
        (listing, ("homepage", 0.5)),
    ]
    return next((v for hit, v in verdicts if hit), ("unknown", 0.3))


PAGE = "page_id long, url string, title string, text string, words int, page_type string, confidence double, n_links int, n_tables int, n_headlines int, n_images int, author string, published string, strategy string"


def extract(pages: DataFrame, least: int = 80) -> DataFrame:
    """One row of PAGE per page (page_id, url, html).  The first strategy that gives enough words and little junk wins, else the best by words."""

    def run(batches):
        for p in batches:
            rows = []
            for page_id, url, html in zip(p["page_id"], p["url"], p["html"], strict=True):
                root, url = parse(html), url or ""
                tries = [("ld_json", squeeze(ld_json(root) or "")), ("embedded_state", squeeze(parse(state).text(NOISE)) if (state := embedded_state(html)) else ""), ("main_text", main_text(root))]
                good = [(s, t) for s, t in tries if len(t.split()) >= least and junk(t) < 0.70]
                how, text = good[0] if good else max(tries, key=lambda x: len(x[1].split()) * (1 - 0.6 * junk(x[1])))
                kind, sure = page_type(root, url)
                meta = metadata(root)
                rows.append((page_id, url, title(root), text, len(text.split()), kind, sure, len(links(root, url)), len(tables(root)), len(headlines(root, url)), len(images(root, url)), meta.get("author"), meta.get("published"), how))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGE.split(", ")])

    return pages.select("page_id", "url", "html").mapInPandas(run, PAGE)


def junk(text: str) -> float:
    lines = [x for x in text.split("\n") if x.strip()]
    return sum(len(x) < 45 for x in lines) / len(lines) if lines else 1.0


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cells) of all tables."""

    def run(batches):
        for p in batches:
            rows = [(i, t, r, cells) for i, html in zip(p["page_id"], p["html"], strict=True) for t, rs in enumerate(tables(parse(html))) for r, cells in enumerate(rs)]
            yield pd.DataFrame(rows, columns=["page_id", "table_no", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table_no int, row_no int, cells array<string>")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of all links, made absolute."""

    def run(batches):
        for p in batches:
            rows = [(i, u, t) for i, base, html in zip(p["page_id"], p["url"], p["html"], strict=True) for u, t in links(parse(html), base or "")]
            yield pd.DataFrame(rows, columns=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string")


def blocked(html: Column) -> Column:
    """A challenge or log-in wall instead of a page."""
    head = F.lower(F.substring(html, 1, 4000))
    return (F.length(html) < 20_000) & head.rlike("captcha|cloudflare|access denied|are you a robot|verify you are human|enable javascript and cookies")


def host(url: Column) -> Column:
    """The host of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)), r"^www\.", "")


def url_date(url: Column) -> Column:
    """A day in the path of a URL; null without one."""
    got = lambda i: F.regexp_extract(url, r"/(20\d{2})[/-](\d{2})[/-](\d{2})", i)
    return F.when(got(1) != "", F.try_to_timestamp(F.concat_ws("-", got(1), got(2), got(3)), F.lit("yyyy-MM-dd")))


def feed_entries(feeds: DataFrame) -> DataFrame:
    """(feed, url, title, published) of sitemaps, RSS and Atom documents (feed, xml); undated entries stay."""
    block = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:url|item|entry)\b[^>]*>(.*?)</(?:url|item|entry)>"), F.lit(1)))
    one = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_extract("b", rf"(?s)<{n}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{n}>", 1)), F.lit("")) for n in names])
    rows = feeds.select("feed", block.alias("b"))
    link = F.coalesce(one("loc", "link"), F.nullif(F.regexp_extract("b", r'<link[^>]*href="([^"]+)"', 1), F.lit("")))
    when = one("lastmod", "news:publication_date", "pubDate", "published", "updated")
    return rows.select("feed", link.alias("url"), one("title", "news:title").alias("title"), X.parse_time(when).alias("published")).where("url is not null")
