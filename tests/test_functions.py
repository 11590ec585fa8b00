import pytest

from siteaudit.functions import robots, serp
from siteaudit.functions.decoding import decode
from siteaudit.functions.html_facts import parse
from siteaudit.functions.urls import normalise


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("HTTP://Example.COM", None, "http://example.com/"),
        ("https://example.com:443/a", None, "https://example.com/a"),
        ("http://example.com:8080/a", None, "http://example.com:8080/a"),
        ("https://user:pw@example.com/a#frag", None, "https://example.com/a"),
        ("https://example.com/a/../b/./c", None, "https://example.com/b/c"),
        ("https://example.com/a/..", None, "https://example.com/"),
        ("https://example.com/%e2%9c%93", None, "https://example.com/%E2%9C%93"),
        ("https://example.com/A?b=2&a=1", None, "https://example.com/A?b=2&a=1"),
        ("https://example.com/a?", None, "https://example.com/a"),
        ("https://example.com/a/", None, "https://example.com/a/"),
        ("../c?x", "https://example.com/a/b", "https://example.com/c?x"),
        ("//cdn.example.com/x", "https://example.com/", "https://cdn.example.com/x"),
        (" /p q ", "https://example.com/", "https://example.com/p%20q"),
        ("mailto:a@b.c", None, None), ("javascript:void(0)", "https://example.com/", None), ("", None, None), (None, None, None), ("http://[bad", None, None), ("http://example.com:99999/", None, None),
    ],
)
def test_normalise(url, base, want):
    assert normalise(url, base) == want


def test_normalise_is_idempotent():
    for u in ("HTTP://Example.COM/%7ea/../b?q#x", "https://bücher.example/ü"):
        assert normalise(normalise(u)) == normalise(u)


def test_robots():
    p = robots.parse("User-agent: a\nUser-agent: bot\nDisallow: /x\nAllow: /x/ok$\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /*.pdf # no\nSitemap: https://e.com/s.xml\n")
    assert not p.allows("/x/1", "bot") and p.allows("/x/ok", "bot") and not p.allows("/x/ok2", "bot")
    assert p.allows("/x/1", "other") and not p.allows("/a/b.pdf?q", "other")
    assert not p.allows("/x", "MyBot/1.0") and p.delay("bot") == 2.0 and p.delay("other") is None
    assert p.sitemaps == ["https://e.com/s.xml"]
    tie = robots.parse("User-agent: *\nDisallow: /a\nAllow: /a\n")
    assert tie.allows("/a")
    assert not robots.from_response(503, None).allows("/") and robots.from_response(404, None).allows("/") and not robots.from_response(0, None).allows("/")
    assert robots.parse("").allows("/any")


def test_decoding():
    assert decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert decode(b"\x80", "text/html; charset=latin1") == "€"
    assert decode(b'<meta charset="windows-1251">\xcf') == '<meta charset="windows-1251">П'
    assert decode("ü".encode()) == "ü" and decode(b"\xfc") == "ü"
    assert decode(b"\xff\xfe", "text/html; charset=utf-8").startswith("ÿ")


def test_serp_width():
    assert serp.width("i" * 20, 20) == 89 and serp.width("W" * 20, 20) == 378
    assert serp.width("", 20) is None and serp.width(None, 20) is None


def test_html_facts():
    page = """<html lang="en"><head><title> A  b </title><title>c</title><meta name="description" content="d"><meta name="ROBOTS" content="noindex">
    <link rel="canonical" href="/c"><link rel="alternate" hreflang="de" href="/de"><link rel="stylesheet" href="s.css"><meta property="og:title" content="O"><meta name="og:title" content="N">
    <script type="application/ld+json">{"@graph":[{"@type":["https://schema.org/Article","X"]},{"a":{"@type":"Y"}}]}</script><script type="application/ld+json">{bad</script>
    <script>var x = "</p>"; gtag('config', 1)</script></head><body itemtype="https://schema.org/Product"><h1>H <b>one</b><p>Text&amp;more<br>x</p></h1><a name="n">no</a><a href=" /l ">go <i>on</i></a><a href="">e</a>
    <img src="i.png" alt="" width="10" height="a"><noscript>hidden</noscript></body></html>"""
    f = parse(page)
    assert (f.title, f.title_count, f.meta_description, f.meta_robots, f.canonical, f.lang) == ("A b", 2, "d", "noindex", "/c", "en")
    assert f.h1 == "H oneText&morex" or f.h1.startswith("H one")
    assert [x["href"] for x in f.links] == ["/l"] and f.links[0]["anchor_text"] == "go on" and f.links[0]["position"] == 0
    assert f.images == [{"src": "i.png", "alt": "", "width": 10, "height": None}]
    assert {(x["format"], x["type"]) for x in f.structured_data} == {("json-ld", "Article"), ("json-ld", "X"), ("json-ld", "Y"), ("microdata", "Product")}
    assert f.social["og:title"] == "O" and f.analytics == ["Google Analytics 4"] and "hidden" not in f.text and "Text&more x" in f.text
    empty = parse(None)
    assert empty.title is None and empty.word_count == 0 and len(empty.content_hash) == 32


def test_text_without_body_or_head():
    from siteaudit.functions.html_facts import parse

    for page in ("<title>a</title><p>hello world", "hello world", "<html><title>a</title>hello world", "<head><title>a</title></head>hello world", "<meta name=x content=y><div>hello world</div>", "<!doctype html><script>x</script>hello <b>world</b>"):
        f = parse(page)
        assert (f.text, f.word_count) == ("hello world", 2), page
    assert parse("<title>a</title>").text == "" and parse("<title>a</title><p>hello").title == "a"


def test_selectors_on_deep_pages():
    from siteaudit.config import ExtractionRule
    from siteaudit.functions.extraction import extract

    deep = "<div class=a>" * 20_000 + "<i id=x>deep<b>er</b></i>"
    assert extract(deep, [ExtractionRule("t", "#x"), ExtractionRule("h", "#x", "html"), ExtractionRule("p", "//i/text()", engine="xpath")]) == [("t", "deeper", 0), ("h", '<i id="x">deep<b>er</b></i>', 0), ("p", "deep", 0)]
    assert len(extract("<div>" * 3000, [ExtractionRule("h", "body > p")])) == 0


def test_metric_text_and_filter_names():
    from siteaudit.plans.catalogue import COLUMNS, report, reports

    assert report("responseCodes").filter("transportError").name == "No response" and COLUMNS["nearDuplicates"].header == "Near Dupes" and COLUMNS["skipReason"].header == "Why Not Crawled"
    assert sum(len(r.filters) for r in reports()) == 163 and all(c in COLUMNS for r in reports() for c in r.columns)
