"""The page reader: what is a tag, what is implied, and time in proportion to the page."""

import random
from time import perf_counter

import pytest

from siteaudit.config import ExtractionRule
from siteaudit.functions import markup as M
from siteaudit.functions.extraction import extract, tree
from siteaudit.functions.html_facts import parse


def plain(page: str) -> list:
    """Events without attributes; text joined."""
    out: list = []
    for kind, what, *_ in M.events(page):
        if kind == M.TEXT and out and out[-1][0] == M.TEXT:
            out[-1] = (M.TEXT, out[-1][1] + what)
        else:
            out.append((kind, what))
    return out


@pytest.mark.parametrize(
    "page, expected",
    [
        ("a<b>c</b >d", [("text", "a"), ("start", "b"), ("text", "c"), ("end", "b"), ("text", "d")]),
        ("1 < 2 << 3 <", [("text", "1 < 2 << 3 <")]),
        ("a<!-- > <b> -->c<!-->d<!--->e<!-- --!>f", [("text", "acdef")]),
        ("a<!doctype x>b<?php x?>c</ >d<![CDATA[x]]>e", [("text", "abcde")]),
        ("<script>a<b></x></scripty></SCRIPT\n>c", [("start", "script"), ("text", "a<b></x></scripty>"), ("end", "script"), ("text", "c")]),
        ("<script><!--<script></script>--></script>x", [("start", "script"), ("text", "<!--<script></script>-->"), ("end", "script"), ("text", "x")]),
        ("<script><!--</script>x", [("start", "script"), ("text", "<!--"), ("end", "script"), ("text", "x")]),
        ("<title>a &amp; <b></title>", [("start", "title"), ("text", "a & <b>"), ("end", "title")]),
        ("<style>a&amp;</style>", [("start", "style"), ("text", "a&amp;"), ("end", "style")]),
        ("<textarea><p></textarea>", [("start", "textarea"), ("text", "<p>"), ("end", "textarea")]),
        ("<plaintext><b></plaintext>", [("start", "plaintext"), ("text", "<b></plaintext>")]),
        ("x<a b", [("text", "x")]), ("x<a b='>", [("text", "x")]), ("x<!-- y", [("text", "x")]), ("<script>x", [("start", "script"), ("text", "x")]),
        ("&#" + "9" * 6000 + ";&#x41;&#0065;&#00000000065;&eacute", [("text", "�AAAé")]),
    ],
)
def test_events(page, expected):
    assert plain(page) == expected


def test_attributes():
    page = """<a HREF=x/y?a&copy=1&amp;b&lt class='p "q"' b  c = "d>e" / =f=g x=1 X=2 h=&notit;&copy/>t"""
    kind, tag, attrs, closed = next(M.events(page))
    assert (kind, tag, closed) == (M.START, "a", False)
    assert attrs == {"href": "x/y?a&copy=1&b<", "class": 'p "q"', "b": "", "c": "d>e", "=f": "g", "x": "1", "h": "&notit;©/"}
    assert next(M.events("<br/>"))[3] is True


@pytest.mark.parametrize(
    "page, shape",
    [
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "html(body(ul(li li(ul(li)) li)))"),
        ("<p>a<div>b<p>c<p>d</div>", "html(body(p div(p p)))"),
        ("<table><tr><td>a<td>b<tr><th>c<table><tr><td>d</table><td>e</table>", "html(body(table(tr(td td) tr(th(table(tr(td))) td))))"),
        ("<dl><dt>a<dd>b<dt>c</dl><select><option>x<option>y<optgroup><option>z</select>", "html(body(dl(dt dd dt) select(option option optgroup(option))))"),
        ("<title>t</title><p>x", "html(head(title) body(p))"),
        ("<!doctype html>\n<html><head><meta><link></head><body class=b><a>x<a>y", "html(head(meta link) body(a a))"),
        ("x<b>y</i></b><body><html>", "html(body(b))"),
        ("<p><button><p>x</button>y", "html(body(p(button(p))))"),
        ("<svg><path/><g/></svg><div/>x", "html(body(svg(path g) div))"),
        ("<thead><tr><td>", "html(body(thead(tr(td))))"),
    ],
)
def test_implied_tags(page, shape):
    def write(n) -> str:
        inner = " ".join(write(c) for c in n.elements())
        return f"{n.tag}({inner})" if inner else n.tag

    assert " ".join(write(c) for c in tree(page).elements()) == shape


def test_a_megabyte_takes_no_long():
    lines = {
        "open tags": "<a " * 350_000, "scripts": "<script " * 130_000, "raw scripts": "<script><!--<script>" * 50_000, "comments": "<!--" * 260_000, "nested": "<div>" * 200_000, "nested and crossed": "<div><p>" * 60_000 + "</b></p>" * 60_000,
        "quotes": "<a b='" * 170_000, "odd quotes": "<a b=\"x' c='y>" * 70_000, "less": "<" * 1_000_000, "amp": "&" * 1_000_000, "number": "&#" + "1" * 1_000_000, "names": "&a" * 500_000, "dashes": "<!" + "-" * 1_000_000, "spaces": "<a " + " " * 1_000_000,
        "noscript": "<noscript>" * 100_000, "titles": "<title>" * 140_000, "buttons": "<p><button>" + "<div>" * 200_000, "list": "<ul><li>" * 120_000, "json": "<script type=application/ld+json>" + "[" * 1_000_000 + "</script>", "slashes": "<a" + "/" * 1_000_000, "equals": "<a " + "=" * 1_000_000, "ends": "</p>" * 250_000,
    }
    rules = [ExtractionRule("t", "h1"), ExtractionRule("x", "//h1/text()", engine="xpath")]
    for name, page in lines.items():
        began = perf_counter()
        parse(page)
        extract(page, rules)
        assert perf_counter() - began < 8, name  # both together; each is some two seconds at most


def test_pages_of_any_kind_do_not_crash():
    rng = random.Random(2)
    bits = ["<", ">", "a", "/", "!--", "--", "=", '"', "'", " ", "script", "title", "<p>", "</p>", "<li>", "<table>", "<td>", "&", "amp;", "#1", "x", "\0", "<svg>", "/>", "<a href=x>", "<head>", "</head>", "<body>", "<h1>"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        parse(page)
        tree(page)
