import pytest

from siteaudit.config import CrawlConfig, ExtractionRule, Schedule
from siteaudit.functions.extraction import extract
from siteaudit.sources import http


def test_config_round_trip_and_clamps():
    c = CrawlConfig("https://e.com", workers=99, max_per_host=80, timeout=0, url_cap=0, include=("a", "("), extractions=(ExtractionRule("p", ".price"),), basic_auth_user="u", basic_auth_password="p")
    assert CrawlConfig.from_json(c.to_json()) == c and CrawlConfig.from_json('{"seed_url": "x", "later": 1}').workers == 5
    k = c.clamped()
    assert (k.workers, k.max_per_host, k.timeout, k.url_cap, k.include) == (50, 50, 1, 1, ("a",))
    assert c.headers()["Authorization"] == "Basic dTpw" and c.rules().seed_host == "e.com"
    with pytest.raises(ValueError):
        CrawlConfig("mailto:x").rules()


def test_schedule():
    assert Schedule("https://e.com", 3, 5, 1).cron() == "5 3 * * 1" and Schedule("https://e.com", 3).summary() == "Every day at 03:00"
    assert len(Schedule("x", 24, 60, 7).problems()) == 4


def test_extraction_rules():
    page = '<div id="a" class="x y"><p>One <b>1</b><p class="price" data-v="7">Two</div><ul><li>a<li>b</ul><a href="/l">z</a>'
    rules = [ExtractionRule("c", "div.x > p.price"), ExtractionRule("h", "p b", "html"), ExtractionRule("a", "a[href]", "attribute"), ExtractionRule("n", "li:nth-child(2)"), ExtractionRule("bad", "p:::"), ExtractionRule("x", "//ul/li[2]", "text", "xpath"), ExtractionRule("y", "//p[@class='price']/@data-v", "text", "xpath"), ExtractionRule("f", "count(//p)", "text", "xpath")]
    assert extract(page, rules) == [("c", "Two", 0), ("h", "<b>1</b>", 0), ("a", "/l", 0), ("n", "b", 0), ("x", "b", 0), ("y", "7", 0)]


def test_fetch(spark):
    def ask(url, method):
        if url.endswith("head") and method == "HEAD":
            return http.answer(url, 405, {}, b"", method, 1)
        return http.answer(url, 301 if url.endswith("r") else 200, {"Content-Type": "text/html; charset=latin1", "Location": "/x"}, b"\xe9", method, 1)

    rows = {r.url: r for r in http.fetch(spark.createDataFrame([("http://e/r", "e", 0), ("http://e/head", "e", 1), ("http://e/only", "e", 1)], "url string, host string, check_only int"), {}, ask=ask).collect()}
    assert rows["http://e/r"].location == "http://e/x" and rows["http://e/r"].html == "é" and rows["http://e/head"].content_length == 1 and rows["http://e/only"].content_length is None
    assert http.error_kind(TimeoutError()) == "timedOut"
