from siteaudit.config import ExtractionRule
from siteaudit.functions import pdf, robots
from siteaudit.operators import extractions, frontier
from siteaudit.sources.crawl import Crawl


def test_pdf_info():
    data = b"%PDF-1.4 << /Title (A \\(b\\) \\303) /Subject <FEFF00E90021> /Creator (x) >> << /Title (second) /Lang (en-GB) >>"
    assert pdf.is_pdf(data) and pdf.is_pdf(b"", "application/pdf; x") and not pdf.is_pdf(b"<html>")
    assert pdf.info(data) == {"title": "A (b) Ã", "meta_description": "é!", "lang": "x"}
    assert pdf.info(b"") == {"title": None, "meta_description": None, "lang": None}


def test_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><p></p><p>b</p>"), (2, None)], "url_id long, html string")
    got = extractions.from_pages(pages, [ExtractionRule("p", "p")]).collect()
    assert sorted(map(tuple, got)) == [(1, "p", "a", 0), (1, "p", "b", 2)]
    crawl = Crawl.of(spark, responses=spark.createDataFrame([(1, '{"X-A":"1","b":"2"}'), (2, '{"x-a":"3"}'), (3, None)], "url_id long, headers_json string"), page_facts=spark.createDataFrame([(1,), (3,)], "url_id long"))
    assert [tuple(r) for r in extractions.from_headers(crawl, ["x-a", "none"]).collect()] == [(1, "X-A", "1", 0)]


def test_robots_gate(spark):
    policy = robots.parse("User-agent: *\nDisallow: /no\n")
    urls = spark.createDataFrame([(1, "https://e/no?x", 1), (2, "https://e/yes", 1), (3, "https://x/no", 0)], "id long, url string, is_internal int")
    ids = extractions.keep_out(urls, policy, "bot")
    assert [r.id for r in ids.collect()] == [1]
    queue = urls.selectExpr("id", "url", "is_internal", "0 AS state", "cast(NULL AS string) AS skip_reason")
    from pyspark.sql import functions as F

    marked = {r.id: (r.state, r.skip_reason) for r in frontier.mark(queue, ids, 3, F.lit(frontier.BLOCKED)).collect()}
    assert marked == {1: (3, "blocked by robots.txt"), 2: (0, None), 3: (0, None)}
