import pytest

from siteaudit.plans.wide import wide_view
from siteaudit.sources.pages import ingest
from siteaudit.streaming.ingest import append_parsed, compact, parsed_so_far, rates, smoothed
from tests.conftest import SF


def test_ingest(spark):
    page = '<html><head><title>One</title><link rel="canonical" href="/"></head><body><h1>H</h1><a href="/b">B</a><a href="https://x.com/">X</a><img src="/i.png">words here now</body></html>'
    pages = spark.createDataFrame([("https://e.com", page, 200), ("https://e.com/b", "<title>Two</title>", 404), ("https://e.com/", page, 200), ("mailto:x", "", 200)], "url string, html string, status int")
    crawl = ingest(spark, pages, "https://e.com/")
    pv = {r.url: r for r in wide_view(crawl).collect()}
    assert set(pv) == {"https://e.com/", "https://e.com/b", "https://x.com/", "https://e.com/i.png"}
    assert pv["https://e.com/"].title == "One" and pv["https://e.com/b"].inlinks == 1 and pv["https://e.com/b"].status == 404 and not pv["https://e.com/i.png"].visible
    assert pv["https://e.com/"].indexability == "Indexable" and pv["https://x.com/"].is_internal == 0
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    real = ingest(spark, pages, pages.first().url)
    assert real.links.count() > 0 and real.page_facts.count() == real.responses.count() > 0


def test_stream(spark, tmp_path):
    rows = [("https://e.com/", "<title>a</title>"), ("https://e.com/", "<title>a</title>"), ("https://e.com/2", "<title>b</title>")]
    spark.createDataFrame(rows, "url string, html string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS fetched_at").write.parquet(str(tmp_path / "in"))
    append_parsed(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.title for r in parsed_so_far(spark, str(tmp_path / "out")).collect()) == ["a", "b"]
    assert smoothed([]) is None and smoothed([10.0, 0.0]) == 7.0
    compact(spark, str(tmp_path / "out"), str(tmp_path / "one"), 1)
    assert sorted(r.title for r in spark.read.parquet(str(tmp_path / "one")).collect()) == ["a", "b"]


def test_rates_of_a_stream(spark, tmp_path):
    """Two batches: the state of the first goes on in the second."""
    ticks = [("c", 0, 0), ("c", 10, 100), ("d", 0, 5), ("c", 10, 100)], [("c", 20, 100), ("c", 5, 1), ("d", 2, 9), ("c", 30, 130)]
    got = []
    for n, part in enumerate(ticks):
        spark.createDataFrame(part, "crawl string, s int, crawled long").selectExpr("crawl", "timestamp_seconds(s) AS at", "crawled").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema("crawl string, at timestamp, crawled long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = rates(stream).writeStream.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    rates_of = {c: [r for k, _, r in sorted(got, key=lambda g: g[1]) if k == c] for c in "cd"}
    assert rates_of["c"] == pytest.approx([10.0, smoothed([10.0, 0.0]), smoothed([10.0, 0.0, 3.0])]) and rates_of["d"] == [2.0]
