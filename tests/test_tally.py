"""Counts moved by batches against counts of a whole view."""

import pytest
from pyspark.sql import functions as F

from siteaudit.operators import reports, tally
from siteaudit.plans.wide import base_rows, wide_view
from siteaudit.sources.crawl import Crawl
from siteaudit.sources.tables import new_folder, written

SITE = "https://a.test"


def _site() -> dict[str, dict]:
    """Pages 1 to 12: a title that most share, twins, a redirect, a canonical, near pages."""
    pages = {i: {"url": f"{SITE}/p{i}", "title": "Shared" if i <= 6 else f"Own {i}", "content": f"c{i}", "simhash": 1000003 * i * i * i * 7919, "status": 200, "links": [i % 12 + 1]} for i in range(1, 13)}
    pages[2] |= {"simhash": pages[1]["simhash"] ^ 3}
    pages[7] |= {"status": 301, "to": 8}
    pages[9] |= {"canonical": 10, "alternate": 10}
    pages[10] |= {"alternate": 9}
    pages[11] |= {"url": "http://a.test/p12", "image": 100}
    return pages


def _crawl(spark, pages: dict[int, dict]) -> Crawl:
    none = None
    urls = [(i, p["url"], "a.test", p["url"].split("a.test")[1], 1, 1, 2, 0) for i, p in pages.items()] + [(100, SITE + "/i.png", "a.test", "/i.png", 1, 1, 2, 1)]
    answers = [(i, p["status"], "text/html", p.get("to"), 2000) for i, p in pages.items() if p.get("status") is not None]
    facts = [(i, p["title"], len(p["title"] or ""), 1, p.get("canonical"), p["content"].encode(), p["simhash"], 300) for i, p in pages.items() if p.get("status") == 200]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Crawl.of(
        spark,
        crawl_meta=make([(1, SITE + "/p1")], "id int, seed_url string"),
        urls=make(urls, "id long, url string, host string, path string, depth int, is_internal int, state int, check_only int"),
        responses=make(answers, "url_id long, status int, content_type string, redirect_target_id long, content_length long"),
        page_facts=make(facts, "url_id long, title string, title_length int, title_count int, canonical_id long, content_hash binary, simhash long, word_count int"),
        links=make([(i, t, none if i % 3 else "Click here", n) for i, p in pages.items() for n, t in enumerate(p["links"])], "from_url_id long, to_url_id long, anchor_text string, position int"),
        images=make([(i, p["image"], none) for i, p in pages.items() if "image" in p], "url_id long, src_url_id long, alt string"),
        hreflang=make([(i, "en", p["alternate"]) for i, p in pages.items() if "alternate" in p], "url_id long, lang string, href_url_id long"),
    )


#: What each batch does to which pages; None takes the page away.
BATCHES = [
    {12: {"title": "Shared", "links": [12, 1]}},  # a shared title is taken once more
    {8: {"title": "Own 12", "status": 200}, 12: {"title": "Own 12"}, 10: {"status": 404}},  # a new pair; the end of a canonical and of an alternate
    {1: {"simhash": 5, "content": "c2"}, 11: {"url": "https://a.test/p12/", "image": 100}, 8: {"status": 301, "to": 7}},  # near pages part, equal contents, twins, a loop
    {2: None, 9: {"title": None, "alternate": 9, "canonical": None}, 3: {"status": None}},  # gone, blank, no answer
]


def _moved(pages, batch):
    out = {i: dict(p) for i, p in pages.items()}
    for i, change in batch.items():
        if change is None:
            del out[i]
        else:
            out[i] |= change
    return out


def _as_dict(df):
    return {r["key"]: r["n"] for r in df.collect()}


def test_counts_after_each_batch_equal_a_full_scan(spark):
    path, pages = new_folder(spark, "tally"), _site()
    crawl = _crawl(spark, pages)
    pv = written(wide_view(crawl), "view")
    assert _as_dict(tally.start(pv, path)) == _as_dict(reports.counts(pv))
    seen = []
    for batch in BATCHES:
        pages = _moved(pages, batch)
        after = _crawl(spark, pages)
        got = _as_dict(tally.advance(crawl, after, spark.createDataFrame([(i,) for i in batch], "id long"), path))
        full = _as_dict(reports.counts(wide_view(after)))
        assert {k: (n, full[k]) for k, n in got.items() if n != full[k]} == {} and len(got) == 163
        crawl, seen = after, [*seen, got]
    assert len({tuple(sorted(s.items())) for s in seen}) == len(BATCHES)
    assert _as_dict(tally.counts(spark, path, 1)) == seen[0]


def test_a_broken_batch_is_done_again(spark):
    path, pages = new_folder(spark, "tally"), _site()
    crawl = _crawl(spark, pages)
    tally.start(wide_view(crawl), path)
    # flags of a batch that never came to its counts
    spark.createDataFrame([(3, [0, 1, 2]), (99, [5])], "id long, held array<int>").write.parquet(f"{path}/flags/batch=1")
    pages = _moved(pages, BATCHES[0])
    after = _crawl(spark, pages)
    assert _as_dict(tally.advance(crawl, after, spark.createDataFrame([(12,)], "id long"), path)) == _as_dict(reports.counts(wide_view(after)))
    assert tally.last_batch(spark, path) == 1
    nothing = tally.advance(after, after, spark.createDataFrame([], "id long"), path)
    assert _as_dict(nothing) == _as_dict(tally.counts(spark, path, 1))


def test_a_title_of_many_touches_only_the_page_that_takes_it(spark):
    pages = _site()
    before, after = _crawl(spark, pages), _crawl(spark, _moved(pages, BATCHES[0]))
    touched = spark.createDataFrame([(12,)], "id long")
    ids = {r.id for r in tally.affected(before, after, base_rows(before), base_rows(after), touched).collect()}
    # the page, what it links, and the twin of its url
    assert ids == {12, 1}


def test_another_seed_is_refused(spark):
    crawl = _crawl(spark, _site())
    other = Crawl(spark, dict(crawl.tables) | {"crawl_meta": crawl.crawl_meta.withColumn("seed_url", F.lit("x"))})
    with pytest.raises(ValueError, match="seed"):
        tally.advance(crawl, other, spark.createDataFrame([(1,)], "id long"), new_folder(spark, "tally"))
