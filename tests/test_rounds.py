"""Whole crawls of a small made-up site, through the same fetch, parse and admit steps as real ones."""

import pytest
from pyspark.sql import functions as F

from siteaudit.config import CrawlConfig, ExtractionRule
from siteaudit.functions import robots
from siteaudit.operators import rounds
from siteaudit.sources import http

HTML = {"Content-Type": "text/html; charset=utf-8"}
PAGES = {
    "/": '<title>Home</title><h1>Hi</h1><a href="/a">A</a><a href="/private/x">P</a><a href="/old">Old</a><a href="https://other.org/y" >Other</a><a rel=nofollow href="/nf">N</a><img src=/i.png alt=""><a href="/doc.pdf">Doc</a>',
    "/a": '<title>A</title><link rel=canonical href="/"><p class=price>7</p><a href="/b">B</a><a href="/a#top">self</a>',
    "/b": "<title>B</title>Words without a body.",
    "/private/x": "<title>No</title>",
    "/new": "<title>New</title><a href='/c?utm=1'>C</a>",
    "/listed": "<title>Listed</title>",
    "/nf": "<title>NF</title>",
}
ROBOTS = b"User-agent: *\nDisallow: /private\nSitemap: https://site.test/sitemap.xml\n"
SITEMAP = b"<urlset><url><loc>https://site.test/listed</loc></url><url><loc>https://site.test/a</loc></url></urlset>"


def ask(url, method):
    host, _, path = url.removeprefix("https://").partition("/")
    path = "/" + path
    if host != "site.test":
        return http.answer(url, 200, HTML, b"", method, 1)
    if path == "/robots.txt":
        return http.answer(url, 301, {"Location": "/r2.txt"}, b"", method, 1)
    if path == "/r2.txt":
        return http.answer(url, 200, {"Content-Type": "text/plain"}, ROBOTS, method, 1)
    if path == "/sitemap.xml":
        return http.answer(url, 200, {"Content-Type": "text/xml"}, SITEMAP, method, 1)
    if path == "/old":
        return http.answer(url, 301, {**HTML, "Location": "/new"}, b"", method, 1)
    if path == "/doc.pdf":
        return http.answer(url, 200, {"Content-Type": "application/pdf"}, b"%PDF-1.4 /Title (A paper) /Creator (Pen)", method, 1)
    if path == "/i.png":
        return http.answer(url, 200, {"Content-Type": "image/png", "Content-Length": "9"}, b"", method, 1)
    page = PAGES.get(path)
    return http.answer(url, 200 if page else 404, {**HTML, "X-Robots-Tag": "noarchive"} if path == "/b" else HTML, (page or "").encode(), method, 1)


CONFIG = CrawlConfig("https://site.test/", extractions=(ExtractionRule("price", ".price"),), header_extractions=("x-robots-tag",))


@pytest.fixture(scope="module")
def crawled(spark, tmp_path_factory):
    seen = []
    got = rounds.crawl(spark, CONFIG, str(tmp_path_factory.mktemp("crawl")), ask, on_progress=seen.append)
    return got, seen


def test_whole_site(crawled):
    crawl, seen = crawled
    urls = {r.url.removeprefix("https://site.test"): r for r in crawl.urls.collect()}
    status = {r.url_id: r for r in crawl.responses.collect()}
    got = {u: status[r.id].status for u, r in urls.items() if r.id in status}
    assert got == {"/": 200, "/a": 200, "/b": 200, "/old": 301, "/new": 200, "/listed": 200, "/doc.pdf": 200, "/i.png": 200, "/c?utm=1": 404, "https://other.org/y": 200}
    assert urls["/private/x"].skip_reason == "blocked by robots.txt" and urls["/nf"].skip_reason == "not followed"
    assert (urls["/"].depth, urls["/a"].in_sitemap, urls["/listed"].in_sitemap, urls["/new"].redirect_hops, urls["https://other.org/y"].check_only) == (0, 1, 1, 1, 1)
    assert status[urls["/old"].id].redirect_target_id == urls["/new"].id
    facts = {r.url_id: r for r in crawl.page_facts.collect()}
    assert facts[urls["/a"].id].canonical_id == urls["/"].id and facts[urls["/b"].id].word_count == 4 and facts[urls["/b"].id].x_robots_tag == "noarchive"
    assert (facts[urls["/doc.pdf"].id].title, facts[urls["/doc.pdf"].id].lang) == ("A paper", "Pen")
    assert status[urls["/b"].id].body_gz and not status[urls["/i.png"].id].body_gz
    assert {(r.name, r.value) for r in crawl.extractions.collect()} == {("price", "7"), ("X-Robots-Tag", "noarchive")}
    assert crawl.images.count() == 1 and crawl.links.where(F.col("from_url_id") == urls["/"].id).count() == 6
    assert crawl.crawl_meta.first().seed_url == "https://site.test/" and crawl.crawl_meta.first().finished_at
    assert seen[-1].queued == 0 and seen[-1].crawled == 10 and [p.round for p in seen] == [2, 3, 4, 5]


def test_stopped_and_taken_up_again(spark, crawled, tmp_path):
    path = str(tmp_path / "c")
    first = rounds.crawl(spark, CONFIG, path, ask, round_size=2, max_rounds=1)
    assert first.responses.count() == 2 and first.crawl_meta.first().finished_at is None
    # a round that broke off half way leaves tables without a commit: they are written anew
    rounds.Folder(spark, path).write("responses", 3, first.responses)
    again = rounds.crawl(spark, CONFIG, path, ask, round_size=4)
    known = {(r.url, r.state) for r in crawled[0].urls.collect()}
    assert {(r.url, r.state) for r in again.urls.collect()} == known and again.responses.count() == crawled[0].responses.count()
    assert rounds.crawl(spark, CONFIG, path, ask).urls.count() == again.urls.count()


def test_pause_cap_and_body_limit(spark, tmp_path):
    config = CrawlConfig("https://site.test/", url_cap=3, retain_body_url_limit=1, discover_sitemaps=False)
    assert rounds.crawl(spark, config, str(tmp_path / "p"), ask, stop=lambda: True).responses.count() == 0
    got = rounds.crawl(spark, config, str(tmp_path / "p"), ask, round_size=1)
    assert got.urls.where("skip_reason = 'URL cap reached'").count() > 0 and got.urls.where("state = 2").count() <= 3
    assert got.responses.where("body_gz IS NOT NULL").count() == 1


def test_robots_answers():
    def say(status, location=None):
        return lambda url, method: {"status": status, "location": location, "body": b"User-agent: *\nDisallow: /"}

    assert rounds.site_rules(CONFIG, say(404)) == (robots.ALLOW_ALL, "absent")
    assert rounds.site_rules(CONFIG, say(503)) == (robots.DISALLOW_ALL, "unreachable") and rounds.site_rules(CONFIG, say(429))[1] == "unreachable"
    assert rounds.site_rules(CONFIG, say(301, "https://site.test/robots.txt")) == (robots.DISALLOW_ALL, "unreachable")
    policy, how = rounds.site_rules(CONFIG, say(200))
    assert how == "parsed" and not policy.allows("/x") and rounds.site_rules(CrawlConfig("https://site.test/", respect_robots=False), say(503)) == (robots.ALLOW_ALL, "absent")


def test_error_kinds():
    import errno
    import http.client
    import socket
    import ssl
    import urllib.error

    expired = ssl.SSLCertVerificationError("x")
    expired.verify_message = "certificate has expired"
    cases = [(TimeoutError(), "timedOut"), (urllib.error.URLError(socket.gaierror(socket.EAI_AGAIN, "x")), "dnsLookupFailed"), (socket.gaierror(socket.EAI_NONAME, "x"), "cannotFindHost"), (ConnectionRefusedError(), "cannotConnectToHost"), (expired, "serverCertificateHasBadDate"),
             (ssl.SSLCertVerificationError("self-signed certificate"), "serverCertificateHasUnknownRoot"), (ssl.SSLCertVerificationError("hostname mismatch"), "serverCertificateUntrusted"), (ssl.SSLError("x"), "secureConnectionFailed"), (http.client.RemoteDisconnected(), "networkConnectionLost"),
             (http.client.BadStatusLine("x"), "badServerResponse"), (OSError(errno.ENETUNREACH, "x"), "notConnectedToInternet"), (ValueError(), "badURL"), (urllib.error.URLError("unknown url type: ftp"), "unsupportedURL"), (OSError(99999, "x"), "urlError(99999)")]
    assert [(http_kind, want) for e, want in cases if (http_kind := _kind(e)) != want] == []


def _kind(e):
    return http.error_kind(e)


def test_a_host_is_asked_in_parallel(spark):
    urls = spark.createDataFrame([(f"https://site.test/{i}", "site.test", 0) for i in range(200)], "url string, host string, check_only int")
    one, many = (http.fetch(urls, {}, ask=ask, per_host=n).select(F.spark_partition_id().alias("p")).distinct().count() for n in (1, 4))
    assert one == 1 and many > 1


def test_command_line(spark, tmp_path, capsys):
    from siteaudit import __main__ as cli

    got = cli.arguments().parse_args(["crawl", "https://site.test/", "--out", str(tmp_path / "x"), "--css", "price=.price", "--header", "X-A: b:c", "--max-rounds", "2", "--limit", "50"])
    assert cli.config_of(got).extra_headers == {"X-A": "b:c"} and cli.config_of(got).extractions[0].selector == ".price"
    assert cli.run_crawl(spark, got, ask) == 0
    assert "totalURLs" in capsys.readouterr().out
    assert cli.main(["export", str(tmp_path / "x"), "--out", str(tmp_path / "out"), "--report", "titles", "--limit", "1"]) == 0
    assert cli.main(["schedule", "https://site.test/", "--hour", "3", "--weekday", "1"]) == 0 and "0 3 * * 1" in capsys.readouterr().out
    assert cli.main(["schedule", "x", "--hour", "30"]) == 2
    with pytest.raises(SystemExit):
        cli.arguments().parse_args(["crawl", "https://site.test/", "--css", "nothing"])


def test_rendering_and_another_reader(spark, tmp_path):
    from siteaudit.functions import html_facts

    def render(url):
        if url.endswith("/b"):
            raise RuntimeError("broken")
        return {"html": f"<title>Shown</title><p>many more words than there were {url}</p>", "elapsed_ms": 7, "errors": ["e1", "e2"], "metrics": {"ttfb_ms": 3, "resources": 2}, "scripts": {"z": "1", "a": "2"}}

    def reader(html):
        facts = html_facts.parse(html)
        facts.title = (facts.title or "") + "!"
        return facts

    config = CrawlConfig("https://site.test/a", render_javascript=True, discover_sitemaps=False, seed_list=("https://site.test/b",))
    got = rounds.crawl(spark, config, str(tmp_path / "r"), ask, max_rounds=1, render=render, parse=reader)
    ids = {r.url.removeprefix("https://site.test"): r.id for r in got.urls.collect()}
    status, facts = {r.url_id: r for r in got.responses.collect()}, {r.url_id: r for r in got.page_facts.collect()}
    a, b = status[ids["/a"]], status[ids["/b"]]
    assert (a.rendered, a.render_ms, a.js_errors, a.perf_ttfb_ms, a.perf_resources, a.static_words, a.rendered_words) == (1, 7, "e1\ne2", 3, 2, 2, 7)
    assert (b.rendered, b.render_ms, b.static_words) == (0, None, None) and facts[ids["/a"]].title == "Shown!" and facts[ids["/b"]].title == "B!"
    assert [(r.name, r.value) for r in got.extractions.orderBy("name").collect()] == [("a", "2"), ("z", "1")]


def test_natural_order_ink_and_cron_line(spark):
    from siteaudit.config import Schedule
    from siteaudit.functions import expressions as X
    from siteaudit.operators import shape

    names = ["b", "A10", "a9", "a2b", "a02", "Z", "10", "9", "a"]
    tree = spark.createDataFrame([(n, "/") for n in names] + [("x", "/y")], "label string, parent string")
    assert [r.label for r in shape.children(tree, "/").collect()] == ["9", "10", "a", "a02", "a2b", "a9", "A10", "b", "Z"]
    inks = spark.createDataFrame([(0,), (200,), (301,), (404,), (None,)], "s int").select(X.status_ink(F.col("s")).alias("i")).collect()
    assert [r.i for r in inks] == ["critical", None, "warning", "critical", None]
    assert Schedule("https://e.com/?a=1&b='2'", 3).line("/usr/bin/python3") == "0 3 * * * /usr/bin/python3 -m siteaudit crawl 'https://e.com/?a=1&b='\"'\"'2'\"'\"'' --replace"


def test_queue_is_a_base_and_changes(spark, tmp_path):
    """Rounds write what they change; a base counts once a commit names it, and old ones go."""
    from pyspark.sql import Row

    folder = rounds.Folder(spark, str(tmp_path))
    shape = "id long, url string, url_hash binary, host string, path string, depth int, is_internal int, discovered_at double, state int, redirect_hops int, check_only int, in_sitemap int, skip_reason string"
    rows = {i: 0 for i in range(40)}

    def table(ids):
        made = [Row(id=i, url=f"u{i}", url_hash=None, host="h", path="/", depth=0, is_internal=1, discovered_at=0.0, state=rows[i], redirect_hops=0, check_only=0, in_sitemap=0, skip_reason=None) for i in ids]
        return rounds.conform(spark.createDataFrame(made, shape), "urls")

    folder.start(table(rows), CONFIG)
    sizes, bases = [], set()
    for n in range(2, 9):
        changed = [(n * 7 + k) % 40 for k in range(10)]
        fresh = [100 + n]
        rows |= {i: n for i in changed} | {i: 0 for i in fresh}
        folder.write("urls", n, table(changed + fresh))
        # a base that no commit names, as of a round that broke off
        folder.write("base", n, table([0]))
        assert {r.id: r.state for r in folder.queue().collect()} != rows
        folder.finish(n, 10, 1, 11, 30, CONFIG)
        bases.add(folder.newest()["base"])
        sizes.append(spark.read.parquet(f"{tmp_path}/urls/round={n}").count())
        assert {r.id: r.state for r in folder.queue().collect()} == rows
    assert set(sizes) == {11} and len(bases) in (2, 3) and folder.newest()["queued"] == 30


def test_a_host_has_its_share_of_a_round():
    assert rounds.host_share(10_000, CrawlConfig("https://e.com/")) == 4000 and rounds.host_share(1, CrawlConfig("https://e.com/")) == 2
    assert rounds.host_share(100, CrawlConfig("https://e.com/", workers=4, max_per_host=4).clamped()) == 100
