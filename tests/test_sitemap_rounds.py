"""Sitemaps that list sitemaps, against a plain walk."""

import gzip

from pyspark.sql import functions as F

from siteaudit.sources import http, sitemaps


def index(*locs):
    return ("<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>").encode()


def listing(*locs):
    return ("<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>").encode()


WEB = {
    "a": index("b", "gone", "c", "a", "b"), "b": listing("u1", "u2", "u1"), "c": index("d", "a", "e"), "d": gzip.compress(listing("u3", "u2")), "e": b"\x1f\x8bbroken", "z": listing("u9") + index("d"),
}


def plain(starting, most):
    todo, seen, urls, asked = list(dict.fromkeys(starting)), set(starting), {}, []
    while todo and (most is None or len(asked) < most):
        level, todo = todo, []
        for at in level[: None if most is None else most - len(asked)]:
            body = WEB.get(at)
            if at == "e":
                body = None
            asked.append((at, body is None))
            if body is not None:
                got = sitemaps.parse(body)
                for u in got.urls:
                    urls.setdefault(u, at)
                todo += [s for s in got.sitemaps if s not in seen and not seen.add(s)]
    return urls, asked


def ask(url, method):
    body = WEB.get(url)
    return {"status": 200 if body is not None else 404, "body": body}


def run(spark, starting, most):
    table = spark.createDataFrame([(u, i) for i, u in enumerate(starting)], "url string, ordinal long")
    urls, asked = sitemaps.expand(table, sitemaps.asked(ask), most)
    return [tuple(r) for r in urls.orderBy("ordinal").select("url", "sitemap").collect()], [tuple(r) for r in asked.orderBy("ordinal").select("url", "failed").collect()]


def test_rounds_agree_with_a_plain_walk(spark):
    for starting, most in ((["a"], None), (["a", "z", "a"], None), (["a", "z"], 3), (["z", "a"], 5), (["a"], 1), (["gone"], 2), ([], 4), (["a"], 0)):
        urls, asked = run(spark, starting, most)
        expected, said = plain(starting, most)
        assert (urls, asked) == (list(expected.items()), said), (starting, most)


def test_fifty_documents_of_many_entries(spark):
    """The documents are made where they are asked for, and only counts come back."""

    def large(url, method):
        n = int(url)
        return http.answer(url, 200, {"Content-Type": "text/xml"}, index(*range(1, 50)) if n == 0 else listing(*(f"https://site.test/{n}/{i}" for i in range(50_010 if n == 7 else 2000))), method, 1)

    urls, asked = sitemaps.expand(spark.createDataFrame([("0", 0)], "url string, ordinal long"), sitemaps.asked(large), 50)
    assert asked.count() == 50 and urls.count() == 48 * 2000 + 50_000 and urls.agg(F.countDistinct("sitemap")).first()[0] == 49
