"""What changed between two crawls. Urls are the same where their hashes are. Both sides of each join have
rows in the number of urls, so they are shuffled and merged at any size: none passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.functions import expressions as X
from siteaudit.sources.crawl import Crawl

FIELDS = (("Status", "status"), ("Title", "title"), ("Meta Description", "meta_description"), ("H1", "h1"), ("Indexability", "indexability"), ("Canonical", "canonical_url"))


def _facts(crawl: Crawl) -> DataFrame:
    f, r, u = crawl.page_facts, crawl.responses, crawl.urls
    rows = u.select("id", "url", "url_hash").join(r.select(F.col("url_id").alias("id"), "status").hint("merge"), "id", "left")
    rows = rows.join(f.select(F.col("url_id").alias("id"), "title", "meta_description", "h1", "canonical_id", "meta_robots", "x_robots_tag").hint("merge"), "id", "left")
    rows = rows.join(u.select(F.col("id").alias("canonical_id"), F.col("url").alias("canonical_url")).hint("merge"), "canonical_id", "left")
    label = X.indexability(F.col("status"), F.col("meta_robots"), F.col("x_robots_tag"), F.col("canonical_id"), F.col("id"))
    return rows.withColumn("indexability", label).withColumn("crawled", F.col("status").isNotNull())


def _only_in(a: Crawl, b: Crawl) -> DataFrame:
    crawled = a.responses.select(F.col("url_id").alias("id"))
    return a.urls.join(crawled.hint("merge"), "id", "left_semi").join(b.urls.select("url_hash").hint("merge"), "url_hash", "left_anti").select("url")


def added(now: Crawl, before: Crawl) -> DataFrame:
    """Urls with a response now that the crawl before had not heard of."""
    return _only_in(now, before)


def removed(now: Crawl, before: Crawl) -> DataFrame:
    return _only_in(before, now)


def changes(now: Crawl, before: Crawl) -> DataFrame:
    """(url, field, before, after) in one pass: both sides are joined once, then compared field by
    field. NULL and a value differ, NULL and NULL do not."""
    old = _facts(before).select("url_hash", F.col("crawled").alias("was_crawled"), *[F.col(c).cast("string").alias(f"old_{c}") for _, c in FIELDS])
    both = _facts(now).join(old.hint("merge"), "url_hash").where("crawled OR was_crawled")
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"old_{c}").alias("before"), F.col(c).cast("string").alias("after")) for n, c in FIELDS])
    return both.select("url", F.explode(F.filter(each, lambda e: ~e["before"].eqNullSafe(e["after"]))).alias("e")).select("url", "e.*")


def compare(now: Crawl, before: Crawl, limit: int | None = 500) -> dict[str, DataFrame]:
    """Added, removed and changed urls in url order, at most ``limit`` of each, and their true numbers."""
    full = {"added": added(now, before), "removed": removed(now, before), "changes": changes(now, before)}
    order = {"added": ["url"], "removed": ["url"], "changes": ["url", "field"]}
    out = {k: df.orderBy(*order[k]) if limit is None else df.orderBy(*order[k]).limit(limit) for k, df in full.items()}
    totals = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in full.items()]
    return out | {"totals": totals[0].union(totals[1]).union(totals[2])}
