"""A crawl in a few numbers, its overview, and how far along it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.operators.reports import findings
from siteaudit.schema import DONE, IN_FLIGHT, QUEUED
from siteaudit.sources.crawl import Crawl

_HTML = "status = 200 AND is_html"


def summary(pv: DataFrame, crawl: Crawl) -> DataFrame:
    """(metric, value). Titles, descriptions and headings count as missing when NULL or empty, but
    not when they hold spaces only, unlike the reports' filters."""
    seen = pv.where("visible")
    one = seen.agg(
        F.count("*").alias("totalURLs"),
        F.count_if(F.expr("is_internal = 1")).alias("internalURLs"),
        F.count_if(F.expr("is_internal = 0")).alias("externalURLs"),
    )
    two = pv.agg(
        F.count_if(F.expr("status = 0")).alias("transportErrors"),
        *[F.count_if(F.expr(f"{_HTML} AND ({c} IS NULL OR {c} = '')")).alias(n) for c, n in (("title", "missingTitles"), ("meta_description", "missingDescriptions"), ("h1", "missingH1"))],
        F.coalesce(F.max(F.expr("CASE WHEN status IS NOT NULL THEN depth END")), F.lit(0)).cast("bigint").alias("maxDepth"),
    )
    doubled = pv.where(f"{_HTML} AND title IS NOT NULL AND title <> ''").groupBy("title").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicateTitles"))
    alt = crawl.images.agg(F.count_if(F.expr("alt IS NULL OR alt = ''")).alias("imagesMissingAlt"))
    parts = []
    for df in (one, two, doubled, alt):
        parts.append(df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns])).alias("e")).select("e.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def status_classes(crawl: Crawl) -> DataFrame:
    """Responses by the hundreds of their status; transport errors have none."""
    return crawl.responses.where("status > 0").groupBy(F.expr("cast(status div 100 AS int)").alias("class")).agg(F.count("*").alias("n"))


def queue_counts(crawl: Crawl) -> DataFrame:
    s = F.col("state")
    return crawl.urls.agg(F.count_if(s == QUEUED).alias("queued"), F.count_if(s == IN_FLIGHT).alias("in_flight"), F.count_if(s == DONE).alias("done"), F.count("*").alias("total"))


def overview(pv: DataFrame, crawl: Crawl, counted: DataFrame) -> DataFrame:
    """(section, item, value): the crawl, its urls and responses, then the findings that occur."""
    meta = crawl.crawl_meta.where("id = 1").select(F.lit("Crawl").alias("section"), F.explode(F.array(
        F.struct(F.lit("Seed").alias("item"), F.col("seed_url").alias("value")),
        *[F.struct(F.lit(n).alias("item"), F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value")) for n, c in (("Started", "started_at"), ("Finished", "finished_at"))])).alias("e")).select("section", "e.*")
    totals = summary(pv, crawl).where("metric IN ('totalURLs', 'internalURLs', 'externalURLs')").select(F.lit("URLs").alias("section"), F.col("metric").alias("item"), F.col("value").cast("string").alias("value"))
    codes = status_classes(crawl).select(F.lit("Responses").alias("section"), F.concat(F.col("class").cast("string"), F.lit("xx")).alias("item"), F.col("n").cast("string").alias("value"))
    found = findings(counted).select(F.concat(F.lit("Findings: "), F.col("severity")).alias("section"), F.concat_ws(": ", "report", "filter").alias("item"), F.col("n").cast("string").alias("value"))
    return meta.unionByName(totals).unionByName(codes).unionByName(found)


def blocked_by_robots(crawl: Crawl) -> bool:
    """Whether the crawl found nothing because robots rules kept it out."""
    if not crawl.responses.isEmpty():
        return False
    return not crawl.urls.where("skip_reason = 'blocked by robots.txt'").isEmpty()
