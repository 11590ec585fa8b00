"""Metrics of other services: their answers as (url, source, metric, value, text) rows, and the
run that asks for them batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.operators.frontier import latest
from siteaudit.sources.crawl import Crawl

#: Urls that one request may ask for.
BATCH = {"pagespeed": 1, "gsc": 25_000, "ga4": 25_000, "ahrefs": 1, "majestic": 100, "moz": 50}
SHAPE = "url string, source string, metric string, value double, text string"
Row = tuple[str, str, str, float | None, str | None]


def number(node, *path) -> float | None:
    """The number at a path, also one written as text."""
    for p in path:
        node = node[p] if isinstance(node, list) and isinstance(p, int) and p < len(node) else node.get(p) if isinstance(node, dict) else None
    try:
        return None if node is None or isinstance(node, bool) else float(node)
    except (TypeError, ValueError):
        return None


def _keep(url: str, source: str, pairs) -> list[Row]:
    return [(url, source, m, v, None) for m, v in pairs if v is not None]


def pagespeed(url: str, body: dict) -> list[Row]:
    lab, field = body.get("lighthouseResult") or {}, body.get("loadingExperience") or {}
    score = lambda c: None if (v := number(lab, "categories", c, "score")) is None else v * 100
    audit = lambda a: number(lab, "audits", a, "numericValue")
    out = _keep(url, "pagespeed", [("Lighthouse Performance", score("performance")), ("Lighthouse SEO", score("seo")), ("Lighthouse Accessibility", score("accessibility")), ("Lab LCP", audit("largest-contentful-paint")), ("Lab FCP", audit("first-contentful-paint")), ("Lab CLS", audit("cumulative-layout-shift")), ("Lab TBT", audit("total-blocking-time")), ("Lab Speed Index", audit("speed-index"))])
    for name, key, scale in (("CWV LCP", "LARGEST_CONTENTFUL_PAINT_MS", 1), ("CWV INP", "INTERACTION_TO_NEXT_PAINT", 1), ("CWV CLS", "CUMULATIVE_LAYOUT_SHIFT_SCORE", 100), ("CWV FCP", "FIRST_CONTENTFUL_PAINT_MS", 1), ("CWV TTFB", "EXPERIMENTAL_TIME_TO_FIRST_BYTE", 1)):
        if (v := number(field, "metrics", key, "percentile")) is not None:
            out.append((url, "pagespeed", name, v / scale, ((field.get("metrics") or {}).get(key) or {}).get("category")))
    if isinstance(field.get("overall_category"), str):
        out.append((url, "pagespeed", "CWV Assessment", None, field["overall_category"]))
    return out


def search_console(body: dict, wanted: set[str] | None = None) -> list[Row]:
    out: list[Row] = []
    for r in body.get("rows") or []:
        url = (r.get("keys") or [None])[0]
        if url and (wanted is None or url in wanted):
            out += _keep(url, "gsc", [("Clicks", number(r, "clicks")), ("Impressions", number(r, "impressions")), ("CTR", number(r, "ctr")), ("Position", number(r, "position"))])
    return out


def analytics(body: dict, by_path: dict[str, str]) -> list[Row]:
    out: list[Row] = []
    for r in body.get("rows") or []:
        path = ((r.get("dimensionValues") or [{}])[0]).get("value")
        if url := by_path.get(path):
            out += _keep(url, "ga4", [(m, number(r, "metricValues", i, "value")) for i, m in enumerate(("Sessions", "Users", "Page views"))])
    return out


def ahrefs(url: str, body: dict) -> list[Row]:
    node = body.get("metrics") or body
    return _keep(url, "ahrefs", [(m, number(node, k)) for m, k in (("Backlinks", "backlinks"), ("Referring domains", "refdomains"), ("URL rating", "url_rating"), ("Domain rating", "domain_rating"), ("Organic traffic", "org_traffic"))])


def majestic(body: dict) -> list[Row]:
    items = ((body.get("DataTables") or {}).get("Results") or {}).get("Data") or []
    return [x for d in items if d.get("Item") for x in _keep(d["Item"], "majestic", [(m, number(d, k)) for m, k in (("Trust flow", "TrustFlow"), ("Citation flow", "CitationFlow"), ("Backlinks", "ExtBackLinks"), ("Referring domains", "RefDomains"))])]


def moz(urls: list[str], body: dict) -> list[Row]:
    """Results name their page; those that do not stand in the order asked for."""
    return [x for u, d in zip(urls, body.get("results") or [], strict=False) for u in [d.get("page") or u] for x in _keep(u, "moz", [(m, number(d, k)) for m, k in (("Page authority", "page_authority"), ("Domain authority", "domain_authority"), ("Spam score", "spam_score"), ("Linking domains", "root_domains_to_page"))])]


def urls_to_enrich(crawl: Crawl, limit: int) -> DataFrame:
    """Internal html pages with status 200, in order of id."""
    pages = crawl.urls.where("is_internal = 1 AND check_only = 0").join(crawl.responses.where("status = 200 AND content_type ILIKE 'text/html%'").select(F.col("url_id").alias("id")), "id", "left_semi")
    return pages.orderBy("id").limit(limit).select("id", "url")


def enrich(urls: DataFrame, source: str, ask: Callable[[list[str]], list[Row]]) -> DataFrame:
    """Ask for all urls, ``BATCH`` at a time; a batch that fails gives one row that says so (metric
    NULL, the error as text) and the run goes on."""
    size = BATCH[source]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), size):
                batch = part["url"].iloc[lo : lo + size].tolist()
                try:
                    rows = ask(batch)
                except Exception as e:  # noqa: BLE001  whatever a service does wrong ends its batch only
                    rows = [(batch[0], source, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["url", "source", "metric", "value", "text"])

    return urls.select("url").mapInPandas(run, SHAPE)


def upsert_metrics(crawl: Crawl, rows: DataFrame) -> DataFrame:
    """The metrics table with these rows in place of older ones; urls that are not known are dropped."""
    new = rows.where("metric IS NOT NULL").join(crawl.urls.select("url", F.col("id").alias("url_id")), "url").select("url_id", "source", "metric", "value", "text")
    both = crawl.external_metrics.withColumn("at", F.lit(0)).unionByName(new.withColumn("at", F.lit(1)))
    return latest(both, ["url_id", "source", "metric"], "at").drop("at")


def from_json_lines(lines: DataFrame, source: str) -> DataFrame:
    """Rows of saved answers (url, body as JSON text)."""
    readers = {"pagespeed": lambda u, b: pagespeed(u, b), "gsc": lambda u, b: search_console(b), "ahrefs": lambda u, b: ahrefs(u, b), "majestic": lambda u, b: majestic(b), "moz": lambda u, b: moz([u], b), "ga4": lambda u, b: analytics(b, {u.split("://", 1)[-1].partition("/")[1] + u.split("://", 1)[-1].partition("/")[2]: u})}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for u, b in zip(part["url"], part["body"], strict=True):
                try:
                    rows += readers[source](u, json.loads(b))
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["url", "source", "metric", "value", "text"])

    return lines.select("url", "body").mapInPandas(run, SHAPE)
