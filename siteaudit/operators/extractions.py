"""Rows for the extractions table, and which urls robots rules keep out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.config import ExtractionRule
from siteaudit.functions.extraction import extract
from siteaudit.functions.robots import Policy
from siteaudit.sources.crawl import Crawl

SHAPE = "url_id long, name string, value string, position int"


def from_pages(pages: DataFrame, rules: Sequence[ExtractionRule]) -> DataFrame:
    """What the rules find in (url_id, html)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *found) for i, html in zip(part["url_id"], part["html"], strict=True) for found in extract(html, rules)]
            yield pd.DataFrame(rows, columns=["url_id", "name", "value", "position"])

    return pages.select("url_id", "html").mapInPandas(run, SHAPE)


def from_headers(crawl: Crawl, names: Sequence[str]) -> DataFrame:
    """Headers by name, whatever its case, of the pages that have facts."""
    wanted = [n.lower() for n in names]
    held = F.map_filter(F.from_json("headers_json", "map<string,string>"), lambda k, v: F.lower(k).isin(*wanted) & (F.trim(v) != ""))
    rows = crawl.responses.join(crawl.page_facts.select("url_id"), "url_id", "left_semi").where("headers_json IS NOT NULL")
    return rows.select("url_id", F.explode(F.map_entries(held)).alias("e")).select("url_id", F.col("e.key").alias("name"), F.col("e.value").alias("value"), F.lit(0).alias("position"))


def keep_out(urls: DataFrame, policy: Policy, agent: str) -> DataFrame:
    """Internal urls that the seed host's rules forbid (id). External ones are not asked about."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = [urlsplit(u) for u in part["url"]]
            ok = [policy.allows((p.path or "/") + (f"?{p.query}" if p.query else ""), agent) for p in at]
            yield pd.DataFrame({"id": part["id"][[not x for x in ok]]})

    return urls.where("is_internal = 1").select("id", "url").mapInPandas(run, "id long")
