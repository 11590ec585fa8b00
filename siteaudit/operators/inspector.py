"""Everything about one url, and search over page bodies."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.sources.crawl import Crawl

LIMIT, SEARCH_LIMIT, AROUND = 1000, 200, 60

#: label and expression over the wide view, in the order of the pane.
DETAIL = (
    ("Address", "url"), ("Status", "status"), ("Error", "error_kind"), ("Content Type", "content_type"), ("Indexability", "indexability"), ("Depth", "depth"), ("Inlinks", "inlinks"), ("Outlinks", "outlinks"), ("Size", "content_length"), ("Response Time", "response_time_ms"),
    ("Redirects To", "redirect_url"), ("Redirect Hops", "redirect_hops"), ("Title", "title"), ("Title Length", "title_length"), ("Title Pixels", "title_pixels"), ("Meta Description", "meta_description"), ("Description Length", "meta_description_length"), ("Description Pixels", "meta_description_pixels"),
    ("H1", "h1"), ("H2", "h2"), ("Canonical", "canonical_url"), ("Meta Robots", "meta_robots"), ("X-Robots-Tag", "x_robots_tag"), ("Language", "lang"), ("Word Count", "word_count"), ("Text Length", "text_length"), ("Content Hash", "lower(hex(substr(content_hash, 1, 8)))"),
    ("In Sitemap", "CASE WHEN in_sitemap = 1 THEN 'Yes' ELSE 'No' END"), ("Analytics", "analytics"), ("Hreflang", "hl_count"), ("Images", "image_count"),
)


def detail(pv: DataFrame, crawl: Crawl, url_id: int) -> DataFrame:
    """(position, label, value) of one url."""
    out = crawl.links.where(F.col("from_url_id") == url_id).agg(F.count("*").alias("outlinks"))
    img = crawl.images.where(F.col("url_id") == url_id).agg(F.count("*").alias("image_count"))
    row = pv.where(F.col("id") == url_id).join(F.broadcast(out), F.lit(True)).join(F.broadcast(img), F.lit(True))
    each = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("label"), F.expr(e).cast("string").alias("value")) for i, (n, e) in enumerate(DETAIL)]
    return row.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def _link_rows(crawl: Crawl, url_id: int, own: str, other: str) -> DataFrame:
    rows = crawl.links.where(F.col(own) == url_id).withColumnRenamed(other, "id").join(crawl.urls.select("id", "url"), "id")
    rows = rows.join(crawl.responses.select(F.col("url_id").alias("id"), "status"), "id", "left")
    return rows.select("id", "url", "anchor_text", "rel", "status", "position")


def inlinks(crawl: Crawl, url_id: int, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """The links to a url, the first ``limit`` by place and source, and how many there are."""
    rows = _link_rows(crawl, url_id, "to_url_id", "from_url_id")
    return rows.orderBy("position", "id").limit(limit), rows.count()


def outlinks(crawl: Crawl, url_id: int, limit: int = LIMIT) -> tuple[DataFrame, int]:
    rows = _link_rows(crawl, url_id, "from_url_id", "to_url_id")
    return rows.orderBy("position", "id").limit(limit), rows.count()


def images(crawl: Crawl, url_id: int, limit: int = LIMIT) -> tuple[DataFrame, int]:
    rows = crawl.images.where(F.col("url_id") == url_id).select(F.col("src_url_id").alias("id"), "alt").join(crawl.urls.select("id", "url"), "id")
    rows = rows.join(crawl.responses.select(F.col("url_id").alias("id"), "status", "content_length"), "id", "left").select("id", "url", "alt", "status", "content_length")
    return rows.orderBy("id", "alt").limit(limit), rows.count()


def headers(crawl: Crawl, url_id: int) -> DataFrame:
    """(name, value) of a response's headers by name."""
    entries = F.map_entries(F.from_json("headers_json", "map<string,string>"))
    return crawl.responses.where(F.col("url_id") == url_id).select(F.explode(F.array_sort(entries)).alias("e")).select(F.col("e.key").alias("name"), F.col("e.value").alias("value")).orderBy(F.lower("name"), "name")


def pattern(needle: str, is_regex: bool = False) -> re.Pattern | None:
    try:
        return re.compile(needle if is_regex else re.escape(needle), re.IGNORECASE) if needle else None
    except re.error:
        return None


def snippet(text: str, start: int, end: int, around: int = AROUND) -> str:
    """The match with what stands around it, white space collapsed."""
    lo, hi = max(0, start - around), min(len(text), end + around)
    return ("…" if lo else "") + " ".join(text[lo:hi].split()) + ("…" if hi < len(text) else "")


def unpack(body: bytes | None) -> str:
    """A retained body: raw DEFLATE, zlib and gzip are all read."""
    if not body:
        return ""
    for bits in (-15, 47):
        try:
            return zlib.decompress(body, bits).decode("utf-8", "replace")
        except zlib.error:
            continue
    return bytes(body).decode("utf-8", "replace")


def search(crawl: Crawl, needle: str, is_regex: bool = False, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(id, url, matches, snippet) of retained bodies that hold the needle, by id. An invalid
    pattern matches nothing."""
    shape = "id long, matches int, snippet string"
    bodies = crawl.responses.where("body_gz IS NOT NULL").select(F.col("url_id").alias("id"), "body_gz")
    found = pattern(needle, is_regex)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, body in zip(part["id"], part["body_gz"], strict=True):
                text = unpack(body)
                hits = list(found.finditer(text)) if found else []
                if hits:
                    rows.append((i, len(hits), snippet(text, *hits[0].span())))
            yield pd.DataFrame(rows, columns=["id", "matches", "snippet"])

    return bodies.mapInPandas(run, shape).join(crawl.urls.select("id", "url"), "id").orderBy("id").limit(limit).select("id", "url", "matches", "snippet")
