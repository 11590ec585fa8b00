"""Sitemaps: the urls of a url set and the parts of an index, followed in rounds of DataFrame steps."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.sources.tables import numbered, written

MAX_ENTRIES, MAX_SITEMAPS = 50_000, 50
#: A location, by its local name, with its text up to the next tag; CDATA is text.
_PART = re.compile(r"<!--.*?-->|<(?P<end>/?)(?:[\w.-]+:)?(?P<tag>sitemap|url|loc)\b[^>]*?(?P<self>/?)>|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[^>]*>|(?P<text>[^<]+)", re.DOTALL)


@dataclass
class Sitemap:
    urls: list[str] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)


def parse(data: bytes | str, limit: int = MAX_ENTRIES) -> Sitemap:
    """What a document lists, up to ``limit`` of each kind. Of a document that breaks off, what
    came before counts."""
    if isinstance(data, bytes):
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        data = data.decode("utf-8", "replace")
    out, inside, loc = Sitemap(), None, None
    for m in _PART.finditer(data):
        if m["tag"]:
            tag, end = m["tag"], bool(m["end"])
            if tag == "loc":
                if not end and not m["self"]:
                    loc = ""
                elif end and loc is not None:
                    found = out.sitemaps if inside == "sitemap" else out.urls
                    if inside and loc.strip() and len(found) < limit:
                        found.append(loc.strip())
                    loc = None
            else:
                inside = None if end else tag
        elif loc is not None:
            loc += m["cdata"] if m["cdata"] is not None else unescape(m["text"] or "")
    return out


#: What a round of answers gives: a body of null stands for a sitemap that failed.
ANSWERS = "url string, body binary"
_FOUND = "parent string, failed boolean, kind string, loc string, position int"


def asked(ask: Callable[[str, str], dict]) -> Callable[[DataFrame], DataFrame]:
    """Answers to (url) by ``ask(url, method)``, on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for url in part["url"]:
                got = ask(url, "GET")
                yield pd.DataFrame({"url": [url], "body": [(got.get("body") or b"") if got["status"] == 200 else None]})

    # a document a task: they are few and may be large
    return lambda todo: todo.repartition(max(1, min(MAX_SITEMAPS, int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "url").select("url").mapInPandas(run, ANSWERS)


def _listed(answers: DataFrame, limit: int) -> DataFrame:
    """What each answer lists, in its order; one row without a ``kind`` says whether it failed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for url, body in zip(part["url"], part["body"], strict=True):
                try:
                    got = None if body is None else parse(bytes(body), limit)
                except (OSError, EOFError, zlib.error):  # not what its first bytes say
                    got = None
                yield pd.DataFrame([(url, got is None, None, None, -1)], columns=["parent", "failed", "kind", "loc", "position"])
                for kind, locs in (("url", got.urls), ("sitemap", got.sitemaps)) if got else ():
                    for lo in range(0, len(locs), 10_000):
                        some = locs[lo : lo + 10_000]
                        yield pd.DataFrame({"parent": url, "failed": False, "kind": kind, "loc": some, "position": range(lo, lo + len(some))})

    return answers.mapInPandas(run, _FOUND)


def _place(max_entries: int) -> Column:
    """Entries of sitemaps in the order in which they were asked for and list them."""
    return F.col("ordinal") * (max_entries + 1) + F.col("position")


def expand(starting: DataFrame, answers: Callable[[DataFrame], DataFrame], max_sitemaps: int | None = MAX_SITEMAPS, max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(url, sitemap, ordinal) of every url that the sitemaps ``starting`` (url, ordinal) and those that they list
    lead to, each with the first sitemap that lists it, and (url, failed, ordinal) of the sitemaps that
    were asked for. Breadth first: a round asks for all sitemaps of a level that were not asked for before, up
    to ``max_sitemaps`` in all; ``answers`` makes (url, body) of (url). Sitemaps that list each other are asked
    for once. Only counts reach the driver."""
    todo = starting.where("url IS NOT NULL").groupBy("url").agg(F.min("ordinal").alias("ordinal"))
    seen, parts, done = None, [], 0
    while max_sitemaps is None or done < max_sitemaps:
        # the places of a round follow those of the rounds before it
        ranked = numbered(todo.select("url", F.struct("ordinal", "url").alias("key")), "key", "sitemap-order", done + 1, "ordinal").drop("key")
        now = written(ranked if max_sitemaps is None else ranked.where(F.col("ordinal") <= max_sitemaps), "sitemap-round")
        n = now.count()
        if not n:
            break
        found = written(_listed(answers(now.select("url")), max_entries).join(now.withColumnRenamed("url", "parent"), "parent"), "sitemap-found")
        parts.append(found)
        done += n
        seen = now.select("url") if seen is None else written(seen.unionByName(now.select("url")), "sitemap-seen")
        todo = found.where("kind = 'sitemap'").groupBy(F.col("loc").alias("url")).agg(F.min(_place(max_entries)).alias("ordinal")).join(seen, "url", "left_anti")
    spark = starting.sparkSession
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{_FOUND}, ordinal long")
    urls = every.where("kind = 'url'").groupBy(F.col("loc").alias("url")).agg(F.min(F.struct(_place(max_entries).alias("ordinal"), "parent")).alias("p")).select("url", F.col("p.parent").alias("sitemap"), "p.ordinal")
    return urls, every.where("kind IS NULL").select(F.col("parent").alias("url"), "failed", "ordinal")
