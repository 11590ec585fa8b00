"""From fetched pages to the tables of a crawl.

Pages are parsed once, in Arrow batches; what they found is kept as nested columns, written, and
then exploded into the link, image and other tables. References get their ids by joining on the hash
of the normalised url, never by a driver-side map."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteaudit.functions import expressions as X
from siteaudit.functions.html_facts import Facts, parse
from siteaudit.functions.serp import width
from siteaudit.functions.urls import host_and_path, normalise, url_hash
from siteaudit.sources.crawl import Crawl
from siteaudit.sources.tables import bound_batches, written

_REFS = "array<struct<kind:string,hash:binary,url:string,host:string,path:string,text:string,rel:string,position:int,width:int,height:int>>"
PARSED = f"""given string, url string, url_hash binary, host string, path string, title string, title_count int, meta_description string, meta_description_count int, h1 string, h1_count int, h2 string, h2_count int,
canonical_count int, meta_robots string, lang string, amphtml string, rel_prev string, rel_next string, og_title string, og_description string, og_image string, og_type string, twitter_card string, twitter_title string, twitter_image string,
analytics string, word_count int, text_length int, content_hash binary, visible_text string, title_length int, meta_description_length int, title_pixels int, meta_description_pixels int, content_length long,
structured array<struct<format:string,type:string>>, refs {_REFS}"""


def _ref(kind: str, href: str, base: str, position: int, text=None, rel=None, w=None, h=None) -> dict | None:
    url = normalise(href, base)
    if url is None:
        return None
    host, path = host_and_path(url)
    return {"kind": kind, "hash": url_hash(url), "url": url, "host": host, "path": path, "text": text, "rel": rel, "position": position, "width": w, "height": h}


def read_page(url: str, html: str | None, reader: Callable[[str | None], Facts] = parse) -> dict | None:
    at = normalise(url)
    if at is None:
        return None
    f = reader(html)
    base = normalise(f.base, at) or at if f.base else at
    refs = [_ref("link", x["href"], base, x["position"], x["anchor_text"], x["rel"]) for x in f.links]
    refs += [_ref("image", x["src"], base, i, x["alt"], None, x["width"], x["height"]) for i, x in enumerate(f.images)]
    refs += [_ref("hreflang", x["href"], base, i, x["lang"]) for i, x in enumerate(f.hreflang)]
    refs += [_ref("resource", x["href"], base, i, x["kind"]) for i, x in enumerate(f.resources)]
    refs += [_ref("canonical", f.canonical, base, 0)] if f.canonical else []
    host, path = host_and_path(at)
    names = {"og:title": "og_title", "og:description": "og_description", "og:image": "og_image", "og:type": "og_type", "twitter:card": "twitter_card", "twitter:title": "twitter_title", "twitter:image": "twitter_image"}
    same = ("title", "title_count", "meta_description", "meta_description_count", "h1", "h1_count", "h2", "h2_count", "canonical_count", "meta_robots", "lang", "amphtml", "rel_prev", "rel_next", "word_count", "text_length", "content_hash")
    return {
        "given": url, "url": at, "url_hash": url_hash(at), "host": host, "path": path, **{k: getattr(f, k) for k in same}, **{v: f.social.get(k) for k, v in names.items()}, "analytics": ", ".join(f.analytics) or None, "visible_text": f.text,
        "title_length": None if f.title is None else len(f.title), "meta_description_length": None if f.meta_description is None else len(f.meta_description), "title_pixels": width(f.title, 20), "meta_description_pixels": width(f.meta_description, 14),
        "content_length": len((html or "").encode("utf-8", "surrogatepass")), "structured": f.structured_data, "refs": [r for r in refs if r],
    }


def parse_pages(pages: DataFrame, reader: Callable[[str | None], Facts] = parse) -> DataFrame:
    """Parsed rows of (url, html) by any ``reader`` of html; a url that is none gives no row."""
    names = pages.sparkSession.createDataFrame([], PARSED).columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 200):
                rows = [r for u, h in zip(part["url"][lo : lo + 200], part["html"][lo : lo + 200], strict=True) if (r := read_page(u, h, reader))]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    bound_batches(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(run, PARSED)


#: What ``page_facts`` gives of each page beside its key.
FACTS = "title string, title_count int, meta_description string, h1 string, h1_count int, h2 string, h2_count int, canonical string, meta_robots string, lang string, links int, images int, hreflang int, resources int, structured int, analytics string, word_count int, text_length int, content_hash string"


def page_facts(pages: DataFrame, key: str = "page_id", reader: Callable[[str | None], Facts] = parse) -> DataFrame:
    """Facts of every row's html by themselves, whatever its url: ``key`` and the columns of ``FACTS``. Null html is
    an empty page."""
    schema = f"__key {pages.schema[key].dataType.simpleString()}, {FACTS}"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    counted = ("links", "images", "hreflang", "resources")

    def row(own, html: str | None) -> list:
        f = reader(html)
        more = {"__key": own, "structured": len(f.structured_data), "analytics": ", ".join(f.analytics) or None, "content_hash": f.content_hash.hex(), **{c: len(getattr(f, c)) for c in counted}}
        return [more[n] if n in more else getattr(f, n) for n in names]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 200):
                own = part.iloc[lo : lo + 200]
                yield pd.DataFrame([row(k, h) for k, h in zip(own["__key"], own["html"], strict=True)], columns=names, dtype=object)

    bound_batches(pages.sparkSession)
    return pages.select(F.col(key).alias("__key"), "html").mapInPandas(run, schema).withColumnRenamed("__key", key)


def ingest(spark: SparkSession, pages: DataFrame, seed_url: str) -> Crawl:
    """A crawl snapshot of fetched pages (url, html, and, where known, status, content_type and
    headers_json). The first row of a url counts. Ids go by order of the urls."""
    extra = [c for c in ("status", "content_type", "headers_json", "response_time_ms") if c in pages.columns]
    parsed = written(parse_pages(pages).dropDuplicates(["url_hash"]), "parsed")
    seed = normalise(seed_url) or seed_url
    seed_host = host_and_path(seed)[0]
    refs = parsed.select(F.col("url_hash").alias("from_hash"), F.explode("refs").alias("r")).select("from_hash", "r.*")
    known = parsed.select("url_hash", "url", "host", "path").withColumn("crawled", F.lit(1)).unionByName(refs.select(F.col("hash").alias("url_hash"), "url", "host", "path").withColumn("crawled", F.lit(0)))
    flat = known.groupBy("url_hash").agg(F.first("url").alias("url"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("crawled").alias("crawled"))
    ordered = written(flat.repartitionByRange("url").sortWithinPartitions("url").withColumn("part", F.spark_partition_id()), "known")
    sizes = ordered.groupBy("part").count().orderBy("part").collect()
    bases, n = [], 0
    for r in sizes:
        bases.append((r["part"], n))
        n += r["count"]
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    urls = ordered.join(base, "part").withColumn("id", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("url")))
    kinds = refs.groupBy(F.col("hash").alias("url_hash")).agg(F.min(F.when(F.col("kind").isin("image", "resource"), 1).otherwise(0)).alias("only_source"))
    urls = urls.join(kinds, "url_hash", "left")
    inside = F.col("host") == seed_host
    urls = written(urls.select("id", "url", "url_hash", "host", "path", F.when(F.col("url") == seed, 0).otherwise(1).alias("depth"), inside.cast("int").alias("is_internal"), F.when(F.col("crawled") == 1, 2).otherwise(0).alias("state"),
                               F.when((F.col("crawled") == 0) & ((F.col("only_source") == 1) | ~inside), 1).otherwise(0).alias("check_only")), "urls")
    ids = urls.select("url_hash", "id")
    edges = refs.join(ids.withColumnRenamed("id", "to_id").withColumnRenamed("url_hash", "hash"), "hash").join(ids.withColumnRenamed("id", "from_id").withColumnRenamed("url_hash", "from_hash"), "from_hash")
    edges = written(edges.join(urls.select(F.col("id").alias("to_id"), "is_internal"), "to_id").select("from_id", "to_id", "kind", "text", "rel", "position", "width", "height", "is_internal"), "edges")
    of = lambda kind: edges.where(F.col("kind") == kind)
    page = parsed.join(ids, "url_hash")
    canonical = of("canonical").select(F.col("from_id").alias("id"), F.col("to_id").alias("canonical_id"))
    facts = page.join(canonical, "id", "left").join(X.simhashes(page, "id", "visible_text"), "id", "left").withColumnRenamed("id", "url_id")
    answers = page.select(F.col("id").alias("url_id"), "content_length", "given")
    if extra:  # parsing has said which page a url was written for
        answers = answers.join(pages.select(F.col("url").alias("given"), *extra).dropDuplicates(["given"]), "given", "left")
    answers = answers.withColumns({"status": F.coalesce("status", F.lit(200)) if "status" in extra else F.lit(200), "content_type": F.coalesce("content_type", F.lit("text/html")) if "content_type" in extra else F.lit("text/html")})
    facts = written(facts, "facts")
    return Crawl.of(
        spark, urls=urls, responses=answers, page_facts=facts,
        crawl_meta=spark.createDataFrame([(1, seed)], "id int, seed_url string"),
        links=of("link").select(F.col("from_id").alias("from_url_id"), F.col("to_id").alias("to_url_id"), F.col("text").alias("anchor_text"), "rel", "is_internal", "position"),
        images=of("image").select(F.col("from_id").alias("url_id"), F.col("to_id").alias("src_url_id"), F.col("text").alias("alt"), "width", "height"),
        hreflang=of("hreflang").select(F.col("from_id").alias("url_id"), F.col("text").alias("lang"), F.col("to_id").alias("href_url_id")),
        resources=of("resource").select(F.col("from_id").alias("url_id"), F.col("to_id").alias("src_url_id"), F.col("text").alias("kind")),
        structured_data=page.select(F.col("id").alias("url_id"), F.explode("structured").alias("s")).select("url_id", "s.format", "s.type"),
        simhash_bands=facts.where("simhash IS NOT NULL").select("url_id", F.explode(X.bands(F.col("simhash"))).alias("b")).select("url_id", "b.band", "b.value"),
    )
