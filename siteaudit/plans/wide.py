"""The wide view: one row a url, with everything that reports look at.

``urls`` is joined once with the responses and facts; every side table is first summed up to one
row a url, so that no join multiplies rows. All of it is equi-joins on url ids or values; blank
values and NULL hashes are left out before they could meet in one group.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions import expressions as X
from siteaudit.sources.crawl import Crawl
from siteaudit.sources.tables import written


def _joined_list(c: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def _links(crawl: Crawl) -> DataFrame:
    anchor = F.trim(F.lower(F.coalesce("anchor_text", F.lit(""))))
    links = crawl.links.withColumn("norm", anchor)
    summed = links.groupBy(F.col("to_url_id").alias("id")).agg(
        F.count_distinct("from_url_id").alias("inlinks"),
        F.count_if(F.col("norm") == "").alias("anchor_empty"),
        F.count_if(F.col("norm").isin(*X.GENERIC_ANCHORS)).alias("anchor_generic"),
        F.count_distinct("norm").alias("distinct_anchors"),
    )
    # blank anchors are a group like others: a page linked mostly by images has no top anchor
    counted = links.groupBy(F.col("to_url_id").alias("id"), "norm").agg(F.count("*").alias("n"), F.min("anchor_text").alias("anchor"))
    top = counted.groupBy("id").agg(F.min(F.struct(-F.col("n"), "anchor")).alias("t")).select("id", F.col("t.anchor").alias("top_anchor"))
    return summed.join(top, "id", "left")


def _images(crawl: Crawl) -> DataFrame:
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    return crawl.images.groupBy(F.col("src_url_id").alias("id")).agg(
        F.count("*").alias("img_refs"),
        F.count_if(X.blank(F.col("alt"))).alias("img_noalt"),
        F.count_if(F.length("alt") > 100).alias("img_longalt"),
        F.count_if(~sized).alias("img_nodims"),
        F.min_by(F.when(sized, F.concat(F.col("width"), F.lit(" x "), F.col("height"))), F.struct(~sized, "url_id", "width", "height")).alias("img_dims"),
    )


def _resources(crawl: Crawl) -> DataFrame:
    return crawl.resources.groupBy(F.col("src_url_id").alias("id")).agg(
        F.count_distinct("url_id").alias("res_pages"), F.min("kind").alias("res_kind"), F.count_if(F.col("kind") == "css").alias("res_css"), F.count_if(F.col("kind") == "js").alias("res_js"))


def _hreflang(crawl: Crawl, every: DataFrame) -> DataFrame:
    h, status = crawl.hreflang, crawl.responses.select(F.col("url_id").alias("href_url_id"), "status")
    back = every.select(F.col("href_url_id").alias("url_id"), F.col("url_id").alias("href_url_id")).distinct().withColumn("returned", F.lit(True))
    return h.join(back, ["url_id", "href_url_id"], "left").join(status, "href_url_id", "left").groupBy(F.col("url_id").alias("id")).agg(
        F.count("*").alias("hl_count"),
        F.count_if(F.col("returned").isNull()).alias("hl_noreturn"),
        F.count_if(F.col("status").isNull() | (F.col("status") != 200)).alias("hl_non200"),
        F.count_if(F.lower("lang") == "x-default").alias("hl_xdefault"),
    )


def _structured(crawl: Crawl) -> DataFrame:
    return crawl.structured_data.groupBy(F.col("url_id").alias("id")).agg(
        F.count("*").alias("sd_rows"), F.count_distinct("format").alias("sd_kinds"), _joined_list(F.col("format")).alias("sd_formats"), _joined_list(F.col("type")).alias("sd_types"),
        *[F.count_if(F.col("format") == f).alias(a) for f, a in (("json-ld", "sd_jsonld"), ("microdata", "sd_microdata"), ("rdfa", "sd_rdfa"))])


def _extractions(crawl: Crawl) -> DataFrame:
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("name", "position", "value"))), 1, 5), lambda x: x["value"])
    return crawl.extractions.groupBy(F.col("url_id").alias("id")).agg(F.count("*").alias("ext_count"), _joined_list(F.col("name")).alias("ext_names"), F.array_join(first, " | ").alias("ext_values"))


def _metrics(crawl: Crawl) -> DataFrame:
    entry = F.struct(F.concat_ws("|", "source", "metric").alias("key"), F.struct("value", "text").alias("value"))
    # of repeated rows of one metric the greater counts: a map takes a key once only
    once = crawl.external_metrics.groupBy("url_id", "source", "metric").agg(F.max(F.struct("value", "text")).alias("m")).select("url_id", "source", "metric", "m.value", "m.text")
    return once.groupBy(F.col("url_id").alias("id")).agg(F.map_from_entries(F.collect_list(entry)).alias("metrics"), F.max(F.when(F.col("source") == "gsc", 1)).alias("has_gsc"))


#: (blocks, how many of them agree for up to seven bits): one of 8, two of 9, three of 10.
NEAR_KEYS = ((8, 1), (9, 2), (10, 3))


def near_keys(fp: Column, blocks: int, agree: int) -> Column:
    """One key for each choice of ``agree`` of so many bit blocks: the choice and the blocks' bits."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(ends, ends[1:], strict=False)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(t).cast("long")
        for c in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(parts[c])
        keys.append(key)
    return F.array(*keys)


def near_fingerprints(prints: DataFrame, threshold: int = X.NEAR, keys: tuple[int, int] | None = None, of: DataFrame | None = None) -> DataFrame:
    """(a, c) both ways, equal ones included: distinct values of ``simhash`` at most ``threshold``
    bits apart; with ``of`` (simhash) only those with such an a. Of ``blocks`` bit blocks at most ``threshold`` differ, so the equi-join on the blocks that
    must agree loses nothing. More blocks give more and longer keys: the more fingerprints there are,
    the longer, so that few meet by chance (n squared over 32, 455 or 5,000)."""
    own = prints.where("simhash IS NOT NULL").select("simhash").distinct()
    if keys is None:
        n = own.count()
        keys = NEAR_KEYS[0 if n < 50_000 else 1 if n < 1_000_000 else 2]
    blocks, agree = keys
    if not 0 <= threshold <= blocks - agree:
        raise ValueError("so few blocks guarantee no such distance")

    def keyed(values: DataFrame, name: str) -> DataFrame:
        return values.select(F.col("simhash").alias(name), F.explode(near_keys(F.col("simhash"), blocks, agree)).alias("b"))

    left = own if of is None else of.where("simhash IS NOT NULL").select("simhash").distinct()
    met = keyed(left, "a").join(keyed(own, "c"), "b").where(X.hamming(F.col("a"), F.col("c")) <= threshold)
    if of is not None:
        return met.select("a", "c").distinct()
    near = met.where("a <= c").select("a", "c").distinct()
    return near.union(near.where("a <> c").select("c", "a"))


def _printed(base: DataFrame) -> DataFrame:
    return base.where("simhash IS NOT NULL").select("id", "simhash", F.coalesce(F.hex("content_hash"), F.lit("")).alias("hash"), ((F.col("is_internal") == 1) & (F.coalesce("status", F.lit(-1)) == 200)).alias("fine"))


def print_groups(base: DataFrame) -> DataFrame:
    """One row a fingerprint: its pages, least and greatest content of its internal pages with status 200."""
    fine_hash = F.when(F.col("fine"), F.col("hash"))
    return _printed(base).groupBy(F.col("simhash").alias("c")).agg(F.count("*").alias("n"), F.min(fine_hash).alias("low"), F.max(fine_hash).alias("high"))


def near_pages(base: DataFrame, threshold: int = X.NEAR, rows: DataFrame | None = None) -> DataFrame:
    """(id, near_count, near_duplicate): how many other pages are near, and whether one of them is an
    internal page with status 200 and another content. Pages meet as groups of one fingerprint,
    never as pairs, so a large group of copies costs no more than its rows. ``rows`` are those of ``base``
    that are asked for, if not all."""
    pages = _printed(base if rows is None else rows)
    around = near_fingerprints(base, threshold, of=rows).join(print_groups(base), "c").groupBy(F.col("a").alias("simhash")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    differs = F.coalesce((F.col("low") != F.col("hash")) | (F.col("high") != F.col("hash")), F.lit(False))
    return pages.join(around, "simhash").select("id", (F.col("n") - 1).alias("near_count"), differs.alias("near_duplicate"))


VALUES = ("title", "meta_description", "h1", "h2", "content_hash")


def _value(name: str) -> Column:
    """What pages can have in common, as text; NULL if it is blank."""
    c = F.hex(name) if name == "content_hash" else F.col(name)
    return F.when(F.length(F.trim(c)) > 0, c)


def _each(pairs: list[tuple[str, Column]]) -> Column:
    return F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in pairs]), lambda e: e["key"].isNotNull()))


def held_keys(base: DataFrame) -> DataFrame:
    """(id, kind, key): what a row counts for when others ask who has the same."""
    inside = F.col("is_internal") == 1
    fine = inside & (F.col("status") == 200)
    pairs = [(v, F.when(fine, _value(v))) for v in VALUES] + [("same", F.hex("content_hash")), ("https", F.col("url")), ("slash", F.when(inside, F.col("url"))), ("www", F.when(inside, F.col("host")))]
    return base.select("id", _each(pairs).alias("e")).select("id", "e.kind", "e.key")


def asked_keys(base: DataFrame) -> DataFrame:
    """(id, kind, key): what a row asks for: its values, its content, its twin urls and host."""
    url, host = F.col("url"), F.col("host")
    pairs = [(v, _value(v)) for v in VALUES] + [
        ("same", F.hex("content_hash")),
        ("https", F.when(url.ilike("http://%"), F.concat(F.lit("https://"), F.expr("substr(url, 8)")))),
        ("slash", F.when(url.endswith("/"), F.expr("substr(url, 1, length(url) - 1)")).otherwise(F.concat(url, F.lit("/")))),
        ("www", F.when(host.startswith("www."), F.expr("substr(host, 5)")).otherwise(F.concat(F.lit("www."), host))),
    ]
    return base.select("id", _each(pairs).alias("e")).select("id", "e.kind", "e.key")


def _shared(base: DataFrame, rows: DataFrame | None) -> DataFrame:
    """One row an id: how many internal pages with status 200 have each of its values, how many pages its
    content, and whether its twin urls and host exist. All of it is one join of narrow rows (kind, key),
    so that the wide row is not moved for any of it. With ``rows`` only the keys they ask for are counted."""
    asked, held = asked_keys(base if rows is None else rows), held_keys(base)
    if rows is not None:
        held = held.join(asked.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    counted = held.groupBy("kind", "key").agg(F.count("*").alias("n"))
    met = asked.join(counted, ["kind", "key"])
    return met.groupBy("id").agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"n_{k}") for k in (*VALUES, "same", "https", "slash", "www")])


def _targets(base: DataFrame, rows: DataFrame) -> DataFrame:
    """One row an id: url and status of its canonical, url and onward target of its redirect."""
    ends = base.select(F.col("id").alias("target"), F.col("url").alias("t_url"), F.col("status").alias("t_status"), F.col("redirect_target_id").alias("t_next"))
    kinds = ("canonical_id", "redirect_target_id")
    asked = rows.select("id", F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("target")) for k in kinds]), lambda e: e["target"].isNotNull())).alias("e")).select("id", "e.kind", "e.target")
    one = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    return asked.join(ends, "target").groupBy("id").agg(one("canonical_id", "t_url").alias("canonical_url"), one("canonical_id", "t_status").alias("canonical_status"), one("redirect_target_id", "t_url").alias("redirect_url"), one("redirect_target_id", "t_next").alias("redirect_back_id"))


COUNTS = ("inlinks", "anchor_empty", "anchor_generic", "distinct_anchors", "img_refs", "img_noalt", "img_longalt", "img_nodims", "res_pages", "res_css", "res_js", "hl_count", "hl_noreturn", "hl_non200", "hl_xdefault", "sd_rows", "sd_kinds", "sd_jsonld", "sd_microdata", "sd_rdfa", "ext_count", "has_gsc", "near_count")


#: Which column of a side table names the row of the view that it adds to.
_SIDES = {"links": "to_url_id", "images": "src_url_id", "resources": "src_url_id", "hreflang": "url_id", "structured_data": "url_id", "extractions": "url_id", "external_metrics": "url_id"}


def base_rows(crawl: Crawl) -> DataFrame:
    """Urls with their responses and facts, written once."""
    responses, facts = crawl.responses, crawl.page_facts
    return written(crawl.urls.join(responses.withColumnRenamed("url_id", "id").drop("body_gz"), "id", "left").join(facts.withColumnRenamed("url_id", "id"), "id", "left"), "base")


def wide_view(crawl: Crawl, of: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """The view of a crawl. What duplicates, near pages and the view itself start from is written once
    (``base``, if it is there already). Everything that joins it has one row an id, so that the wide row is
    moved once. ``of`` (id) restricts the view: the side tables are then filtered before they are summed,
    and of the other urls only what these ask for is read."""
    base = base_rows(crawl) if base is None else base
    every = crawl.hreflang
    if of is not None:
        crawl = Crawl(crawl.spark, dict(crawl.tables) | {n: crawl.tables[n].join(of.select(F.col("id").alias(c)), c, "left_semi") for n, c in _SIDES.items()})
    rows = base if of is None else base.join(of.select("id"), "id", "left_semi")
    asked = None if of is None else rows
    # urls known only as the source of an image or resource are not shown
    used = crawl.images.select(F.col("src_url_id").alias("id")).union(crawl.resources.select(F.col("src_url_id").alias("id"))).distinct()
    linked = crawl.links.select(F.col("to_url_id").alias("id")).distinct()
    hidden = used.join(linked, "id", "left_anti").withColumn("hidden", F.lit(True))
    sides = [_links(crawl), _images(crawl), _resources(crawl), _hreflang(crawl, every), _structured(crawl), _extractions(crawl), _metrics(crawl), hidden, _targets(base, rows), _shared(base, asked), near_pages(base, rows=asked)]
    pv = reduce(lambda df, side: df.join(side, "id", "left"), sides, rows)

    eligible = F.when((F.col("is_internal") == 1) & (F.col("status") == 200), 1).otherwise(0)
    pv = pv.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS} | {"near_duplicate": F.coalesce("near_duplicate", F.lit(False))} | {f"{k}_twin": F.col(f"n_{k}").isNotNull() for k in ("https", "slash", "www")})
    pv = pv.withColumns({f"dup_{v}": F.coalesce(F.col(f"n_{v}") - eligible > 0, F.lit(False)) for v in VALUES})
    pv = pv.withColumns({
        "same_content": F.coalesce(F.col("n_same") - 1, F.lit(0)),
        "visible": F.col("hidden").isNull(),
        "is_html": X.is_html(F.col("content_type")),
        "indexability": X.indexability(F.col("status"), F.col("meta_robots"), F.col("x_robots_tag"), F.col("canonical_id"), F.col("id")),
        "redirect_loop": F.coalesce((F.col("redirect_target_id") == F.col("id")) | (F.col("redirect_back_id") == F.col("id")), F.lit(False)),
        "set_cookie": F.get_json_object("headers_json", "$['Set-Cookie']"),
    })
    pv = pv.withColumns({"page_row": (F.col("check_only") == 0) & F.col("visible"), "non_indexable": X.non_indexable(F.col("indexability"))})
    pv = pv.withColumn("html_page", F.coalesce((F.col("is_internal") == 1) & (F.col("status") == 200) & F.col("is_html") & F.col("page_row"), F.lit(False)))
    seed = crawl.crawl_meta.where("id = 1").agg(F.max("seed_url").alias("seed_url"))  # one row
    return pv.join(F.broadcast(seed), F.lit(True), "left").drop("hidden", *[f"n_{k}" for k in (*VALUES, "same", "https", "slash", "www")])
