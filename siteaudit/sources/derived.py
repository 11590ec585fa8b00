"""A crawl derived from a table of raw pages.

The pages' own markup gives urls, titles, headings, languages and links; what the pages lack
(statuses, canonicals, images, metrics, ...) follows from the page ids by arithmetic, so that any
engine that speaks SQL derives the same crawl. The statements are templates: ``{sha256(x)}``,
``{bytes(x)}`` and ``{links}`` differ between engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.functions import expressions as X
from siteaudit.sources.crawl import Crawl
from siteaudit.sources.tables import numbered

_STATUS = "CASE WHEN page_id % 23 = 0 THEN 0 WHEN page_id % 19 = 0 THEN 500 WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 11 = 0 THEN 301 ELSE 200 END"
_SKIPPED = "CASE id % 25 WHEN 0 THEN 'blocked by robots.txt' WHEN 5 THEN 'excluded by URL filters' WHEN 10 THEN 'beyond max depth' WHEN 15 THEN 'URL cap reached' ELSE 'redirect chain too long' END"

#: (name, statement) in order of use.
STEPS: list[tuple[str, str]] = [
    ("dp", """SELECT page_id, page_id + 1 AS id, regexp_replace(url, '#.*$', '') AS url,
        lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
        replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '&quot;', '"') AS title,
        replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&'), '&quot;', '"') AS h1,
        regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, {bytes(html)} AS content_length, html FROM pages"""),
    ("dl0", "{links}"),
    ("dd", "SELECT 1000000 + row_number() OVER (ORDER BY to_url) AS id, to_url AS url FROM (SELECT DISTINCT to_url FROM dl0 l WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.url = l.to_url)) x"),
    ("prints", "{prints}"),
    ("urls", f"""SELECT id, url, host, path, page_id % 6 AS depth, CASE WHEN host LIKE '%.example.com' THEN 1 ELSE 0 END AS is_internal, CAST(page_id AS double) AS discovered_at, 2 AS state,
        CASE WHEN page_id % 37 = 0 THEN 2 ELSE 0 END AS redirect_hops, 0 AS check_only, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS in_sitemap, CAST(NULL AS string) AS skip_reason FROM dp
        UNION ALL SELECT id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), 2,
        CASE WHEN lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) LIKE '%.example.com' THEN 1 ELSE 0 END, CAST(id AS double), CASE WHEN id % 5 = 0 THEN 3 ELSE 0 END, 0, 0,
        CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END, CASE WHEN id % 5 = 0 THEN {_SKIPPED} END FROM dd
        UNION ALL SELECT DISTINCT 2000000 + page_id % 40, concat('https://img.example.com/i', CAST(page_id % 40 AS string), '.png'), 'img.example.com', concat('/i', CAST(page_id % 40 AS string), '.png'), 1, 1, 0.0, 2, 0, 1, 0, CAST(NULL AS string) FROM dp WHERE page_id % 4 = 0
        UNION ALL SELECT DISTINCT 3000000 + page_id % 15, concat('http://cdn.example.net/r', CAST(page_id % 15 AS string)), 'cdn.example.net', concat('/r', CAST(page_id % 15 AS string)), 1, 0, 0.0, 2, 0, 1, 0, CAST(NULL AS string) FROM dp WHERE page_id % 3 = 0"""),
    ("responses", f"""SELECT id AS url_id, {_STATUS} AS status, CASE WHEN page_id % 23 = 0 THEN 'timedOut' END AS error_kind, CASE WHEN page_id % 29 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
        content_length, page_id * 17 % 900 AS response_time_ms, CASE WHEN ({_STATUS}) = 301 THEN CASE WHEN page_id % 2 = 0 THEN id + 11 ELSE id - 11 END END AS redirect_target_id, CAST(page_id AS double) AS fetched_at,
        CASE page_id % 3 WHEN 1 THEN '{{"Strict-Transport-Security":"max-age=1","Set-Cookie":"a=b; Secure"}}' WHEN 2 THEN '{{"content-security-policy":"x","X-Frame-Options":"DENY","Set-Cookie":"a=b; HttpOnly; SameSite=Lax"}}' END AS headers_json,
        page_id % 2 AS rendered, CASE WHEN page_id % 2 = 1 THEN page_id * 37 % 5000 END AS render_ms, CASE WHEN page_id % 14 = 1 THEN 'TypeError: x' END AS js_errors, page_id % 400 AS rendered_words, page_id % 90 AS static_words,
        CASE WHEN page_id % 6 <> 5 THEN page_id * 13 % 1600 END AS perf_ttfb_ms, CASE WHEN page_id % 6 <> 5 THEN page_id * 19 % 3000 END AS perf_fcp_ms, page_id * 31 % 5000 AS perf_lcp_ms, page_id * 41 % 6000 AS perf_load_ms, page_id % 120 AS perf_resources FROM dp
        UNION ALL SELECT id, CASE WHEN id % 9 = 0 THEN 404 ELSE 200 END, CAST(NULL AS string), CASE WHEN id < 3000000 THEN 'image/png' ELSE 'text/css' END, id % 40 * 5000, 5, CAST(NULL AS bigint), 0.0, CAST(NULL AS string), 0, CAST(NULL AS bigint), CAST(NULL AS string), CAST(NULL AS bigint), CAST(NULL AS bigint), CAST(NULL AS bigint), CAST(NULL AS bigint), CAST(NULL AS bigint), CAST(NULL AS bigint), CAST(NULL AS bigint) FROM urls WHERE id >= 2000000"""),
    ("page_facts", """SELECT id AS url_id, title, length(title) AS title_length, CASE WHEN page_id % 33 = 0 THEN 2 ELSE 1 END AS title_count,
        CASE WHEN page_id % 5 = 0 THEN NULL ELSE substring(title, 1, 12) END AS meta_description, CASE WHEN page_id % 5 = 0 THEN NULL ELSE length(substring(title, 1, 12)) + page_id % 150 END AS meta_description_length, CASE WHEN page_id % 5 = 0 THEN 0 WHEN page_id % 34 = 1 THEN 2 ELSE 1 END AS meta_description_count,
        h1, CASE WHEN page_id % 21 = 0 THEN 2 ELSE 1 END AS h1_count, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN substring(h1, 1, 3) ELSE concat(h1, h1) END AS h2, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END AS h2_count,
        CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 17 = 0 THEN id + 1 ELSE id END AS canonical_id, CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 27 = 0 THEN 2 ELSE 1 END AS canonical_count,
        CASE WHEN page_id % 31 = 0 THEN 'noindex, follow' WHEN page_id % 43 = 0 THEN 'nofollow, NOARCHIVE' END AS meta_robots, CASE WHEN page_id % 62 = 0 THEN 'index' WHEN page_id % 47 = 0 THEN 'noindex' END AS x_robots_tag, lang,
        page_id * 7 % 600 * CASE WHEN page_id % 25 = 0 THEN 0 ELSE 1 END AS word_count, content_length - content_length % 10 - page_id % 20 * 100 AS text_length, {sha256(CASE WHEN page_id % 16 < 2 THEN 'same' ELSE title END)} AS content_hash,
        CASE WHEN page_id % 3 = 0 THEN title WHEN page_id % 3 = 1 THEN 'Other' END AS og_title, CASE WHEN page_id % 2 = 0 THEN 'd' END AS og_description, CASE WHEN page_id % 4 = 1 THEN '/og.png' WHEN page_id % 4 = 2 THEN ' ' END AS og_image, CASE WHEN page_id % 5 = 1 THEN 'article' END AS og_type,
        CASE WHEN page_id % 3 = 2 THEN 'summary' END AS twitter_card, CASE WHEN page_id % 22 = 3 THEN '/amp' END AS amphtml, CASE WHEN page_id % 15 BETWEEN 2 AND 4 THEN '/prev' END AS rel_prev, CASE WHEN page_id % 15 BETWEEN 1 AND 3 THEN '/next' END AS rel_next,
        CASE WHEN page_id % 8 <> 0 THEN 'Matomo' END AS analytics, length(title) * 9 AS title_pixels, CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id * 7 % 1400 END AS meta_description_pixels,
        CASE WHEN page_id % 50 <> 49 THEN simhash END AS simhash FROM dp LEFT JOIN (SELECT id AS print_id, simhash FROM prints) x ON print_id = id"""),
    ("links", """SELECT l.from_url_id, t.id AS to_url_id, CASE l.position % 4 WHEN 0 THEN 'Click here' WHEN 1 THEN '' WHEN 2 THEN l.href ELSE 'Plain words' END AS anchor_text, CAST(NULL AS string) AS rel, 1 AS is_internal, l.position
        FROM dl0 l JOIN urls t ON t.url = l.to_url"""),
    ("images", "SELECT id AS url_id, 2000000 + page_id % 40 AS src_url_id, CASE page_id % 12 WHEN 0 THEN NULL WHEN 4 THEN '' ELSE repeat('alt ', CAST(page_id % 40 AS int)) END AS alt, CASE WHEN page_id % 8 = 0 THEN NULL ELSE 100 + page_id % 50 END AS width, 80 AS height FROM dp WHERE page_id % 4 = 0"),
    ("hreflang", "SELECT id AS url_id, CASE WHEN page_id % 4 = 0 THEN 'X-Default' ELSE 'en' END AS lang, CASE WHEN page_id % 18 = 1 THEN id + 2 WHEN page_id % 6 = 0 THEN id + 1 ELSE id - 1 END AS href_url_id FROM dp WHERE page_id % 6 < 2"),
    ("structured_data", """SELECT id AS url_id, 'json-ld' AS format, 'Article' AS type FROM dp WHERE page_id % 2 = 0 UNION ALL SELECT id, 'microdata', 'Product' FROM dp WHERE page_id % 10 = 0
        UNION ALL SELECT id, 'rdfa', 'Person' FROM dp WHERE page_id % 35 = 0"""),
    ("extractions", "SELECT id AS url_id, 'price' AS name, CAST(page_id AS string) AS value, 0 AS position FROM dp WHERE page_id % 9 = 0 UNION ALL SELECT id, 'sku', CAST(page_id AS string), 1 FROM dp WHERE page_id % 18 = 0"),
    ("resources", "SELECT id AS url_id, 3000000 + page_id % 15 AS src_url_id, CASE WHEN page_id % 2 = 0 THEN 'css' ELSE 'js' END AS kind FROM dp WHERE page_id % 3 = 0"),
    ("external_metrics", """SELECT id AS url_id, 'gsc' AS source, 'Clicks' AS metric, CAST(page_id % 3 AS double) AS value, CAST(NULL AS string) AS text FROM dp WHERE page_id % 4 = 0
        UNION ALL SELECT id, 'gsc', 'Impressions', CAST(page_id % 300 AS double), CAST(NULL AS string) FROM dp WHERE page_id % 4 = 0 UNION ALL SELECT id, 'gsc', 'Position', page_id % 30 + 0.5, CAST(NULL AS string) FROM dp WHERE page_id % 4 = 0
        UNION ALL SELECT id, 'ga4', 'Sessions', CAST(page_id % 7 AS double), CAST(NULL AS string) FROM dp WHERE page_id % 5 = 0 UNION ALL SELECT id, 'pagespeed', 'CWV Assessment', CAST(NULL AS double), CASE WHEN page_id % 2 = 0 THEN 'SLOW' ELSE 'FAST' END FROM dp WHERE page_id % 7 = 0
        UNION ALL SELECT id, 'pagespeed', 'Lighthouse Performance', CAST(page_id % 100 AS double), CAST(NULL AS string) FROM dp WHERE page_id % 7 = 0"""),
    ("crawl_meta", "SELECT 1 AS id, min(url) AS seed_url FROM dp"),
]

_LINKS = {
    "spark": "SELECT dp.id AS from_url_id, t.position, t.href, concat(dp.origin, t.href) AS to_url FROM dp LATERAL VIEW posexplode(regexp_extract_all(dp.html, '<a href=\"([^\"]*)\"', 1)) t AS position, href",
    "duckdb": "SELECT id AS from_url_id, i - 1 AS position, l[i] AS href, concat(origin, l[i]) AS to_url FROM (SELECT id, origin, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, origin, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM dp) a) b",
}

#: What of a page is no text.
_MARKUP = "(?s)<script.*?</script>|<style.*?</style>|<[^>]*>"
_PRINTS = {
    "spark": "",
    "duckdb": """SELECT t.id, CASE WHEN f.p >= 9223372036854775808 THEN (f.p - 18446744073709551616)::bigint ELSE f.p::bigint END AS simhash FROM dp t LEFT JOIN (
        SELECT id, sum(CASE WHEN vote > 0 THEN 1::hugeint << bit::int ELSE 0 END) AS p FROM (
            SELECT id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS vote FROM (
                SELECT id, ('0x' || substr(unnest(list_transform(range(1, len(ws) - 1), lambda i: sha256(concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])))), 1, 16))::ubigint AS h FROM (
                    SELECT id, list_filter(regexp_split_to_array(lower(regexp_replace(html, '""" + _MARKUP + """', ' ', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM dp) w WHERE len(ws) >= 3) s,
                (SELECT unnest(range(64))::ubigint AS bit) b GROUP BY id, bit) v GROUP BY id) f ON f.id = t.id""",
}


def statement(sql: str, dialect: str) -> str:
    sha, size = ("sha2(\\1, 256)", "octet_length(\\1)") if dialect == "spark" else ("sha256(\\1)", "strlen(\\1)")
    sql = re.sub(r"\{sha256\((.*?)\)\}", sha, sql)
    sql = re.sub(r"\{bytes\((.*?)\)\}", size, sql)
    sql = sql.replace("{links}", _LINKS[dialect]).replace("{prints}", _PRINTS[dialect]).replace("{{", "{").replace("}}", "}")
    # DuckDB's concat leaves NULLs out: a page without an url has links, one without html an empty second heading
    return sql.replace("concat(", "concat_ws('', ") if dialect == "spark" else re.sub(r"\bAS string\b", "AS varchar", sql)


def ctes(dialect: str) -> str:
    """All steps as the body of a WITH clause."""
    return ",\n".join(f"{name} AS {"MATERIALIZED " if dialect == "duckdb" else ""}({statement(sql, dialect)})" for name, sql in STEPS)


def derive(spark: SparkSession, pages: DataFrame, keep=lambda name, df: df) -> Crawl:
    """The crawl's tables as DataFrames. ``keep(name, df)`` may write a step that later ones read."""
    frames: dict[str, DataFrame] = {"pages": pages}
    for name, sql in STEPS:
        if name == "dd":
            new = frames["dl0"].select(F.col("to_url").alias("url")).distinct().join(frames["dp"].select("url"), "url", "left_anti")
            frames[name] = keep(name, numbered(new, "url", "discovered", 1_000_001).select("id", "url"))
            continue
        if name == "prints":
            frames[name] = keep(name, X.simhashes(frames["dp"].select("id", F.regexp_replace("html", _MARKUP, " ").alias("text")), "id", "text"))
            continue
        text = statement(sql, "spark")
        used = {n: f for n, f in frames.items() if re.search(rf"\b(FROM|JOIN) {n}\b", text)}
        body = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m, used=used: f"{m[1]} {{{m[2]}}} {m[2]}" if m[2] in used else m[0], text.replace("{", "{{").replace("}", "}}"))
        body = re.sub(r"(\{\w+\}) \w+ (l|t) (JOIN|ON)\b", r"\1 \2 \3", body)
        frames[name] = spark.sql(body, **used)
        if name in ("dl0", "urls"):
            frames[name] = keep(name, frames[name])
    tables = {n: f for n, f in frames.items() if n in {"crawl_meta", "urls", "responses", "page_facts", "links", "images", "hreflang", "structured_data", "extractions", "resources", "external_metrics"}}
    bands = tables["page_facts"].where("simhash IS NOT NULL").selectExpr("url_id", "simhash")
    tables["simhash_bands"] = bands.withColumn("b", X.bands(bands["simhash"])).selectExpr("url_id", "inline(b)")
    return Crawl.of(spark, **tables)
