"""Tables of a crawl snapshot. Missing columns of older snapshots read as NULL, or as the default
given here where the column may not be NULL."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_DDL = {
    "crawl_meta": "id int, seed_url string, started_at double, finished_at double, config_json string, schema_version int",
    "urls": "id bigint, url string, url_hash binary, host string, path string, depth int, is_internal int, discovered_at double, state int, redirect_hops int, check_only int, in_sitemap int, skip_reason string",
    "responses": "url_id bigint, status int, error_kind string, content_type string, content_length bigint, response_time_ms int, redirect_target_id bigint, fetched_at double, body_gz binary, headers_json string, rendered int, render_ms int, js_errors string, rendered_words int, static_words int, perf_ttfb_ms int, perf_fcp_ms int, perf_lcp_ms int, perf_dcl_ms int, perf_load_ms int, perf_resources int",
    "page_facts": "url_id bigint, title string, title_length int, title_count int, meta_description string, meta_description_length int, meta_description_count int, h1 string, h1_count int, h2 string, h2_count int, canonical_id bigint, canonical_count int, meta_robots string, x_robots_tag string, lang string, word_count int, text_length int, content_hash binary, og_title string, og_description string, og_image string, og_type string, twitter_card string, twitter_title string, twitter_image string, amphtml string, rel_prev string, rel_next string, analytics string, title_pixels int, meta_description_pixels int, simhash bigint",
    "links": "from_url_id bigint, to_url_id bigint, anchor_text string, rel string, is_internal int, position int",
    "images": "url_id bigint, src_url_id bigint, alt string, width int, height int",
    "hreflang": "url_id bigint, lang string, href_url_id bigint",
    "structured_data": "url_id bigint, format string, type string",
    "extractions": "url_id bigint, name string, value string, position int",
    "resources": "url_id bigint, src_url_id bigint, kind string",
    "simhash_bands": "url_id bigint, band int, value int",
    "external_metrics": "url_id bigint, source string, metric string, value double, text string",
}
_TYPES = {"int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "string": StringType(), "binary": BinaryType()}
#: Built without a session, which ``StructType.fromDDL`` would need.
SCHEMAS: dict[str, StructType] = {name: StructType([StructField(n, _TYPES[t]) for n, t in (c.split(" ") for c in ddl.split(", "))]) for name, ddl in _DDL.items()}
#: Columns that older snapshots lack and that are never NULL.
DEFAULTS = {
    "urls": {"redirect_hops": 0, "check_only": 0, "in_sitemap": 0},
    "responses": {"rendered": 0},
    "page_facts": {"title_count": 0, "meta_description_count": 0, "h1_count": 0, "h2_count": 0, "canonical_count": 0, "word_count": 0},
}
#: States of a url in the queue.
QUEUED, IN_FLIGHT, DONE, SKIPPED = range(4)
