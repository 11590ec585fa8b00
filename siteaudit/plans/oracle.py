"""The wide view over the derived crawl as DuckDB SQL, with joins and sums of its own. The filters of the
reports are in ``second``."""

from __future__ import annotations

from siteaudit.sources.derived import ctes

_GENERIC = "'click here', 'here', 'read more', 'more', 'link', 'this', 'learn more', 'find out more', 'continue', 'details', 'go', 'download', 'click'"
_ANCHOR = "trim(lower(coalesce(l.anchor_text, '')))"


def _grouped(table: str, key: str, **what: str) -> str:
    return f"(SELECT l.{key} AS id, {', '.join(f'{e} AS {n}' for n, e in what.items())} FROM {table} GROUP BY 1)"


def _when(c: str) -> str:
    return f"count(*) FILTER (WHERE {c})"


_SIDES = [
    _grouped("links l", "to_url_id", inlinks="count(DISTINCT l.from_url_id)", anchor_empty=_when(f"{_ANCHOR} = ''"), anchor_generic=_when(f"{_ANCHOR} IN ({_GENERIC})"), distinct_anchors=f"count(DISTINCT {_ANCHOR})"),
    _grouped("images l", "src_url_id", img_refs="count(*)", img_noalt=_when("l.alt IS NULL OR trim(l.alt) = ''"), img_longalt=_when("length(l.alt) > 100"), img_nodims=_when("l.width IS NULL OR l.height IS NULL")),
    _grouped("resources l", "src_url_id", res_pages="count(DISTINCT l.url_id)", res_css=_when("l.kind = 'css'"), res_js=_when("l.kind = 'js'")),
    _grouped("hreflang l LEFT JOIN (SELECT DISTINCT url_id, href_url_id FROM hreflang) h2 ON h2.url_id = l.href_url_id AND h2.href_url_id = l.url_id LEFT JOIN responses r2 ON r2.url_id = l.href_url_id", "url_id", hl_count="count(*)", hl_noreturn=_when("h2.url_id IS NULL"), hl_non200=_when("r2.status IS DISTINCT FROM 200"), hl_xdefault=_when("lower(l.lang) = 'x-default'")),
    _grouped("structured_data l", "url_id", sd_rows="count(*)", sd_kinds="count(DISTINCT l.format)", sd_jsonld=_when("l.format = 'json-ld'"), sd_microdata=_when("l.format = 'microdata'"), sd_rdfa=_when("l.format = 'rdfa'")),
    _grouped("extractions l", "url_id", ext_count="count(*)"), _grouped("external_metrics l", "url_id", has_gsc="max(CASE WHEN l.source = 'gsc' THEN 1 ELSE 0 END)", metric_count="count(*)"),
]
_NUMBERS = "inlinks anchor_empty anchor_generic distinct_anchors img_refs img_noalt img_longalt img_nodims res_pages res_css res_js hl_count hl_noreturn hl_non200 hl_xdefault sd_rows sd_kinds sd_jsonld sd_microdata sd_rdfa ext_count has_gsc metric_count".split()
_SUMMED = "sides AS MATERIALIZED (SELECT b.id, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in _NUMBERS) + " FROM urls b " + " ".join(f"LEFT JOIN {g} s{i} ON s{i}.id = b.id" for i, g in enumerate(_SIDES)) + ")"
_VALUES = ("title", "meta_description", "h1", "h2", "content_hash")


def _some(v: str) -> str:
    return f"length(g.{v}) > 0" if v == "content_hash" else f"trim(g.{v}) <> ''"


_DUPLICATES = " ".join(f"LEFT JOIN (SELECT g.{v} AS v, count(*) AS n FROM full_rows g WHERE g.is_internal = 1 AND g.status = 200 AND {_some(v)} GROUP BY 1) d_{v} ON d_{v}.v = b.{v}" for v in _VALUES)
_FLAGS = ", ".join(f"coalesce(d_{v}.n > CASE WHEN b.is_internal = 1 AND b.status = 200 THEN 1 ELSE 0 END, false) AS dup_{v}" for v in _VALUES)

_VIEW = f"""full_rows AS MATERIALIZED (SELECT u.*, r.* EXCLUDE (url_id), f.* EXCLUDE (url_id) FROM urls u LEFT JOIN responses r ON r.url_id = u.id LEFT JOIN page_facts f ON f.url_id = u.id),
{_SUMMED},
near AS MATERIALIZED (SELECT b.id, count(*) AS near_count, bool_or(g.is_internal = 1 AND g.status = 200 AND g.content_hash IS DISTINCT FROM b.content_hash) AS near_duplicate
  FROM full_rows b JOIN full_rows g ON g.id <> b.id AND bit_count(xor(g.simhash::bigint, b.simhash::bigint)) <= 7 GROUP BY b.id),
laddered AS MATERIALIZED (SELECT b.*, s.* EXCLUDE (id), coalesce(n.near_count, 0) AS near_count, coalesce(n.near_duplicate, false) AS near_duplicate, (SELECT min(seed_url) FROM crawl_meta) AS seed_url, json_extract_string(b.headers_json, '$."Set-Cookie"') AS set_cookie,
  coalesce(b.content_type ILIKE 'text/html%', false) AS is_html, c.status AS canonical_status,
  coalesce(b.redirect_target_id = b.id OR r2.redirect_target_id = b.id, false) AS redirect_loop, NOT (src.id IS NOT NULL AND s.inlinks = 0) AS visible, {_FLAGS},
  coalesce(b.url ILIKE 'http://%' AND t1.url IS NOT NULL, false) AS https_twin, t2.url IS NOT NULL AS slash_twin, t3.host IS NOT NULL AS www_twin,
  CASE WHEN b.status IS NULL THEN 'Not crawled' WHEN b.status BETWEEN 300 AND 399 THEN 'Non-indexable: redirected' WHEN b.status BETWEEN 400 AND 499 THEN 'Non-indexable: client error' WHEN b.status = 0 OR b.status >= 500 THEN 'Non-indexable: server error'
  WHEN concat(coalesce(b.meta_robots, ''), ' ', coalesce(b.x_robots_tag, '')) ILIKE '%noindex%' THEN 'Non-indexable: noindex' WHEN b.canonical_id <> b.id THEN 'Non-indexable: canonicalised' ELSE 'Indexable' END AS indexability
  FROM full_rows b JOIN sides s ON s.id = b.id LEFT JOIN near n ON n.id = b.id LEFT JOIN responses c ON c.url_id = b.canonical_id LEFT JOIN responses r2 ON r2.url_id = b.redirect_target_id
  LEFT JOIN (SELECT src_url_id AS id FROM images UNION SELECT src_url_id FROM resources) src ON src.id = b.id LEFT JOIN (SELECT DISTINCT url FROM urls) t1 ON t1.url = concat('https://', substr(b.url, 8))
  LEFT JOIN (SELECT DISTINCT url FROM urls WHERE is_internal = 1) t2 ON t2.url = CASE WHEN b.url LIKE '%/' THEN substr(b.url, 1, length(b.url) - 1) ELSE concat(b.url, '/') END
  LEFT JOIN (SELECT DISTINCT host FROM urls WHERE is_internal = 1) t3 ON t3.host = CASE WHEN b.host LIKE 'www.%' THEN substr(b.host, 5) ELSE concat('www.', b.host) END {_DUPLICATES}),
metric_maps AS MATERIALIZED (SELECT url_id, map(list(concat(source, '|', metric)), list(value)) AS m_value, map(list(concat(source, '|', metric)), list(text)) AS m_text FROM external_metrics GROUP BY url_id),
pv AS MATERIALIZED (SELECT laddered.*, m_value, m_text, check_only = 0 AND visible AS page_row, indexability NOT IN ('Indexable', 'Not crawled') AS non_indexable, coalesce(is_internal = 1 AND status = 200 AND is_html AND check_only = 0 AND visible, false) AS html_page FROM laddered LEFT JOIN metric_maps mm ON mm.url_id = laddered.id)"""


def with_view(select: str) -> str:
    return f"WITH {ctes('duckdb')},\n{_VIEW}\n{select}"


def with_crawl(select: str) -> str:
    return f"WITH {ctes('duckdb')}\n{select}"
