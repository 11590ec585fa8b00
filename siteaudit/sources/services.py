"""Requests to the services whose metrics ``providers`` reads, and how they are sent."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta
from urllib.parse import quote, urlencode, urlsplit

from siteaudit.sources import providers
from siteaudit.sources.providers import Row

#: Days that a report of visits or clicks covers.
WINDOW_DAYS = 28


@dataclass(frozen=True)
class Credentials:
    pagespeed_key: str = ""
    google_client_id: str = ""
    google_client_secret: str = ""
    google_refresh_token: str = ""
    search_console_site: str = ""
    analytics_property: str = ""
    ahrefs_token: str = ""
    majestic_key: str = ""
    moz_access_id: str = ""
    moz_secret_key: str = ""


#: What each service cannot be asked without.
_GOOGLE = ("google_client_id", "google_client_secret", "google_refresh_token")
NEEDED = {"pagespeed": (), "gsc": (*_GOOGLE, "search_console_site"), "ga4": (*_GOOGLE, "analytics_property"), "ahrefs": ("ahrefs_token",), "majestic": ("majestic_key",), "moz": ("moz_access_id", "moz_secret_key")}


class ServiceError(Exception):
    pass


@dataclass(frozen=True)
class Request:
    url: str
    body: bytes | None = None
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 30


Send = Callable[[Request], dict]


def send(request: Request) -> dict:
    """The answer's JSON object; anything else is an error that says what came."""
    try:
        with urllib.request.urlopen(urllib.request.Request(request.url, request.body, request.headers), timeout=request.timeout) as r:
            found = json.loads(r.read())
    except urllib.error.HTTPError as e:
        raise ServiceError(f"http {e.code}: {e.read(200).decode('utf-8', 'replace')}") from None
    except ValueError as e:
        raise ServiceError(f"no JSON: {e}") from None
    if not isinstance(found, dict):
        raise ServiceError("not a JSON object")
    return found


def _post(url: str, body: dict, authorization: str) -> Request:
    return Request(url, json.dumps(body).encode(), {"Authorization": authorization, "Content-Type": "application/json"})


def refresh(c: Credentials) -> Request:
    """For an access token in exchange for the refresh token."""
    form = {"client_id": c.google_client_id, "client_secret": c.google_client_secret, "refresh_token": c.google_refresh_token, "grant_type": "refresh_token"}
    return Request("https://oauth2.googleapis.com/token", urlencode(form).encode(), {"Content-Type": "application/x-www-form-urlencoded"})


def access_token(c: Credentials, ask: Send) -> str:
    token = ask(refresh(c)).get("access_token")
    if not isinstance(token, str) or not token:
        raise ServiceError("no access_token in the answer")
    return token


def request(source: str, urls: list[str], c: Credentials, token: str = "", today: date | None = None, days: int = WINDOW_DAYS, strategy: str = "mobile") -> Request:
    """One request for a batch of urls."""
    escaped = lambda x: quote(x, safe="")
    if source == "pagespeed":
        query = [("url", urls[0]), ("strategy", strategy), *([("key", c.pagespeed_key)] if c.pagespeed_key else []), *(("category", k) for k in ("performance", "seo", "accessibility"))]
        return Request("https://www.googleapis.com/pagespeedonline/v5/runPagespeed?" + urlencode(query), timeout=60)
    if source == "gsc":
        last = today or date.today()
        body = {"startDate": (last - timedelta(days)).isoformat(), "endDate": last.isoformat(), "dimensions": ["page"], "rowLimit": providers.BATCH["gsc"]}
        return _post(f"https://www.googleapis.com/webmasters/v3/sites/{escaped(c.search_console_site)}/searchAnalytics/query", body, f"Bearer {token}")
    if source == "ga4":
        body = {"dateRanges": [{"startDate": f"{days}daysAgo", "endDate": "today"}], "dimensions": [{"name": "pagePath"}], "metrics": [{"name": m} for m in ("sessions", "activeUsers", "screenPageViews")], "limit": providers.BATCH["ga4"]}
        return _post(f"https://analyticsdata.googleapis.com/v1beta/properties/{escaped(c.analytics_property)}:runReport", body, f"Bearer {token}")
    if source == "ahrefs":
        return Request("https://api.ahrefs.com/v3/site-explorer/metrics?" + urlencode({"target": urls[0], "mode": "exact", "volume_mode": "monthly"}), headers={"Authorization": f"Bearer {c.ahrefs_token}"})
    if source == "majestic":
        query = {"app_api_key": c.majestic_key, "cmd": "GetIndexItemInfo", "datasource": "fresh", "items": len(urls)} | {f"item{i}": u for i, u in enumerate(urls)}
        return Request("https://api.majestic.com/api/json?" + urlencode(query))
    if source == "moz":
        key = base64.b64encode(f"{c.moz_access_id}:{c.moz_secret_key}".encode()).decode()
        return _post("https://lsapi.seomoz.com/v2/url_metrics", {"targets": urls}, f"Basic {key}")
    raise ServiceError(f"unknown service: {source}")


def read(source: str, urls: list[str], body: dict) -> list[Row]:
    if source == "pagespeed":
        return providers.pagespeed(urls[0], body)
    if source == "gsc":
        return providers.search_console(body, set(urls))
    if source == "ga4":
        return providers.analytics(body, {urlsplit(u).path or "/": u for u in urls})
    if source == "ahrefs":
        return providers.ahrefs(urls[0], body)
    return providers.majestic(body) if source == "majestic" else providers.moz(urls, body)


def asker(source: str, c: Credentials, ask: Send = send, today: date | None = None, days: int = WINDOW_DAYS) -> Callable[[list[str]], list[Row]]:
    """What ``providers.enrich`` calls for each batch. Missing credentials are an error before anything
    is asked; the token of a Google service is fetched once here and sent along."""
    missing = [n for n in NEEDED[source] if not getattr(c, n)]
    if missing:
        raise ServiceError(f"{source} needs {', '.join(missing)}")
    token = access_token(c, ask) if source in ("gsc", "ga4") else ""
    return lambda urls: read(source, urls, ask(request(source, urls, c, token, today, days)))
