"""What a crawl is asked to do; saved with the crawl as JSON."""

from __future__ import annotations

import base64
import json
import re
import shlex
from dataclasses import asdict, dataclass, field, fields, replace

from siteaudit.functions.urls import host_and_path, normalise
from siteaudit.operators.frontier import Rules

DESKTOP_AGENT, MOBILE_AGENT = "siteaudit/1.0", "siteaudit/1.0 (Mobile)"


@dataclass(frozen=True)
class ExtractionRule:
    name: str
    selector: str
    value: str = "text"  # text, html or attribute
    engine: str = "css"  # css or xpath


@dataclass(frozen=True)
class CrawlConfig:
    seed_url: str
    workers: int = 5
    max_per_host: int = 2
    user_agent: str = DESKTOP_AGENT
    timeout: float = 20
    max_redirects: int = 10
    respect_robots: bool = True
    follow_internal_nofollow: bool = False
    crawl_subdomains: bool = False
    max_depth: int | None = None
    url_cap: int = 500_000
    retain_bodies: bool = True
    retain_body_url_limit: int = 50_000
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    check_external_links: bool = True
    check_images: bool = True
    check_resources: bool = False
    render_javascript: bool = False
    render_timeout: float = 20
    render_settle_ms: int = 400
    render_concurrency: int = 2
    mobile: bool = False
    javascript_extractions: tuple[tuple[str, str], ...] = ()
    extractions: tuple[ExtractionRule, ...] = ()
    header_extractions: tuple[str, ...] = ()
    basic_auth_user: str | None = None
    basic_auth_password: str | None = None
    extra_headers: dict[str, str] = field(default_factory=dict)
    sitemap_urls: tuple[str, ...] = ()
    discover_sitemaps: bool = True
    list_mode_only: bool = False
    seed_list: tuple[str, ...] = ()
    max_sitemaps: int = 50

    def clamped(self) -> CrawlConfig:
        """Every number within its bounds, and only patterns that are valid."""
        workers = min(50, max(1, self.workers))
        return replace(self, workers=workers, max_per_host=min(workers, max(1, self.max_per_host)), timeout=min(300, max(1, self.timeout)), max_redirects=min(50, max(0, self.max_redirects)), url_cap=max(1, self.url_cap), include=tuple(filter(valid_pattern, self.include)), exclude=tuple(filter(valid_pattern, self.exclude)))

    def headers(self) -> dict[str, str]:
        """What every request sends."""
        out = {"User-Agent": MOBILE_AGENT if self.mobile and self.user_agent == DESKTOP_AGENT else self.user_agent, **self.extra_headers}
        if self.basic_auth_user is not None:
            out["Authorization"] = "Basic " + base64.b64encode(f"{self.basic_auth_user}:{self.basic_auth_password or ''}".encode()).decode()
        return out

    def rules(self) -> Rules:
        seed = normalise(self.seed_url)
        if seed is None:
            raise ValueError(f"not a url: {self.seed_url!r}")
        same = ("crawl_subdomains", "max_depth", "max_redirects", "url_cap", "include", "exclude", "follow_internal_nofollow", "check_external_links", "check_images", "check_resources")
        return Rules(host_and_path(seed)[0], list_mode=self.list_mode_only, **{k: getattr(self, k) for k in same})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> CrawlConfig:
        """Fields that are not known are left out; those that are missing have their defaults."""
        d = {k: v for k, v in json.loads(text).items() if k in {f.name for f in fields(cls)}}
        for k in ("include", "exclude", "header_extractions", "sitemap_urls", "seed_list"):
            d[k] = tuple(d.get(k) or ())
        d["extractions"] = tuple(ExtractionRule(**r) for r in d.get("extractions") or ())
        d["javascript_extractions"] = tuple(tuple(x) for x in d.get("javascript_extractions") or ())
        return cls(**d)


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return bool(pattern)


@dataclass(frozen=True)
class Schedule:
    """When a crawl runs again: daily, or on one weekday (0 is Sunday)."""

    url: str
    hour: int
    minute: int = 0
    weekday: int | None = None

    def problems(self) -> list[str]:
        out = []
        if not 0 <= self.hour <= 23:
            out.append("hour must be 0 to 23")
        if not 0 <= self.minute <= 59:
            out.append("minute must be 0 to 59")
        if self.weekday is not None and not 0 <= self.weekday <= 6:
            out.append("weekday must be 0 to 6")
        if normalise(self.url) is None:
            out.append("url must be http or https")
        return out

    def cron(self) -> str:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return f"{self.minute} {self.hour} * * {'*' if self.weekday is None else self.weekday}"

    def line(self, program: str) -> str:
        """The whole cron line, the url quoted for the shell."""
        return f"{self.cron()} {shlex.quote(program)} -m siteaudit crawl {shlex.quote(self.url)} --replace"

    def summary(self) -> str:
        days = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
        return f"{'Every day' if self.weekday is None else 'Every ' + days[self.weekday]} at {self.hour:02d}:{self.minute:02d}"
