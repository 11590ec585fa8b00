"""Facts of an HTML page in one pass over its tags."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, deque
from collections.abc import Callable
from dataclasses import dataclass, field

import regex

from siteaudit.functions.markup import END, START, events, references

#: What gives an analytics tool away, in lower case.
ANALYTICS = (
    ("Google Tag Manager", ("googletagmanager.com/gtm.js", "gtm.start")), ("Google Analytics 4", ("googletagmanager.com/gtag/js", "gtag('config'")), ("Universal Analytics", ("google-analytics.com/analytics.js", "ga('create'")),
    ("Meta Pixel", ("connect.facebook.net", "fbq('init'")), ("Hotjar", ("static.hotjar.com", "hjsitesettings")), ("Plausible", ("plausible.io/js",)), ("Matomo", ("matomo.js", "piwik.js")), ("Segment", ("cdn.segment.com",)), ("PostHog", ("posthog.com/static/array.js", "posthog.init")),
)
_HIDDEN = {"script", "style", "noscript"}
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


@dataclass
class Facts:
    title: str | None = None
    title_count: int = 0
    meta_description: str | None = None
    meta_description_count: int = 0
    h1: str | None = None
    h1_count: int = 0
    h2: str | None = None
    h2_count: int = 0
    base: str | None = None
    canonical: str | None = None
    canonical_count: int = 0
    meta_robots: str | None = None
    lang: str | None = None
    amphtml: str | None = None
    rel_prev: str | None = None
    rel_next: str | None = None
    social: dict[str, str] = field(default_factory=dict)
    links: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    hreflang: list[dict] = field(default_factory=list)
    resources: list[dict] = field(default_factory=list)
    structured_data: list[dict] = field(default_factory=list)
    analytics: list[str] = field(default_factory=list)
    text: str = ""
    word_count: int = 0
    text_length: int = 0
    content_hash: bytes = b""


def _clean(text: str | None) -> str | None:
    return " ".join((text or "").split()) or None


def _type_name(value: str) -> str:
    return re.split(r"[/#]", value.strip().rstrip("/#"))[-1]


def _json_types(node) -> list[str]:
    """Every @type of a JSON-LD value, nested ones included."""
    out, todo = [], deque([node])
    while todo:
        at = todo.popleft()
        if isinstance(at, dict):
            t = at.get("@type")
            out += [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str) and x.strip()]
            todo += list(at.values())
        elif isinstance(at, list):
            todo += at
    return [_type_name(t) for t in out]


#: What may stand in a head; anything else begins the body.
_HEAD = frozenset("html head title base link meta script style noscript template".split())


class _Reader:
    def __init__(self) -> None:
        self.facts, self.text, self.catching = Facts(), [], {}
        self.hidden, self.in_head = Counter(), True
        self.script: list[str] | None = None
        self.json, self.scripts, self.seen = False, [], set()
        self.positions = -1

    def read(self, page: str, decode: Callable[[str], str]) -> None:
        for kind, what, attrs, _ in events(page, decode):
            if kind == START:
                self.started(what, attrs)
            elif kind == END:
                self.ended(what)
            else:
                self.said(what)
        for tag in list(self.catching):
            self._close(tag)
        if self.script is not None:
            self.ended("script")

    def started(self, tag, a):
        f = self.facts
        if tag not in _HEAD:
            self.in_head = False  # both the end of the head and the start of the body may be left out
        if tag in _BLOCKS:
            self.text.append(" ")
        if tag == "html" and f.lang is None:
            f.lang = _clean(a.get("lang"))
        elif tag == "title" and not self.hidden.total() and self.in_head:
            f.title_count += 1
            self.catching["title"] = []
        elif tag in ("h1", "h2"):
            setattr(f, f"{tag}_count", getattr(f, f"{tag}_count") + 1)
            self._close(tag)
            self.catching[tag] = []
        elif tag == "base" and f.base is None:
            f.base = _clean(a.get("href"))
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            self._link(a)
        elif tag == "a":
            self._close("a")
            if "href" in a:
                self.positions += 1
                if a["href"].strip():
                    f.links.append({"href": a["href"].strip(), "anchor_text": "", "rel": _clean(a.get("rel")), "position": self.positions})
                    self.catching["a"] = []
        elif tag == "img" and a.get("src", "").strip():
            size = {k: int(a[k]) if a.get(k, "").strip().isdigit() else None for k in ("width", "height")}
            f.images.append({"src": a["src"].strip(), "alt": a.get("alt"), **size})
        elif tag == "script" and a.get("src", "").strip():
            f.resources.append({"href": a["src"].strip(), "kind": "js"})
            self.scripts.append(a["src"])
        self._typed("microdata", [a["itemtype"]] if a.get("itemtype") else [])
        self._typed("rdfa", a.get("typeof", "").split())
        if tag in _HIDDEN:
            self.hidden[tag] += 1
            if tag == "script":
                self.script, self.json = [], a.get("type", "").strip().lower() == "application/ld+json"

    def _meta(self, a):
        f, name, content = self.facts, a.get("name", "").strip().lower(), a.get("content")
        if name == "description":
            f.meta_description_count += 1
            f.meta_description = f.meta_description if f.meta_description_count > 1 else _clean(content)
        elif name == "robots" and f.meta_robots is None:
            f.meta_robots = _clean(content)
        for rank, key in enumerate((a.get("property", "").strip().lower(), name)):
            if key.startswith(("og:", "twitter:")) and _clean(content):
                old = f.social.get(key)
                if old is None or rank < old[0]:
                    f.social[key] = (rank, _clean(content))

    def _link(self, a):
        f, rel, href = self.facts, a.get("rel", "").lower().split(), a.get("href", "").strip()
        if "canonical" in rel:
            f.canonical_count += 1
            f.canonical = f.canonical or href or None
        if "alternate" in rel and a.get("hreflang", "").strip() and href:
            f.hreflang.append({"lang": a["hreflang"].strip(), "href": href})
        if "stylesheet" in rel and href:
            f.resources.append({"href": href, "kind": "css"})
        for key, name in (("amphtml", "amphtml"), ("prev", "rel_prev"), ("next", "rel_next")):
            if key in rel and getattr(f, name) is None:
                setattr(f, name, href or None)

    def _typed(self, form, values):
        for v in map(_type_name, values):
            if v and (form, v) not in self.seen:
                self.seen.add((form, v))
                self.facts.structured_data.append({"format": form, "type": v})

    def _close(self, tag):
        caught = self.catching.pop(tag, None)
        if caught is None:
            return
        value = _clean("".join(caught))
        if tag == "a":
            self.facts.links[-1]["anchor_text"] = value or ""
        elif tag == "title":
            self.facts.title = self.facts.title if self.facts.title_count > 1 else value
        elif getattr(self.facts, f"{tag}_count") == 1:
            setattr(self.facts, tag, value)

    def ended(self, tag):
        if tag in _BLOCKS:
            self.text.append(" ")
        if tag == "head":
            self.in_head = False
        if self.hidden[tag]:
            self.hidden[tag] -= 1
            if tag == "script" and self.script is not None:
                body = "".join(self.script)
                if self.json:
                    try:
                        self._typed("json-ld", _json_types(json.loads(body)))
                    except (ValueError, RecursionError):
                        pass
                self.scripts.append(body)
                self.script = None
        self._close(tag)

    def said(self, data):
        if self.script is not None:
            self.script.append(data)
        if self.hidden.total():
            return
        for caught in self.catching.values():
            caught.append(data)
        if self.in_head and "title" not in self.catching and data.strip():
            self.in_head = False
        if "title" not in self.catching and not self.in_head:
            self.text.append(data)


def parse(html: str | None, decode: Callable[[str], str] = references) -> Facts:
    """``decode`` says which character references of the text count."""
    reader = _Reader()
    reader.read(html or "", decode)
    f = reader.facts
    f.social = {k: v[1] for k, v in f.social.items()}
    f.text = " ".join("".join(reader.text).split())
    f.word_count = len(f.text.split(" ")) if f.text else 0
    f.text_length = len(regex.findall(r"\X", f.text))
    f.content_hash = hashlib.sha256(f.text.encode("utf-8", "surrogatepass")).digest()
    code = "\n".join(reader.scripts).lower()
    f.analytics = [name for name, needles in ANALYTICS if any(n in code for n in needles)]
    return f
