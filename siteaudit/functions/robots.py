"""robots.txt: which paths an agent may fetch, how fast, and where the sitemaps are."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[bool, str]] = field(default_factory=list)  # allowed, pattern
    delay: float | None = None


def _regex(pattern: str) -> re.Pattern:
    end = pattern.endswith("$")
    body = "".join(".*" if c == "*" else re.escape(c) for c in (pattern[:-1] if end else pattern))
    return re.compile(body + (r"\Z" if end else ""), re.DOTALL)


@dataclass
class Policy:
    groups: list[Group] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)
    nothing: bool = False

    def group(self, agent: str) -> list[Group]:
        """All groups for an agent: those of its exact name, else those of the longest name that is
        part of it (the first in order of the alphabet, if several), else those for ``*``."""
        name = agent.lower()
        named = {a for g in self.groups for a in g.agents if a != "*"}
        best = name if name in named else min((a for a in named if a and a in name), key=lambda a: (-len(a), a), default="*")
        return [g for g in self.groups if best in g.agents]

    def allows(self, target: str, agent: str = "*") -> bool:
        """Whether path and query may be fetched: the longest pattern that fits decides, Allow if two
        are as long."""
        if self.nothing:
            return False
        fits = [(len(p), allowed) for g in self.group(agent) for allowed, p in g.rules if p and self._compiled[p].match(target)]
        return max(fits, default=(0, True))[1]

    def delay(self, agent: str = "*") -> float | None:
        return next((g.delay for g in self.group(agent) if g.delay is not None), None)

    @cached_property
    def _compiled(self) -> dict[str, re.Pattern]:
        return {p: _regex(p) for g in self.groups for _, p in g.rules if p}


ALLOW_ALL, DISALLOW_ALL = Policy(), Policy(nothing=True)


def parse(text: str) -> Policy:
    out, now, in_names = Policy(), None, False
    for line in text.lstrip("﻿").splitlines():
        key, sep, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "sitemap":
            if value:
                out.sitemaps.append(value)
            continue
        if key == "user-agent":
            if not in_names or now is None:
                now = Group()
                out.groups.append(now)
            now.agents.append(value.lower())
            in_names = True
            continue
        in_names = False
        if now is None:
            continue
        if key in ("allow", "disallow"):
            if value:
                now.rules.append((key == "allow", value))
        elif key == "crawl-delay":
            try:
                now.delay = float(value)
            except ValueError:
                pass
    return out


def from_response(status: int, body: str | None) -> Policy:
    """What a site's answer means: its rules if it has some, nothing while it is in trouble, and
    everything otherwise."""
    if 200 <= status < 300:
        return parse(body or "")
    return DISALLOW_ALL if status == 0 or status == 429 or status >= 500 else ALLOW_ALL
