"""Urls in one normal form."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urljoin, urlsplit

_ESCAPE = re.compile(r"%([0-9a-fA-F]{2})")
_UNSAFE = re.compile(r"[^A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]")
_PORTS = {"http": 80, "https": 443}


def _dots(path: str) -> str:
    """Remove dot segments; a path that ended in one keeps its slash."""
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif p == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def _escaped(text: str) -> str:
    text = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), text)
    return _ESCAPE.sub(lambda m: "%" + m[1].upper(), text)


def normalise(url: str | None, base: str | None = None) -> str | None:
    """The url, resolved against ``base``: http and https only, scheme and host in lower case, no
    fragment, user or default port, ``/`` for an empty path, no dot segments, escapes in upper case,
    no empty query. Parameters, the path's case and a trailing slash stay. None if it is none."""
    text = (url or "").strip()
    if not text:
        return None
    try:
        parts = urlsplit(urljoin(base, text) if base else text)
        port = parts.port
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), (parts.hostname or "").lower()
    if scheme not in _PORTS or not host:
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode("ascii")
        except UnicodeError:
            return None
    if ":" in host:
        host = f"[{host}]"
    where = host if port is None or port == _PORTS[scheme] else f"{host}:{port}"
    path = _escaped(_dots(parts.path)) or "/"
    query = f"?{_escaped(parts.query)}" if parts.query else ""
    return f"{scheme}://{where}{path if path.startswith('/') else '/' + path}{query}"


def url_hash(url: str) -> bytes:
    return hashlib.sha256(url.encode("utf-8", "surrogatepass")).digest()


def host_and_path(url: str) -> tuple[str, str]:
    parts = urlsplit(url)
    return (parts.hostname or "").lower(), parts.path or "/"
