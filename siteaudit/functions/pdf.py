"""What a PDF says about itself, without reading its pages."""

from __future__ import annotations

import re

_PAIR = re.compile(rb"/(Title|Subject|Creator|Lang)\s*(?:\((?P<text>(?:[^()\\]|\\.|\([^()]*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>)", re.DOTALL)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def is_pdf(data: bytes, content_type: str | None = None) -> bool:
    return (content_type or "").lower().startswith("application/pdf") or data[:1024].lstrip().startswith(b"%PDF-")


def _unescape(m: re.Match) -> bytes:
    c = m[1]
    return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _NAMED.get(c, c)


def _string(m: re.Match) -> str | None:
    if m["hex"] is not None:
        digits = re.sub(rb"\s", b"", m["hex"])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = _ESCAPED.sub(_unescape, m["text"])
    text = data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("utf-8", "replace") if data[:3] == b"\xef\xbb\xbf" else data.decode("latin-1")
    return " ".join(text.split()) or None


def info(data: bytes) -> dict[str, str | None]:
    """title, meta_description and lang, from the first entries of each kind. The field of the language
    holds the creator: it has no column of its own."""
    names = {b"Title": "title", b"Subject": "meta_description", b"Creator": "lang"}
    out: dict[str, str | None] = dict.fromkeys(names.values())
    for m in _PAIR.finditer(data):
        if (key := names.get(m[1])) and out[key] is None:
            out[key] = _string(m)
    return out
