"""Bytes of a page as text: the charset of the header, else of the markup, else UTF-8, else
Windows-1252."""

from __future__ import annotations

import re

#: Charset names and the codecs that browsers read them with.
ALIASES = {
    "utf-8": "utf-8", "utf8": "utf-8", "ascii": "utf-8", "us-ascii": "utf-8", "utf-16": "utf-16", "utf-16be": "utf-16-be", "utf-16le": "utf-16-le",
    "windows-1252": "cp1252", "cp1252": "cp1252", "iso-8859-1": "cp1252", "latin1": "cp1252", "windows-1251": "cp1251", "iso-8859-2": "iso8859-2",
    "shift_jis": "shift_jis", "euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp",
}
SNIFFED = 2048
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-:.]+)", re.IGNORECASE)


def charset(value: str | bytes | None) -> str | None:
    m = _CHARSET.search(value if isinstance(value, bytes) else (value or "").encode("latin-1", "replace"))
    return ALIASES.get(m[1].decode().lower()) if m else None


def _as(data: bytes, codec: str) -> str | None:
    if codec == "cp1252":
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if any(b in data for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else data.decode("cp1252")
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


def decode(data: bytes, content_type: str | None = None) -> str:
    data = data.removeprefix(b"\xef\xbb\xbf")
    for codec in (charset(content_type), charset(data[:SNIFFED]), "utf-8", "cp1252"):
        if codec and (text := _as(data, codec)) is not None:
            return text
    return data.decode("utf-8", "replace")
