"""Tags and text of a page in one pass, each character looked at a fixed number of times.

The rules are those of the HTML standard: what a browser takes for a tag, a comment or text is
taken for the same here. A tag, comment or script that never ends takes the rest of the page with it,
so nothing is searched for twice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

START, END, TEXT = "start", "end", "text"
#: Elements without content, and those whose content is text and not tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())

_GAP = re.compile(r"[ \t\n\f\r]*")
_GAP_OR_SLASH = re.compile(r"[ \t\n\f\r/]*")
_TAG = re.compile(r"/?([A-Za-z][^ \t\n\f\r/>]*)")
_NAME = re.compile(r"=?[^ \t\n\f\r/>=]*")
_BARE = re.compile(r"[^ \t\n\f\r>]*")
_COMMENT_END = re.compile(r"--!?>")
_SCRIPT_MARK = re.compile(r"<!--(?:-?>)?|-->|<(/?)script(?=[ \t\n\f\r/>])", re.IGNORECASE)
_REFERENCE = re.compile(r"&(?:#[xX]?[0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*)(;?)(=?))")
_WHOLE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);|([A-Za-z][A-Za-z0-9]*;))")
_LONG_NUMBER = re.compile(r"&#0*+([0-9]{8,});?")


def references(text: str) -> str:
    """Character references decoded; a number of any length is one that no character has."""
    if "&" not in text:
        return text
    return unescape(_LONG_NUMBER.sub("�", text))


def whole_references(text: str) -> str:
    """As ``references``, but only those that end with a semicolon."""
    return _WHOLE.sub(lambda m: references(m[0]) if m[1] is None or m[1] in html5 else m[0], text) if "&" in text else text


def _in_attribute(value: str) -> str:
    """As ``references``, but a name without a semicolon must be the whole name, and no ``=`` may follow."""

    def one(m: re.Match) -> str:
        if m[1] is None:
            return references(m[0])
        known = m[1] + ";" in html5 if m[2] else m[1] in html5 and not m[3]
        return unescape(m[1].join(("&", m[2]))) + m[3] if known else m[0]

    return _REFERENCE.sub(one, value) if "&" in value else value


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool] | None:
    """Attributes from here to the tag's end, the place behind it and whether the tag closes itself; None if
    the page ends first. The first attribute of a name counts."""
    out: dict[str, str] = {}
    while (gap := _GAP_OR_SLASH.match(page, at)).end() < len(page):
        at = gap.end()
        if page[at] == ">":
            return out, at + 1, gap[0].endswith("/")
        name = _NAME.match(page, at)
        at, value = _GAP.match(page, name.end()).end(), ""
        if page.startswith("=", at):
            at = _GAP.match(page, at + 1).end()
            quote = page[at : at + 1]
            if quote in ("'", '"'):
                close = page.find(quote, at + 1)
                if close < 0:
                    return None
                value, at = page[at + 1 : close], close + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        out.setdefault(name[0].lower(), _in_attribute(value))
    return None


def _script_end(page: str, at: int) -> int:
    """Where the end tag of a script begins: not inside a comment in which another script was begun."""
    commented, inner = False, False
    for m in _SCRIPT_MARK.finditer(page, at):
        if m[0].startswith("<!--"):
            commented = commented or not m[0].endswith(">")
        elif m[0] == "-->":
            commented = inner = False
        elif not m[1]:
            inner = commented
        elif inner:
            inner = False
        else:
            return m.start()
    return -1


def events(page: str, decode: Callable[[str], str] = references) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """(kind, tag or text, attributes, closes itself) in page order. Text is decoded but not joined."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield TEXT, decode(page[at:lt]), {}, False
        if lt == size:
            return
        tag = _TAG.match(page, lt + 1)
        if not tag:
            if page.startswith("<!--", lt):
                short = next((x for x in (">", "->") if page.startswith(x, lt + 4)), None)
                end = None if short else _COMMENT_END.search(page, lt + 4)
                at = lt + 4 + len(short) if short else end.end() if end else size
            elif page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt + 2)
                at = end + 1 if end >= 0 else size
            else:
                yield TEXT, "<", {}, False
                at = lt + 1
            continue
        found = _attributes(page, tag.end())
        if found is None:
            return
        attrs, at, closed = found
        name = tag[1].lower()
        if page[lt + 1] == "/":
            yield END, name, {}, False
            continue
        yield START, name, attrs, closed
        if name == "plaintext":
            yield TEXT, page[at:], {}, False
            return
        if name in RAW or name in ESCAPABLE:
            if name == "script":
                end = _script_end(page, at)
            else:
                close = re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.IGNORECASE).search(page, at)
                end = close.start() if close else -1
            body = page[at : end if end >= 0 else size]
            if body:
                yield TEXT, decode(body) if name in ESCAPABLE else body, {}, False
            at = end if end >= 0 else size


_SECTIONS = ("tbody", "thead", "tfoot")
_ENDS_P = "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul"
_APART = frozenset("button table td th caption object template marquee applet svg math".split())
#: Which begun elements end an open one, and which elements between them hold that off.
_IMPLIED = (
    (frozenset(["p"]), frozenset(_ENDS_P.split()), _APART),
    (frozenset(["li"]), frozenset(["li"]), _APART | {"ul", "ol", "menu"}),
    (frozenset(["dd", "dt"]), frozenset(["dd", "dt"]), _APART | {"dl"}),
    (frozenset(_SECTIONS), frozenset(_SECTIONS), frozenset(["table", "template"])),
    (frozenset(["tr"]), frozenset(["tr", *_SECTIONS]), frozenset(["table", "template"])),
    (frozenset(["td", "th"]), frozenset(["td", "th", "tr", *_SECTIONS]), frozenset(["table", "template"])),
    (frozenset(["optgroup"]), frozenset(["optgroup"]), frozenset(["select", "datalist", "template"])),
    (frozenset(["option"]), frozenset(["option", "optgroup"]), frozenset(["select", "datalist", "template"])),
    (frozenset(["a"]), frozenset(["a"]), _APART),
)
_CONCERNED = frozenset().union(*(kinds | apart for kinds, _, apart in _IMPLIED))
_IN_HEAD = frozenset("base link meta title script style noscript template".split())
NESTED = frozenset(["svg", "math"])


class Open:
    """The open elements of a page, with the tags that the standard implies.

    ``start`` says how many elements end before a new one begins, and which begin (with html, head and body
    where they are implied), each with whether it stays open; ``end`` says how many end at an end tag.
    Each costs no more than the elements that it ends: what may be ended is known for every open
    element, and not searched for."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.count: Counter[str] = Counter()
        self.near: list[tuple[int, ...]] = [(-1,) * len(_IMPLIED)]
        self.body = self.head = False

    def _push(self, tag: str) -> None:
        near = self.near[-1]
        if tag in _CONCERNED:
            near = tuple(len(self.tags) if tag in kinds else -1 if tag in apart else n for n, (kinds, _, apart) in zip(near, _IMPLIED, strict=True))
        self.tags.append(tag)
        self.near.append(near)
        self.count[tag] += 1

    def _cut(self, to: int) -> int:
        gone = len(self.tags) - to
        for tag in self.tags[to:]:
            self.count[tag] -= 1
        del self.tags[to:], self.near[to + 1 :]
        return gone

    def _begin(self, begun: list[tuple[str, bool]], tag: str, stays: bool = True) -> None:
        begun.append((tag, stays))
        if stays:
            self._push(tag)

    def start(self, tag: str, closed: bool = False) -> tuple[int, list[tuple[str, bool]]]:
        """A second html, head or body begins nothing."""
        begun: list[tuple[str, bool]] = []
        gone = 0
        if not self.count["html"]:
            self._begin(begun, "html")
        if tag == "html" or (tag == "body" and self.body) or (tag == "head" and (self.head or self.body)):
            return gone, begun
        if tag == "head" or (tag in _IN_HEAD and not self.head and not self.body):
            self.head = True
            if tag != "head":
                self._begin(begun, "head")
        elif not self.body and tag not in _IN_HEAD:
            if self.count["head"]:
                gone += self._cut(self.tags.index("head"))
            self.head = self.body = True
            if tag not in ("body", "frameset"):
                self._begin(begun, "body")
        ends = [at for at, (_, by, _) in zip(self.near[-1], _IMPLIED, strict=True) if at >= 0 and tag in by]
        if ends:
            gone += self._cut(min(ends))
        self._begin(begun, tag, tag not in VOID and not (closed and (tag in NESTED or any(self.count[n] for n in NESTED))))
        return gone, begun

    def text(self, data: str) -> tuple[int, list[tuple[str, bool]]]:
        """The same for text: words that stand in no element of the head begin the body."""
        if self.body or not data.strip() or (self.tags and self.tags[-1] in _IN_HEAD):
            return 0, []
        return self.start("body")

    def end(self, tag: str) -> int:
        """How many elements end; none if no such element is open. The body stays open to the page's end."""
        if tag in ("html", "body") or not self.count[tag]:
            return 0
        at = len(self.tags) - 1
        while self.tags[at] != tag:
            at -= 1
        return self._cut(at)
