"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block by itself: its
length, the share of its words that are stop words and the share of its characters that are links
make it good, near-good, short or bad. In the second pass near-good and short blocks take the label
of the nearest decided neighbours of their region.

Regions are the article and main elements, the page around them, and elements whose class, id or
role only hints at boilerplate (``WEAK``: a share bar, but a section on related work as well). A
hinted region is main text only if one of its blocks is good or near-good by its own measures.
Elements that are never main text (``NEVER`` and ``STRONG``: menus, footers, adverts, reader
comments) are bad whatever they hold; in an article they do not speak for their neighbours, on the
page around it they do. Of two unlike neighbours the nearer counts inside an article; on the page
around it the good one counts only for a heading before it or a sentence beside it, and the edges
of the page are bad. A region without a good block is judged as one block: by the joined length,
density and links of what is open in it. Of an article that even so is neither prose nor links
(figures, lists of names) the open blocks stay. Where articles hold at least as much good text as
the page around them, what lies around them goes.

Character references are decoded and white space inside a block becomes one space; blocks are
joined by one line feed in page order. Null or empty html gives an empty text. Nothing is cut: all
blocks of any length are read, in time linear in the page. A tag that never ends is dropped with
what follows it, as in a browser. Repeated rows give repeated results; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from siteaudit.functions.markup import references
from siteaudit.llm.common import bound_batches

SHORT = 70
LONG = 200
DENSE = 0.30
SPARSE = 0.15
LINKED = 0.33

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can do for from had has have he her his i if in is it its me more my no not of on one or our she so than that the their them then there they this to up was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais me même mes mon ne nous on ou où par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous "
    "aber als am an auch auf aus bei bin bis bist da damit dann das dass dem den der des die dir doch du durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann mein mich mir mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur "
    "al algo como con cual de del desde donde el ella ellas ellos en entre era es esa ese eso esta este esto fue ha hay la las le les lo los más me mi mis muy nada ni no nos o os para pero por porque que quien se si sin sobre son su sus también te tu un una uno y ya yo".split()
)
_BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SKIPPED = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
NEVER = frozenset("nav footer aside menu dialog button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where another of them begins, or with the element around them.
_IMPLIED = frozenset("p li dd dt tr td th option".split())
_NAME = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
STRONG = re.compile(_NAME % r"ads?|advert\w*|sponsor\w*|sidebar|menu|nav\w*|breadcrumbs?|footer|cookies?|consent|popup|modal|newsletter|comments?|disqus|respond|replies|pagination|pager", re.IGNORECASE)
WEAK = re.compile(_NAME % r"banner|promo\w*|foot|header|masthead|notices?|overlay|subscribe|signup|login|share|sharing|social|related|recommend\w*|reply|widget|toolbar|legal|copyright|disclaimer", re.IGNORECASE)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAMED = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…:;][\"'»”)\]]*$")


@dataclass
class Block:
    text: str
    linked: int
    region: int
    boilerplate: bool
    heading: bool
    label: str = ""


@dataclass
class Page:
    """Blocks in page order, and what each region is: page, article, main or hinted, and in which
    region it lies."""

    blocks: list[Block] = field(default_factory=list)
    kinds: list[str] = field(default_factory=lambda: ["page"])
    around: list[int] = field(default_factory=lambda: [0])


def tokens(page: str) -> Iterator[tuple[str, bool, str]]:
    """(text, False, "") for text, (tag, ending, attributes) for tags: a tag's name is led by ``<``.
    Every character is looked at a fixed number of times."""
    at, size, quotes = 0, len(page), True
    unclosed: set[str] = set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], False, ""
            return
        if page.startswith("<!--", lt):
            if lt > at:
                yield page[at:lt], False, ""
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), lt):
            if lt > at:
                yield page[at:lt], False, ""
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else size
            continue
        name = _NAMED.match(page, lt + 1)
        if not name:
            yield page[at : lt + 1], False, ""
            at = lt + 1
            continue
        if lt > at:
            yield page[at:lt], False, ""
        end = first = page.find(">", name.end())
        if first < 0:
            return
        if quotes:
            # a ">" inside quotes does not end the tag; where quotes do not pair up, they no longer count
            i = name.end()
            while (stop := _STOP.search(page, i)) and stop[0] != ">":
                close = page.find(stop[0], stop.end())
                if close < 0:
                    stop = None
                    break
                i = close + 1
            quotes = stop is not None
            end = stop.start() if stop else first
        tag, ending, attrs = name[1].lower(), page[lt + 1] == "/", page[name.end() : end]
        at = end + 1
        if tag in _SKIPPED:
            if not ending and not attrs.endswith("/") and tag not in unclosed:
                close = re.compile(rf"</{tag}\b", re.IGNORECASE).search(page, at)
                gt = page.find(">", close.end()) if close else -1
                if close:
                    at = gt + 1 if gt >= 0 else size
                elif tag in ("script", "style"):
                    return
                else:
                    unclosed.add(tag)
            continue
        yield "<" + tag, ending, attrs


def _hint(tag: str, attrs: str) -> str:
    """What an element's names say: strong, weak or nothing."""
    if tag in NEVER:
        return "strong"
    if tag in ("html", "body"):
        return ""
    names = " ".join(a or b or c for a, b, c in _ATTR.findall(attrs)) if "=" in attrs else ""
    if names and STRONG.search(names):
        return "strong"
    return "weak" if tag in ("form", "fieldset", "header") or (names and tag not in _HEADINGS and WEAK.search(names)) else ""


def read(page: str) -> Page:
    """All blocks with text in page order."""
    out = Page()
    stack: list[tuple[str, bool, int]] = []  # element, boilerplate, region
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, bad, region, heading = 0, 0, False, 0, False

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.blocks.append(Block(text, linked, region, bad, heading))
            parts.clear()
            linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for tag, ending, attrs in tokens(page):
        if not tag.startswith("<") or len(tag) == 1:
            text = references(tag)
            parts.append(text)
            if links:
                linked += len(_SPACE.sub(" ", text).strip())
            continue
        tag = tag[1:]
        if tag == "a":
            links = max(0, links + (-1 if ending else 1))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _VOID and tag != "hr":
            continue
        hint = "" if ending else _hint(tag, attrs)
        if tag not in _BLOCK and hint != "strong" and not (ending and opened[tag]):
            continue  # inline; of those only the ones that are never main text are kept track of
        close()
        links = 0 if tag in _BLOCK else links
        if tag == "hr":
            continue
        if ending:
            if opened[tag]:
                while pop() != tag:
                    pass
        else:
            if tag in _IMPLIED:
                while stack and stack[-1][0] in _IMPLIED and (stack[-1][0] == tag or tag != "p"):
                    pop()
            _, bad, region = stack[-1] if stack else ("", False, 0)
            kind = out.kinds[region]
            if hint == "strong":
                bad = True
            elif tag == "article" and kind != "article" and not (bad and opened["aside"]):
                bad = False
                out.kinds.append("article")
                out.around.append(region)
                region = len(out.kinds) - 1
            elif tag == "main" and kind in ("page", "hinted"):
                bad = False
                out.kinds.append("main")
                out.around.append(region)
                region = len(out.kinds) - 1
            elif hint == "weak" and not bad and not (tag == "header" and kind == "article"):
                out.kinds.append("hinted")
                out.around.append(region)
                region = len(out.kinds) - 1
            stack.append((tag, bad, region))
            opened[tag] += 1
        _, bad, region = stack[-1] if stack else ("", False, 0)
        heading = bool(stack) and stack[-1][0] in _HEADINGS
    close()
    return out


def bare(word: str) -> str:
    """A word without the punctuation around it."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] == "_"):
        a += 1
    while b > a and not (word[b - 1].isalnum() or word[b - 1] == "_"):
        b -= 1
    return word[a:b]


def stop_density(text: str) -> float:
    ws = text.lower().split()
    return sum(w in STOP_WORDS or bare(w) in STOP_WORDS for w in ws) / max(1, len(ws))


def measured(text: str, linked: int) -> str:
    """Good, near, short or bad by length, links and stop words alone; ``sparse`` is long and has
    few stop words."""
    if linked > LINKED * len(text):
        return "bad"
    if len(text) < SHORT:
        return "short"
    density = stop_density(text)
    if density >= DENSE:
        return "good" if len(text) > LONG else "near"
    return "near" if density >= SPARSE else "sparse"


def first_pass(b: Block, kind: str) -> str:
    if b.boilerplate:
        return "bad"
    label, inside = measured(b.text, b.linked), kind in ("article", "main")
    if not inside and (label == "sparse" or "©" in b.text or (label == "short" and b.linked)):
        return "bad"
    return "short" if label == "sparse" else label


def _nearest(own: list[Block]) -> list[tuple[int, str]]:
    """For each block how far the last decided block before it is, and its label."""
    out, last, gap = [], "", 0
    for b in own:
        gap += 1
        out.append((gap, last))
        if b.label in ("good", "bad"):
            last, gap = b.label, 0
    return out


def second_pass(own: list[Block], kind: str) -> None:
    """Decide the blocks of one region that the first pass left open."""
    inside = kind in ("article", "main")
    if inside:
        own = [b for b in own if not b.boilerplate]
    if not any(b.label == "good" for b in own):
        left = [b for b in own if b.label in ("near", "short")]
        joined = measured(" ".join(b.text for b in left), sum(b.linked for b in left)) if left else ""
        near = [b for b in left if b.label == "near"]
        if joined == "good" or (near and (kind == "hinted" or joined == "near")):
            for b in near or left:
                b.label = "good"
        elif inside and joined in ("short", "sparse", "near"):
            for b in left:
                b.label = "good"
    for now in ("near", "short"):
        before, after = _nearest(own), _nearest(own[::-1])[::-1]
        for b, (n, x), (m, y) in zip(own, before, after, strict=True):
            if b.label != now:
                continue
            if not inside:
                x, y = x or "bad", y or "bad"
            if x == y or not x or not y:
                b.label = x or y or "bad"
            elif inside:
                b.label = (x if n < m else y) if n != m else "good" if now == "near" else "bad"
            elif now == "near":
                b.label = "good"
            else:
                beside = n if x == "good" else m
                b.label = "good" if (b.heading and y == "good") or (beside == 1 and not b.linked and _SENTENCE.search(b.text)) else "bad"


def judge(page: Page) -> None:
    """Label all blocks good or bad."""
    regions: dict[int, list[Block]] = {}
    for b in page.blocks:
        b.label = first_pass(b, page.kinds[b.region])
        regions.setdefault(b.region, []).append(b)
    for r, own in regions.items():
        second_pass(own, page.kinds[r])


def main_text(page: Page) -> list[Block]:
    """The good blocks, without those around articles that hold as much."""

    def inside(kind: str) -> list[bool]:
        """Of each region whether it is, or lies in, one of this kind. The one around it comes before it."""
        out = [False]
        for r in range(1, len(page.kinds)):
            out.append(page.kinds[r] == kind or out[page.around[r]])
        return out

    good = [b for b in page.blocks if b.label == "good"]
    for kind in ("article", "main"):
        own = inside(kind)
        within = [b for b in good if own[b.region]]
        if within and 2 * sum(len(b.text) for b in within) >= sum(len(b.text) for b in good):
            return within
    return good


def extract(page: str | None) -> str:
    found = read(page or "")
    judge(found)
    return "\n".join(b.text for b in main_text(found))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [extract(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
