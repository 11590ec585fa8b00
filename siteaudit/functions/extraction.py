"""Values that users pick out of pages with CSS selectors or simple XPath paths."""

from __future__ import annotations

import re
from html import escape

from siteaudit.functions.markup import END, START, TEXT, VOID, Open, events

_PART = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[~^$*|]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]|:(?P<pseudo>first-child|last-child|nth-child\((?P<n>\d+)\))")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        """All elements below in page order. Pages may be nested to any depth, so nothing here calls itself."""
        todo = self.elements()[::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += n.elements()[::-1]

    def text(self) -> str:
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in ("script", "style"):
                todo += c.children[::-1]
        return "".join(out)

    def html(self) -> str:
        out, todo = [], [self]
        while todo:
            c = todo.pop()
            if isinstance(c, tuple):
                out.append(c[0])
            elif isinstance(c, str):
                out.append(escape(c, False))
            else:
                out.append(f"<{c.tag}{''.join(f' {k}="{escape(v)}"' for k, v in c.attrs.items())}>")
                if c.tag not in VOID:
                    todo.append((f"</{c.tag}>",))
                    todo += c.children[::-1]
        return "".join(out)


def tree(page: str) -> Node:
    """The page's elements, with those that the standard implies."""
    root = at = Node("", {}, None)
    opened = Open()
    for kind, what, attrs, closed in events(page):
        gone, begun = (opened.end(what), []) if kind == END else opened.start(what, closed) if kind == START else opened.text(what)
        for _ in range(gone):
            at = at.parent
        for n, (tag, stays) in enumerate(begun, 1):
            node = Node(tag, attrs if n == len(begun) and tag == what and kind == START else {}, at)
            at.children.append(node)
            at = node if stays else at
        if kind == TEXT and at is not root:
            at.children.append(what)
    return root


def _compound(text: str):
    """Tests of one compound selector; None if it is not understood."""
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            return None
        tests.append(m)
        at = m.end()
    return tests or None


def _fits(node: Node, tests) -> bool:
    for m in tests:
        if m["tag"] and m["tag"] != "*" and node.tag != m["tag"].lower():
            return False
        if m["id"] and node.attrs.get("id") != m["id"]:
            return False
        if m["cls"] and m["cls"] not in node.attrs.get("class", "").split():
            return False
        if m["attr"]:
            v = node.attrs.get(m["attr"].lower())
            want = m["val"]
            good = v is not None and {None: True, "=": v == want, "~=": want in (v or "").split(), "^=": bool(want) and (v or "").startswith(want or ""), "$=": bool(want) and (v or "").endswith(want or ""), "*=": bool(want) and (want or "") in (v or ""), "|=": v == want or (v or "").startswith(f"{want}-")}[m["op"]]
            if not good:
                return False
        if m["pseudo"]:
            mates = node.parent.elements()
            n = len(mates) - 1 if m["pseudo"] == "last-child" else 0 if m["pseudo"] == "first-child" else int(m["n"]) - 1
            if not 0 <= n < len(mates) or mates[n] is not node:
                return False
    return True


def _parse_css(selector: str):
    out = []
    for group in selector.split(","):
        steps, how = [], " "
        for token in re.findall(r"[>+~]|(?:\[[^\]]*\]|[^\s>+~\[])+", group.strip()):
            if token in (">", "+", "~"):
                how = token
            else:
                tests = _compound(token)
                if tests is None:
                    return None
                steps.append((how, tests))
                how = " "
        if not steps:
            return None
        out.append(steps)
    return out


def _match(node: Node, steps) -> bool:
    how, tests = steps[-1]
    if not _fits(node, tests):
        return False
    if len(steps) == 1:
        return True
    if how == ">":
        return node.parent is not None and _match(node.parent, steps[:-1])
    if how in "+~":
        mates = node.parent.elements()
        before = mates[: mates.index(node)]
        return any(_match(m, steps[:-1]) for m in (before[-1:] if how == "+" else before))
    up = node.parent
    while up is not None:
        if _match(up, steps[:-1]):
            return True
        up = up.parent
    return False


def css(root: Node, selector: str) -> list[Node]:
    groups = _parse_css(selector)
    return [n for n in root.walk() if any(_match(n, s) for s in groups)] if groups else []


def xpath(root: Node, path: str) -> list:
    """Paths of steps ``/name``, ``//name``, ``[n]``, ``[@a]``, ``[@a='v']`` and a last ``/@a`` or
    ``/text()``. Anything else, functions too, gives nothing."""
    now: list = [root]
    at = 0
    step = re.compile(r"(//?)(?:(@[\w:-]+)|(text\(\))|([\w-]+|\*))((?:\[[^\]]*\])*)")
    while at < len(path):
        m = step.match(path, at)
        if not m:
            return []
        deep, at = m[1] == "//", m.end()
        nodes = [n for n in now if isinstance(n, Node)]
        if m[2]:
            some = [x for n in nodes for x in ([n, *n.walk()] if deep else [n])]
            now = [x.attrs[m[2][1:]] for x in some if m[2][1:] in x.attrs]
            continue
        if m[3]:
            some = [x for n in nodes for x in ([n, *n.walk()] if deep else [n])]
            now = [c for x in some for c in x.children if isinstance(c, str)]
            continue
        parents = list(dict.fromkeys(x for n in nodes for x in ([n, *n.walk()] if deep else [n])))
        out = []
        for p in parents:
            own = [c for c in p.elements() if m[4] in ("*", c.tag)]
            for test in re.findall(r"\[([^\]]*)\]", m[5]):
                if test.isdigit():
                    own = own[int(test) - 1 : int(test)]
                elif t := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*[\"'](.*)[\"'])?", test):
                    own = [c for c in own if t[1] in c.attrs and (t[2] is None or c.attrs[t[1]] == t[2])]
                else:
                    return []
            out += own
        now = out
    return now


def extract(page: str | None, rules) -> list[tuple[str, str, int]]:
    """(name, value, position) of all rules; empty values are dropped, rules that are not understood
    give nothing. ``attribute`` takes the attribute that the selector's last brackets name."""
    root, out = tree(page or ""), []
    for r in rules:
        found = css(root, r.selector) if r.engine == "css" else xpath(root, r.selector)
        names = re.findall(r"\[@?([\w:-]+)", r.selector)
        for i, n in enumerate(found):
            if isinstance(n, str):
                value = n
            elif r.value == "html":
                value = n.html()
            elif r.value == "attribute":
                value = n.attrs.get(names[-1].lower(), "") if names else ""
            else:
                value = " ".join(n.text().split())
            if value.strip():
                out.append((r.name, value.strip(), i))
    return out
