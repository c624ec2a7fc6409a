"""A tolerant tree of HTML, built in one pass over the tags."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noframes", "xmp"}
#: An opening tag on the left closes these open elements, up to one that ends the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
BLOCK = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}

_MARKUP = re.compile(r"<!--(.*?)(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [iter(self.elements())]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            yield node
            stack.append(iter(node.elements()))

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def strings(self, raw: bool = False) -> Iterator[str]:
        """Text nodes in document order; those of scripts and styles only with ``raw`` or on the element itself."""
        stack: list[Iterator[Node | str]] = [iter(self.children)]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
            elif isinstance(c, str):
                yield c
            elif raw or c.tag not in ("script", "style", "template"):
                stack.append(iter(c.children))

    def text(self, separator: str = "", strip: bool = True) -> str:
        """Text nodes, stripped and without empty ones, joined by a separator."""
        parts = (s.strip() for s in self.strings()) if strip else self.strings()
        return separator.join(p for p in parts if p)

    def content(self) -> str:
        """All text with its inner white space, scripts included."""
        return "".join(self.strings(raw=True))

    def remove(self) -> None:
        """Take the element out of its tree; text around it stays."""
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def copy(self, parent: Node | None = None) -> Node:
        out = Node(self.tag, dict(self.attrs), parent)
        stack = [(self, out)]
        while stack:
            source, target = stack.pop()
            for c in source.children:
                if isinstance(c, str):
                    target.children.append(c)
                else:
                    n = Node(c.tag, dict(c.attrs), target)
                    target.children.append(n)
                    stack.append((c, n))
        return out

    def to_html(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        done = object()
        work: list = [self]
        while work:
            c = work.pop()
            if isinstance(c, tuple) and c[0] is done:
                out.append(f"</{c[1]}>")
            elif isinstance(c, tuple):
                out.append(c[1])
            elif isinstance(c, str):
                out.append(html.escape(c, quote=False))
            else:
                attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in c.attrs.items())
                out.append(f"<{c.tag}{attrs}>")
                if c.tag in VOID:
                    continue
                work.append((done, c.tag))
                work += [("raw", x) if c.tag in RAW and isinstance(x, str) and c.tag in ("script", "style") else x for x in reversed(c.children)]
        del stack
        return "".join(out)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        name = m.group(1).lower()
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(name, html.unescape(value))
    return out


def parse(page: str | bytes | None) -> Node:
    """The ``html`` element of a page; it always has a ``body``. Null gives an empty page."""
    if isinstance(page, bytes):
        page = page.decode("utf-8", "ignore")
    page = page or ""
    root = Node("#document")
    at: Node = root
    position = 0
    pattern = _MARKUP
    while True:
        m = pattern.search(page, position)
        text = page[position : m.start() if m else len(page)]
        if text:
            at.children.append(html.unescape(text))
        if not m:
            break
        position = m.end()
        if not m.group(3):
            continue
        tag = m.group(3).lower()
        if m.group(2):
            node: Node | None = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            at = _close(at, closed, stop)
        elif tag in BLOCK:
            at = _close(at, {"p"}, BLOCK - {"p"} | {"td", "th", "li"})
        attrs = m.group(4)
        node = Node(tag, _attributes(attrs) if attrs.strip(" /\t\r\n") else None, at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            raw = page[position : end.start() if end else len(page)]
            if raw:
                node.children.append(raw if tag in ("script", "style") else html.unescape(raw))
            position = end.end() if end else len(page)
        elif tag not in VOID and not attrs.endswith("/") or (attrs.endswith("/") and tag not in VOID):
            at = node
    return _framed(root)


def _close(at: Node, closed: set[str], stop: set[str]) -> Node:
    """The place to insert at, after implied end tags."""
    node: Node | None = at
    result = at
    while node is not None and node.tag not in stop:
        if node.tag in closed and node.parent is not None:
            result = node.parent
        node = node.parent
    return result


def _framed(root: Node) -> Node:
    """Puts loose content into html and body."""
    top = next((n for n in root.elements() if n.tag == "html"), None) or Node("html")
    loose = [c for c in root.children if c is not top]
    every = top.children + loose if top.parent is not None else loose
    top.parent = None
    body = next((c for c in every if isinstance(c, Node) and c.tag == "body"), None)
    head = next((c for c in every if isinstance(c, Node) and c.tag == "head"), None)
    rest = [c for c in every if c is not body and c is not head]
    if head is None:
        head = Node("head")
        head.children = [c for c in rest if isinstance(c, Node) and c.tag in HEAD] if body is None else []
        rest = [c for c in rest if c not in head.children] if head.children else rest
    if body is None:
        body = Node("body")
        inner = head.find("body")
        if inner is not None:
            inner.remove()
            body = inner
    body.children += [c for c in rest if not (isinstance(c, str) and not c.strip())]
    for parent in (head, body):
        for c in parent.children:
            if isinstance(c, Node):
                c.parent = parent
    head.parent = body.parent = top
    top.children = [head, body]
    return top
