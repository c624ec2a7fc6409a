"""Markdown of an element: # headings, - bullets, no scripts or styles."""

from __future__ import annotations

import re

from pressmill.html.dom import BLOCK, Node

SKIP = {"script", "style", "template", "head", "noscript"}
_SPACE = re.compile(r"[ \t\r\n\f]+")


def _inline(node: Node) -> str:
    return "".join(_render(c) for c in node.children)


def _wrap(text: str, mark: str) -> str:
    core = text.strip()
    if not core:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def _items(node: Node, depth: int) -> str:
    out, number = [], 0
    for item in node.elements():
        if item.tag != "li":
            continue
        number += 1
        nested = "".join("\n" + _items(c, depth + 1).strip("\n") for c in item.elements() if c.tag in ("ul", "ol"))
        text = "".join(_render(c) for c in item.children if not (isinstance(c, Node) and c.tag in ("ul", "ol")))
        text = _SPACE.sub(" ", text).strip()
        bullet = f"{number}. " if node.tag == "ol" else "- "
        out.append("  " * depth + bullet + text + nested)
    return "\n\n" + "\n".join(out) + "\n\n"


def _row(row: Node) -> str:
    return "| " + " | ".join(_SPACE.sub(" ", _inline(c)).strip() for c in row.elements() if c.tag in ("td", "th")) + " |"


def _table(node: Node) -> str:
    rows = [n for n in node.walk() if n.tag == "tr"]
    if not rows:
        return _inline(node)
    width = sum(c.tag in ("td", "th") for c in rows[0].elements())
    lines = [_row(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(_row, rows[1:])]
    return "\n\n" + "\n".join(lines) + "\n\n"


def _render(node: Node | str) -> str:
    if isinstance(node, str):
        return _SPACE.sub(" ", node)
    tag = node.tag
    if tag in SKIP:
        return ""
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        text = _SPACE.sub(" ", _inline(node)).strip()
        return f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else ""
    if tag in ("b", "strong"):
        return _wrap(_inline(node), "**")
    if tag in ("i", "em"):
        return _wrap(_inline(node), "*")
    if tag in ("del", "s", "strike"):
        return _wrap(_inline(node), "~~")
    if tag == "a":
        text, href = _inline(node), node.get("href")
        core = text.strip()
        return text if not href or not core else text.replace(core, f"[{core}]({href})", 1)
    if tag == "img":
        return f"![{node.get('alt') or ''}]({node.get('src') or ''})"
    if tag == "br":
        return "\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "pre":
        return f"\n\n```\n{node.content().strip()}\n```\n\n"
    if tag == "code":
        return _wrap(node.content(), "`")
    if tag in ("ul", "ol"):
        return _items(node, 0)
    if tag == "blockquote":
        lines = [x.strip() for x in _inline(node).strip().split("\n") if x.strip()]
        return "\n\n" + "\n".join("> " + x for x in lines) + "\n\n"
    if tag == "table":
        return _table(node)
    text = _inline(node)
    return f"\n\n{text.strip()}\n\n" if tag in BLOCK or tag in ("li", "body", "html", "figcaption", "dt", "dd") else text


#: Levels of elements rendered one inside the other; what lies deeper comes out as its text.
DEEPEST = 150


def _flattened(node: Node) -> Node:
    """The element, with what lies deeper than ``DEEPEST`` levels replaced by its text; a copy only where there is such."""
    level, depth = [node], 0
    while level and depth < DEEPEST:
        level, depth = [c for n in level for c in n.elements()], depth + 1
    if not level:
        return node
    copy = node.copy()
    level = [copy]
    for _ in range(DEEPEST - 1):
        level = [c for n in level for c in n.elements()]
    for n in level:
        n.children = [n.text(" ")]
    return copy


def to_markdown(node: Node) -> str:
    """Markdown without blank lines, every line stripped."""
    node = _flattened(node)
    return "\n".join(line.strip() for line in _render(node).split("\n") if line.strip())
