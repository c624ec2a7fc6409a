"""CSS selectors: types, classes, ids, attributes, combinators and structural pseudo-classes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pressmill.html.dom import Node


class SelectorError(ValueError):
    """A selector that cannot be read."""


@dataclass
class Compound:
    tag: str | None = None
    tests: list[tuple] = field(default_factory=list)
    #: how it is joined with the compound on its left: " ", ">", "+" or "~"
    joined: str = " "


_NAME = r"(?:[\w-]|\\.|[^\x00-\x7f])+"
_PART = re.compile(
    rf"(?P<type>\*|{_NAME})|\.(?P<class>{_NAME})|#(?P<id>{_NAME})"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iI])?\s*)?\]"
    rf"|::?(?P<pseudo>[\w-]+)"
)


@lru_cache(maxsize=4096)
def compile_css(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """The comma-separated alternatives of a selector; each is its compounds from left to right."""
    out, position = [], 0
    current: list[Compound] = []
    part: Compound | None = None
    joined = " "
    text = selector.strip()
    if not text:
        raise SelectorError("empty selector")
    while position < len(text):
        gap = re.compile(r"\s*([>+~,])\s*|\s+").match(text, position)
        if gap:
            sign = gap.group(1)
            position = gap.end()
            if sign == ",":
                if part is None:
                    raise SelectorError(selector)
                out.append(tuple([*current, part]))
                current, part, joined = [], None, " "
                continue
            if part is not None:
                current.append(part)
                part = None
            elif sign is None:
                continue
            joined = sign or " "
            continue
        m = _PART.match(text, position)
        if not m or (m.group("type") and part is not None):
            raise SelectorError(selector)
        position = m.end()
        if part is None:
            part = Compound(joined=joined)
        unescape = lambda s: s.replace("\\", "")
        if m.group("type"):
            part.tag = None if m.group("type") == "*" else unescape(m.group("type")).lower()
        elif m.group("class"):
            part.tests.append(("class", unescape(m.group("class"))))
        elif m.group("id"):
            part.tests.append(("id", unescape(m.group("id"))))
        elif m.group("attr"):
            value = next((v for v in (m.group("dq"), m.group("sq"), m.group("bare")) if v is not None), None)
            part.tests.append(("attr", m.group("attr").lower(), m.group("op"), value, bool(m.group("flag"))))
        else:
            name = m.group("pseudo").lower()
            argument = None
            if position < len(text) and text[position] == "(":
                depth, start = 0, position
                while position < len(text):
                    depth += {"(": 1, ")": -1}.get(text[position], 0)
                    position += 1
                    if not depth:
                        break
                if depth:
                    raise SelectorError(selector)
                argument = text[start + 1 : position - 1].strip()
            part.tests.append(_pseudo(name, argument, selector))
    if part is None:
        raise SelectorError(selector)
    out.append(tuple([*current, part]))
    return tuple(out)


def _pseudo(name: str, argument: str | None, selector: str) -> tuple:
    if name in ("not", "is", "where") and argument:
        return (name, compile_css(argument))
    if name in ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "empty"):
        return (name,)
    if name in ("nth-child", "nth-of-type", "nth-last-child") and argument:
        low = argument.lower().replace(" ", "")
        low = {"odd": "2n+1", "even": "2n"}.get(low, low)
        m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", low)
        if m:
            if m.group(3) is not None:
                return (name, 0, int(m.group(3)))
            a = m.group(1)
            return (name, int(a + "1") if a in ("", "+", "-") else int(a), int(m.group(2) or 0))
    raise SelectorError(f"unknown pseudo-class in {selector!r}")


def _attribute(value: str | None, op: str | None, wanted: str | None, fold: bool) -> bool:
    if value is None:
        return False
    if op is None:
        return True
    wanted = wanted or ""
    if fold:
        value, wanted = value.lower(), wanted.lower()
    if op == "=":
        return value == wanted
    if not wanted:
        return False
    if op == "*=":
        return wanted in value
    if op == "^=":
        return value.startswith(wanted)
    if op == "$=":
        return value.endswith(wanted)
    if op == "~=":
        return wanted in value.split()
    return value == wanted or value.startswith(wanted + "-")


def _nth(a: int, b: int, n: int) -> bool:
    return n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0


def _siblings(node: Node, same: bool = False) -> list[Node]:
    if node.parent is None:
        return [node]
    return [c for c in node.parent.children if isinstance(c, Node) and (not same or c.tag == node.tag)]


def _position(node: Node, same: bool, last: bool) -> int:
    own = _siblings(node, same)
    at = next(i for i, c in enumerate(own) if c is node)
    return len(own) - at if last else at + 1


def _test(node: Node, test: tuple) -> bool:
    kind = test[0]
    if kind == "class":
        return test[1] in node.classes()
    if kind == "id":
        return node.get("id") == test[1]
    if kind == "attr":
        return _attribute(node.get(test[1]), *test[2:])
    if kind == "not":
        return not any(_matches(node, alternative) for alternative in test[1])
    if kind in ("is", "where"):
        return any(_matches(node, alternative) for alternative in test[1])
    if kind == "empty":
        return not any(isinstance(c, Node) or c for c in node.children)
    if kind == "only-child":
        return len(_siblings(node)) == 1
    if kind in ("first-child", "first-of-type"):
        return _position(node, kind.endswith("type"), False) == 1
    if kind in ("last-child", "last-of-type"):
        return _position(node, kind.endswith("type"), True) == 1
    return _nth(test[1], test[2], _position(node, kind.endswith("type"), "last" in kind))


def _single(node: Node, part: Compound) -> bool:
    return (part.tag is None or node.tag == part.tag) and all(_test(node, t) for t in part.tests)


def _matches(node: Node, parts: tuple[Compound, ...]) -> bool:
    if not _single(node, parts[-1]):
        return False
    if len(parts) == 1:
        return True
    left, joined = parts[:-1], parts[-1].joined
    if joined == ">":
        return node.parent is not None and _matches(node.parent, left)
    if joined in "+~":
        own = _siblings(node)
        before = own[: next(i for i, c in enumerate(own) if c is node)]
        return any(_matches(c, left) for c in (before[-1:] if joined == "+" else before))
    above = node.parent
    while above is not None:
        if _matches(above, left):
            return True
        above = above.parent
    return False


def select(root: Node, selector: str, first: bool = False) -> list[Node]:
    """Elements below ``root`` that match, in document order."""
    alternatives = compile_css(selector)
    out = []
    for node in root.walk():
        if any(_matches(node, parts) for parts in alternatives):
            out.append(node)
            if first:
                break
    return out
