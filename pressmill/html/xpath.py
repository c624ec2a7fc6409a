"""A subset of XPath 1.0 over the tree: axes, node tests, predicates and the functions that selectors use."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pressmill.html.dom import Node


class XPathError(ValueError):
    """An expression that cannot be read."""


@dataclass(frozen=True)
class Attribute:
    """An attribute node."""

    owner: Node
    name: str
    value: str


@dataclass(frozen=True)
class Text:
    """A text node."""

    owner: Node
    value: str


@dataclass
class Step:
    axis: str
    test: str
    predicates: list = field(default_factory=list)


_LEX = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>//|::|\.\.|!=|<=|>=|[/()\[\]@,.*=<>|+-])|(?P<name>[A-Za-z_][\w.-]*(?::[A-Za-z_*][\w.-]*)?))")
AXES = {"child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "attribute", "following", "preceding"}


class _Parser:
    def __init__(self, text: str) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise XPathError(text)
            self.items.append((m.lastgroup or "", m.group(m.lastgroup)))
            at = m.end()
        # "following-sibling::li" is read as a name, "::" and a name
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, text = self.peek()
        if kind == "end" or (value is not None and text != value):
            raise XPathError(f"expected {value}, found {text!r}")
        self.at += 1
        return text

    def accept(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] in ("op", "name"):
            self.at += 1
            return True
        return False

    def expression(self):
        left = self._and()
        while self.peek() == ("name", "or"):
            self.take()
            left = ("or", left, self._and())
        return left

    def _and(self):
        left = self._compare()
        while self.peek() == ("name", "and"):
            self.take()
            left = ("and", left, self._compare())
        return left

    def _compare(self):
        left = self._sum()
        while self.peek()[1] in ("=", "!=", "<", ">", "<=", ">=") and self.peek()[0] == "op":
            left = (self.take(), left, self._sum())
        return left

    def _sum(self):
        left = self._union()
        while self.peek()[0] == "op" and self.peek()[1] in "+-" and self.peek()[1]:
            left = (self.take(), left, self._union())
        return left

    def _union(self):
        left = self._path()
        while self.accept("|"):
            left = ("|", left, self._path())
        return left

    def _path(self):
        kind, text = self.peek()
        if kind == "num":
            self.take()
            return ("number", float(text))
        if kind == "str":
            self.take()
            return ("string", text[1:-1])
        if kind == "op" and text == "-":
            self.take()
            return ("-", ("number", 0.0), self._path())
        if kind == "op" and text == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            base = ("filter", inner, self._predicates())
            return self._tail(base)
        if kind == "name" and self.peek(1)[1] == "(" and text not in ("text", "node", "comment"):
            self.take()
            self.take("(")
            arguments = []
            if not self.accept(")"):
                arguments.append(self.expression())
                while self.accept(","):
                    arguments.append(self.expression())
                self.take(")")
            return self._tail(("call", text, arguments))
        steps: list[Step] = []
        absolute = False
        if self.accept("//"):
            absolute = True
            steps.append(Step("descendant-or-self", "node()"))
        elif self.accept("/"):
            absolute = True
            if self.peek()[0] == "end" or self.peek()[1] in (")", "]", "|", ","):
                return ("path", True, None, [])
        steps.append(self._step())
        self._more(steps)
        return ("path", absolute, None, steps)

    def _tail(self, base):
        if self.peek()[1] not in ("/", "//") or self.peek()[0] != "op":
            return base
        steps: list[Step] = []
        self._more(steps)
        return ("path", False, base, steps)

    def _more(self, steps: list[Step]) -> None:
        while self.peek()[0] == "op" and self.peek()[1] in ("/", "//"):
            if self.take() == "//":
                steps.append(Step("descendant-or-self", "node()"))
            steps.append(self._step())

    def _step(self) -> Step:
        if self.accept(".."):
            return Step("parent", "node()", self._predicates())
        if self.accept("."):
            return Step("self", "node()", self._predicates())
        axis = "child"
        if self.accept("@"):
            axis = "attribute"
        elif self.peek()[0] == "name" and self.peek(1)[1] == "::":
            axis = self.take()
            self.take("::")
            if axis not in AXES:
                raise XPathError(f"unknown axis {axis}")
        kind, text = self.peek()
        if text == "*" and kind == "op":
            self.take()
            test = "*"
        elif kind == "name":
            self.take()
            test = text.lower()
            if self.accept("("):
                self.take(")")
                test += "()"
        else:
            raise XPathError(f"no step at {text!r}")
        return Step(axis, test, self._predicates())

    def _predicates(self) -> list:
        out = []
        while self.accept("["):
            out.append(self.expression())
            self.take("]")
        return out


@lru_cache(maxsize=4096)
def compile_xpath(expression: str):
    p = _Parser(expression.strip())
    out = p.expression()
    if p.peek()[0] != "end":
        raise XPathError(f"cannot read {expression!r} from {p.peek()[1]!r}")
    return out


def _string(value) -> str:
    if isinstance(value, list):
        return _string(value[0]) if value else ""
    if isinstance(value, Node):
        return value.content()
    if isinstance(value, (Attribute, Text)):
        return value.value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else str(value)
    return str(value)


def _number(value) -> float:
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return float(value)
    try:
        return float(_string(value).strip())
    except ValueError:
        return float("nan")


def _truth(value) -> bool:
    if isinstance(value, list):
        return bool(value)
    if isinstance(value, float):
        return value == value and value != 0
    return bool(value)


def _axis(node, axis: str) -> list:
    if not isinstance(node, Node):
        if axis in ("parent", "ancestor", "ancestor-or-self"):
            return [node.owner, *(_axis(node.owner, "ancestor") if axis != "parent" else [])]
        return [node] if axis in ("self", "descendant-or-self") else []
    if axis == "child":
        return [c if isinstance(c, Node) else Text(node, c) for c in node.children]
    if axis == "attribute":
        return [Attribute(node, k, v) for k, v in node.attrs.items()]
    if axis == "self":
        return [node]
    if axis == "parent":
        return [node.parent] if node.parent is not None else []
    if axis in ("descendant", "descendant-or-self"):
        out: list = [node] if axis.endswith("self") else []
        stack = [iter(_axis(node, "child"))]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
            else:
                out.append(c)
                if isinstance(c, Node):
                    stack.append(iter(_axis(c, "child")))
        return out
    if axis in ("ancestor", "ancestor-or-self"):
        out = [node] if axis.endswith("self") else []
        above = node.parent
        while above is not None:
            out.append(above)
            above = above.parent
        return out
    if node.parent is None:
        return []
    own = _axis(node.parent, "child")
    at = next(i for i, c in enumerate(own) if c is node)
    if axis == "following-sibling":
        return own[at + 1 :]
    if axis == "preceding-sibling":
        return own[:at][::-1]
    rest = own[at + 1 :] if axis == "following" else own[:at][::-1]
    out = [d for c in rest for d in (_axis(c, "descendant-or-self"))]
    return out + _axis(node.parent, axis)


def _tested(node, step: Step) -> bool:
    if step.test == "node()":
        return True
    if step.test == "text()":
        return isinstance(node, Text)
    if step.test == "comment()":
        return False
    if step.axis == "attribute":
        return isinstance(node, Attribute) and step.test in ("*", node.name)
    return isinstance(node, Node) and step.test in ("*", node.tag)


def _unique(nodes: list) -> list:
    seen, out = set(), []
    for n in nodes:
        key = (id(n.owner), type(n), getattr(n, "name", None), n.value) if isinstance(n, (Attribute, Text)) else id(n)
        if key not in seen:
            seen.add(key)
            out.append(n)
    return out


def _filtered(nodes: list, predicates: list, root: Node) -> list:
    for predicate in predicates:
        kept = []
        for i, n in enumerate(nodes):
            value = _evaluate(predicate, n, i + 1, len(nodes), root)
            if value == i + 1 if isinstance(value, float) else _truth(value):
                kept.append(n)
        nodes = kept
    return nodes


def _evaluate(e, node, position: int, size: int, root: Node):
    kind = e[0]
    if kind in ("number", "string"):
        return e[1]
    if kind == "path":
        _, absolute, base, steps = e
        if base is not None:
            nodes = _evaluate(base, node, position, size, root)
            nodes = nodes if isinstance(nodes, list) else []
        else:
            nodes = [root] if absolute else [node]
        for step in steps:
            nodes = _unique([x for n in nodes for x in _filtered([c for c in _axis(n, step.axis) if _tested(c, step)], step.predicates, root)])
        return nodes
    if kind == "filter":
        value = _evaluate(e[1], node, position, size, root)
        return _filtered(value, e[2], root) if isinstance(value, list) else value
    if kind == "or":
        return _truth(_evaluate(e[1], node, position, size, root)) or _truth(_evaluate(e[2], node, position, size, root))
    if kind == "and":
        return _truth(_evaluate(e[1], node, position, size, root)) and _truth(_evaluate(e[2], node, position, size, root))
    if kind == "|":
        return _unique(_evaluate(e[1], node, position, size, root) + _evaluate(e[2], node, position, size, root))
    if kind == "call":
        return _call(e[1], e[2], node, position, size, root)
    left, right = (_evaluate(x, node, position, size, root) for x in e[1:])
    if kind in "+-":
        return _number(left) + _number(right) * (1 if kind == "+" else -1)
    return _compared(kind, left, right)


def _compared(kind: str, left, right) -> bool:
    if isinstance(left, bool) or isinstance(right, bool):
        a, b = _truth(left), _truth(right)
        return (a == b) == (kind == "=")
    for a in left if isinstance(left, list) else [left]:
        for b in right if isinstance(right, list) else [right]:
            if kind in ("=", "!="):
                same = _number(a) == _number(b) if isinstance(a, float) or isinstance(b, float) else _string(a) == _string(b)
                if same == (kind == "="):
                    return True
            else:
                x, y = _number(a), _number(b)
                if {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[kind]:
                    return True
    return False


def _call(name: str, arguments: list, node, position: int, size: int, root: Node):
    values = [_evaluate(a, node, position, size, root) for a in arguments]
    own = values[0] if values else [node]
    if name == "position":
        return float(position)
    if name == "last":
        return float(size)
    if name == "count":
        return float(len(own))
    if name == "not":
        return not _truth(own)
    if name == "boolean":
        return _truth(own)
    if name in ("true", "false"):
        return name == "true"
    if name == "contains":
        return _string(values[1]) in _string(own)
    if name == "starts-with":
        return _string(own).startswith(_string(values[1]))
    if name == "normalize-space":
        return " ".join(_string(own).split())
    if name == "translate":
        source, target = _string(values[1]), _string(values[2])
        table = {ord(c): (target[i] if i < len(target) else None) for i, c in reversed(list(enumerate(source)))}
        return _string(own).translate(table)
    if name == "concat":
        return "".join(map(_string, values))
    if name == "string":
        return _string(own)
    if name == "number":
        return _number(own)
    if name == "string-length":
        return float(len(_string(own)))
    if name == "substring-before":
        return _string(own).partition(_string(values[1]))[0] if _string(values[1]) in _string(own) else ""
    if name == "substring-after":
        return _string(own).partition(_string(values[1]))[2]
    if name == "substring":
        start = int(_number(values[1]))
        end = start + int(_number(values[2])) if len(values) > 2 else None
        return _string(own)[max(start - 1, 0) : end - 1 if end is not None else None]
    if name in ("name", "local-name"):
        first = own[0] if isinstance(own, list) and own else None
        return first.tag if isinstance(first, Node) else getattr(first, "name", "")
    raise XPathError(f"unknown function {name}")


def evaluate(root: Node, expression: str, context: Node | None = None) -> list:
    """Nodes of an expression in document order: elements, attributes and texts. A value that is no node set gives none."""
    top = Node("#document")
    top.children = [root]
    former, root.parent = root.parent, top
    try:
        value = _evaluate(compile_xpath(expression), context if context is not None else root, 1, 1, top)
    finally:
        root.parent = former
    if not isinstance(value, list) or len(value) < 2:
        return value if isinstance(value, list) else []
    order = {id(n): i for i, n in enumerate([root, *root.walk()])}
    return sorted(value, key=lambda n: order.get(id(n if isinstance(n, Node) else n.owner), -1))


def select(root: Node, expression: str, context: Node | None = None) -> list[Node]:
    """As ``evaluate``, elements only: results that are attributes or texts are no match."""
    return [n for n in evaluate(root, expression, context) if isinstance(n, Node) and n.tag != "#document"]
