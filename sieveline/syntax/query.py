"""Queries over syntax trees, written as parenthesised patterns.

A query is a list of patterns: `(kind field: (kind) @name "text" . (_) !field [alternatives])`. Children match in order,
others may lie between them; `.` says that none does, or that a child is the first or last. `_` matches any node, `?`, `*`
and `+` repeat. Predicates stand inside a pattern: eq, match and any-of, each also as not-, any- for some of several
captures. Anything else is refused when the query is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from sieveline.syntax.tree import Node

_TOKEN = re.compile(r"""\s+|;[^\n]*|(?P<mark>[()\[\].!?*+])|(?P<string>"(?:\\.|[^"\\])*")|(?P<capture>@[\w.\-]+)|(?P<predicate>#[\w\-]+[?!])|(?P<field>[\w\-]+:)|(?P<name>[\w\-]+)""")
#: The predicates, as (name, whether it negates, whether one of several captures is enough).
PREDICATES = {
    "#eq?": ("eq", False, False), "#not-eq?": ("eq", True, False), "#any-eq?": ("eq", False, True), "#any-not-eq?": ("eq", True, True), "#match?": ("match", False, False), "#not-match?": ("match", True, False),
    "#any-match?": ("match", False, True), "#any-not-match?": ("match", True, True), "#any-of?": ("of", False, False), "#not-any-of?": ("of", True, False),
}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


class QueryError(ValueError):
    """A query that cannot be read."""


class Pattern:
    __slots__ = ("kind", "parts", "captures", "absent", "tests", "options", "literal")

    def __init__(self, kind: str | None = None):
        self.kind = kind  # None: any node
        self.parts: list[tuple[str, str | None, Pattern | None]] = []  # (how often or ".", field, pattern)
        self.captures: list[str] = []
        self.absent: list[str] = []
        self.tests: list[tuple] = []
        self.options: list[Pattern] = []  # alternatives
        self.literal: str | None = None

    def any_kind(self) -> bool:
        return self.kind is None and not self.options and self.literal is None


class Query:
    """Patterns that were read from a text; `names` are the captures."""

    def __init__(self, text: str, kinds: set[str] | None = None):
        self.tokens = [(m.lastgroup, m[m.lastgroup]) for m in self._scan(text) if m.lastgroup]
        self.at, self.kinds, self.names = 0, kinds, set()
        self.patterns: list[Pattern] = []
        tests: list[tuple] = []
        while self.at < len(self.tokens):
            self.patterns.append(self._pattern(tests))
        if not self.patterns:
            raise QueryError("no pattern")
        for *_, capture, _ in [t for p in self.patterns for t in self._all_tests(p)]:
            if capture not in self.names:
                raise QueryError(f"unknown capture {capture}")

    @staticmethod
    def _scan(text: str) -> Iterator[re.Match]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"cannot read {text[at : at + 20]!r}")
            yield m
            at = m.end()

    @staticmethod
    def _all_tests(pattern: Pattern) -> Iterator[tuple]:
        stack = [pattern]
        while stack:
            p = stack.pop()
            yield from p.tests
            stack += [x for _, _, x in p.parts if x] + p.options

    def _peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def _next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise QueryError("it ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def _string(self, raw: str) -> str:
        return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)

    def _pattern(self, outer: list[tuple]) -> Pattern:
        kind, word = self._next()
        if word == "[":
            made = Pattern()
            while self._peek()[1] != "]":
                made.options.append(self._pattern(outer))
            self._next()
        elif kind == "string":
            made = Pattern()
            made.literal = self._string(word)
        elif kind == "name" and word == "_":
            made = Pattern()
        elif word == "(":
            made = self._node(outer)
        else:
            raise QueryError(f"unexpected {word!r}")
        while self._peek()[0] == "capture":
            made.captures.append(self._next()[1][1:])
            self.names.add(made.captures[-1])
        return made

    def _node(self, outer: list[tuple]) -> Pattern:
        if self._peek()[1] in ("(", "["):  # a group: one pattern with its predicates
            made = self._pattern(outer)
            while self._peek()[1] != ")":
                if self._peek()[1] != "(":
                    raise QueryError("a group holds one pattern and predicates")
                self._next()
                made.tests.append(self._predicate())
            self._next()
            return made
        _, name = self._next()
        if self.kinds is not None and name != "_" and name not in self.kinds:
            raise QueryError(f"no such kind of node: {name}")
        made = Pattern(None if name == "_" else name)
        while True:
            kind, word = self._peek()
            if word == ")" and kind == "mark":
                self._next()
                return made
            if kind is None:
                raise QueryError("a parenthesis is open")
            if word == "." and kind == "mark":
                self._next()
                made.parts.append((".", None, None))
            elif word == "!" and kind == "mark":
                self._next()
                made.absent.append(self._next()[1])
            elif word == "(" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "predicate":
                self._next()
                made.tests.append(self._predicate())
            else:
                field = self._next()[1][:-1] if kind == "field" else None
                inner = self._pattern(outer)
                often = self._next()[1] if self._peek()[0] == "mark" and self._peek()[1] in "?*+" else "1"
                while self._peek()[0] == "capture":
                    inner.captures.append(self._next()[1][1:])
                    self.names.add(inner.captures[-1])
                made.parts.append((often, field, inner))

    def _predicate(self) -> tuple:
        kind, word = self._next()
        if word not in PREDICATES:
            raise QueryError(f"unknown predicate {word}")
        what, negates, some = PREDICATES[word]
        kind, capture = self._next()
        if kind != "capture":
            raise QueryError(f"{word} needs a capture")
        values: list[tuple[bool, str]] = []
        while self._peek()[1] != ")":
            kind, value = self._next()
            if kind not in ("string", "capture", "name"):
                raise QueryError(f"{word}: unexpected {value!r}")
            values.append((kind == "capture", value[1:] if kind == "capture" else self._string(value) if kind == "string" else value))
        self._next()
        if what == "of" and not values or what != "of" and len(values) != 1:
            raise QueryError(f"{word}: wrong number of values")
        if what == "match":
            try:
                values = [(False, re.compile(values[0][1]))]
            except re.error as e:
                raise QueryError(f"{word}: {e}") from None
        return what, negates, some, capture[1:], values

    def matches(self, root: Node) -> Iterator[dict[str, list[Node]]]:
        """The captures of every match, in the order of the nodes at which patterns begin."""
        by_kind: dict[str, list[Pattern]] = {}
        other = []
        for p in self.patterns:
            if p.kind is None:
                other.append(p)
            else:
                by_kind.setdefault(p.kind, []).append(p)
        for node in root.walk():
            for p in [*by_kind.get(node.kind, ()), *other]:
                seen = set()
                for found in _match(p, node):
                    key = tuple(sorted((n, *(id(x) for x in v)) for n, v in found.items()))
                    if key not in seen and all(_holds(t, found) for t in self._all_tests(p)):
                        seen.add(key)
                        yield found


def _match(p: Pattern, node: Node) -> Iterator[dict[str, list[Node]]]:
    if p.options:
        inner: Iterator = (found for o in p.options for found in _match(o, node))
    elif p.literal is not None:
        inner = iter([{}]) if not node.children and node.text == p.literal else iter(())
    elif p.kind is not None and p.kind != node.kind or any(node.field(f) is not None for f in p.absent):
        return
    else:
        inner = _children(p.parts, 0, node.children, 0, False) if p.parts else iter([{}])
    for found in inner:
        if p.captures:
            found = {k: list(v) for k, v in found.items()}
            for name in p.captures:
                found.setdefault(name, []).insert(0, node)
        yield found


def _children(parts: list, k: int, children: list, at: int, tight: bool) -> Iterator[dict[str, list[Node]]]:
    """Matches of the parts from k on among the children from `at` on; tight: the first of them has to stand there."""
    if k == len(parts):
        if not tight or at == len(children):
            yield {}
        return
    often, field, pattern = parts[k]
    if often == ".":
        yield from _children(parts, k + 1, children, at, True)
        return
    some = False
    for i in range(at, min(at + 1, len(children)) if tight else len(children)):
        own, child = children[i]
        if field is not None and own != field:
            continue
        for found in _match(pattern, child):
            # a repeated part goes on with as many as follow
            rest = [*parts[:k], ("*", field, pattern), *parts[k + 1 :]] if often in "*+" else parts
            for more in _children(rest, k if often in "*+" else k + 1, children, i + 1, False):
                some = True
                yield {n: found.get(n, []) + more.get(n, []) for n in found.keys() | more.keys()}
        if some and often != "1":
            return
    if not some and often in "?*":
        yield from _children(parts, k + 1, children, at, tight)


def _holds(test: tuple, found: dict[str, list[Node]]) -> bool:
    what, negates, some, capture, values = test
    nodes = found.get(capture, [])
    if not nodes:
        return True

    def one(text: str) -> bool:
        if what == "match":
            hit = values[0][1].search(text) is not None
        else:
            options = [x.text for is_capture, v in values for x in (found.get(v, []) if is_capture else [])] + [v for is_capture, v in values if not is_capture]
            hit = text in options
        return hit != negates

    return any(one(n.text) for n in nodes) if some else all(one(n.text) for n in nodes)


def anchors(query: Query, root: Node) -> Iterator[Node]:
    """Where each match is reported: its capture `finding`, else its first capture in the text."""
    for found in query.matches(root):
        if "finding" in found:
            yield found["finding"][0]
        elif found:
            yield min((n for nodes in found.values() for n in nodes), key=lambda n: (n.start, -n.end))
