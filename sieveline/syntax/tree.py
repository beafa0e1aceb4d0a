"""Nodes of syntax trees, with kinds and fields as the public grammars of the languages name them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator


class Source:
    """A text and the places in it: lines from 1, columns in UTF-8 bytes from 1."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        start = self.starts[self.line(at) - 1]
        return len(self.text[start:at].encode("utf-8", "surrogatepass")) + 1


class Node:
    """kind, the range of characters, and the named children in order as (field or None, node)."""

    __slots__ = ("kind", "start", "end", "children", "parent", "source")

    def __init__(self, kind: str, start: int, end: int, children: list[tuple[str | None, "Node"]] = ()):
        self.kind, self.start, self.end = kind, start, end
        self.children = list(children)
        self.parent: Node | None = None
        self.source: Source | None = None

    def field(self, name: str) -> "Node | None":
        return next((n for f, n in self.children if f == name), None)

    @property
    def text(self) -> str:
        return self.source.text[self.start : self.end]

    @property
    def line(self) -> int:
        return self.source.line(self.start)

    @property
    def column(self) -> int:
        return self.source.column(self.start)

    @property
    def end_line(self) -> int:
        return self.source.line(self.end)

    def walk(self) -> Iterator["Node"]:
        """The node and all below it, parents first, in order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(n for _, n in reversed(node.children))

    def settle(self, source: Source) -> "Node":
        """Gives every node its parent and source."""
        for node in self.walk():
            node.source = source
            for _, child in node.children:
                child.parent = node
        return self

    def has_error(self) -> bool:
        return any(n.kind in ("ERROR", "MISSING") for n in self.walk())

    def __repr__(self) -> str:
        inner = "".join(f" {f + ': ' if f else ''}{n!r}" for f, n in self.children)
        return f"({self.kind}{inner})"


def insert_comments(root: Node, comments: list[Node]) -> None:
    """Puts each comment below the innermost node that holds it, in order of place."""
    for comment in comments:
        node = root
        while True:
            inner = next((n for _, n in node.children if n.start <= comment.start and comment.end <= n.end and n.kind not in ("string", "template_string")), None)
            if inner is None or not inner.children and inner.kind not in BLOCKS:
                break
            node = inner
        at = next((i for i, (_, n) in enumerate(node.children) if n.start > comment.start), len(node.children))
        node.children.insert(at, (None, comment))


BLOCKS = {"program", "module", "block", "statement_block", "class_body", "object", "array", "arguments", "formal_parameters", "list", "dictionary", "argument_list", "interface_body", "object_type", "switch_body"}
