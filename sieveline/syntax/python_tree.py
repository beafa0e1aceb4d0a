"""Python texts as syntax trees, by the standard library's parser."""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings

from sieveline.syntax.tree import Node, Source, insert_comments

#: Kinds of nodes that differ from the parser's class names only by name.
KINDS = {
    "BinOp": "binary_operator", "BoolOp": "boolean_operator", "Compare": "comparison_operator", "IfExp": "conditional_expression", "Lambda": "lambda", "List": "list", "Tuple": "tuple", "Set": "set",
    "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression", "Await": "await", "Yield": "yield", "YieldFrom": "yield",
    "Return": "return_statement", "Delete": "delete_statement", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "If": "if_statement", "With": "with_statement", "AsyncWith": "with_statement",
    "Raise": "raise_statement", "Try": "try_statement", "TryStar": "try_statement", "Assert": "assert_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "Pass": "pass_statement", "Break": "break_statement",
    "Continue": "continue_statement", "Match": "match_statement", "Slice": "slice", "NamedExpr": "named_expression", "TypeAlias": "type_alias_statement",
}
CONSTANTS = {bool: None, str: "string", bytes: "string", int: "integer", float: "float", complex: "float"}


class _Builder:
    def __init__(self, text: str):
        self.text, self.source = text, Source(text)
        self.ascii = text.isascii()

    def at(self, line: int, column: int) -> int:
        start = self.source.starts[line - 1]
        if self.ascii:
            return start + column
        end = self.source.starts[line] if line < len(self.source.starts) else len(self.text)
        return start + len(self.text[start:end].encode()[:column].decode(errors="ignore"))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def word(self, name: str, lo: int, hi: int, kind: str = "identifier") -> Node:
        """The node of a name that the parser has as text only: its first place as a whole word."""
        found = re.compile(rf"(?<![\w.]){re.escape(name)}(?!\w)").search(self.text, lo, hi)
        start = found.start() if found else lo
        return Node(kind, start, start + len(name))

    def body(self, statements: list[ast.stmt]) -> Node:
        own = [self.node(s) for s in statements]
        return Node("block", own[0].start, own[-1].end, [(None, n) for n in own])

    def parameters(self, args: ast.arguments, lo: int, hi: int) -> Node:
        start = self.text.find("(", lo, hi)
        start = lo if start < 0 else start
        own = [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]
        out = []
        for a in own:
            s, e = self.span(a)
            name = Node("identifier", s, s + len(a.arg))
            out.append(name if a.annotation is None else Node("typed_parameter", s, e, [(None, name), ("type", self.node(a.annotation))]))
        out += [self.node(d) for d in [*args.defaults, *(d for d in args.kw_defaults if d)]]
        out.sort(key=lambda n: n.start)
        depth, end = 0, start
        for end in range(start, hi):
            depth += {"(": 1, ")": -1}.get(self.text[end], 0)
            if depth == 0:
                break
        return Node("parameters", start, max(end + 1, out[-1].end if out else start), [(None, n) for n in out])

    def definition(self, node: ast.AST, kind: str) -> Node:
        start, end = self.span(node)
        body = self.body(node.body)
        name = self.word(node.name, start, end)
        children = [("name", name)]
        if kind == "function_definition":
            children.append(("parameters", self.parameters(node.args, name.end, body.start)))
            if node.returns is not None:
                children.append(("return_type", self.node(node.returns)))
        elif node.bases or node.keywords:
            own = sorted((self.node(x) for x in [*node.bases, *node.keywords]), key=lambda n: n.start)
            children.append(("superclasses", Node("argument_list", self.text.find("(", name.end), self.text.find(")", own[-1].end) + 1, [(None, n) for n in own])))
        made = Node(kind, start, end, [*children, ("body", body)])
        if not node.decorator_list:
            return made
        marks = []
        for d in node.decorator_list:
            inner = self.node(d)
            marks.append((None, Node("decorator", self.text.rfind("@", 0, inner.start), inner.end, [(None, inner)])))
        return Node("decorated_definition", marks[0][1].start, end, [*marks, ("definition", made)])

    def dotted(self, name: str, lo: int, hi: int) -> Node:
        whole = self.word(name, lo, hi, "dotted_name")
        at = whole.start
        for part in name.split("."):
            whole.children.append((None, Node("identifier", at, at + len(part))))
            at += len(part) + 1
        return whole

    def node(self, node: ast.AST) -> Node:
        start, end = self.span(node)
        kind = type(node).__name__
        if isinstance(node, ast.Expr):
            inner = self.node(node.value)
            return Node("expression_statement", start, end, [(None, inner)])
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            return self.definition(node, "function_definition")
        if isinstance(node, ast.ClassDef):
            return self.definition(node, "class_definition")
        if isinstance(node, ast.Call):
            function = self.node(node.func)
            own = sorted((self.node(x) for x in [*node.args, *node.keywords]), key=lambda n: n.start)
            opened = self.text.find("(", function.end, end)
            return Node("call", start, end, [("function", function), ("arguments", Node("argument_list", opened if opened >= 0 else function.end, end, [(None, n) for n in own]))])
        if isinstance(node, ast.keyword):
            value = ("value", self.node(node.value))
            if node.arg is None:
                return Node("dictionary_splat", start, end, [(None, value[1])])
            return Node("keyword_argument", start, end, [("name", Node("identifier", start, start + len(node.arg))), value])
        if isinstance(node, ast.Attribute):
            return Node("attribute", start, end, [("object", self.node(node.value)), ("attribute", Node("identifier", end - len(node.attr), end))])
        if isinstance(node, ast.Name):
            return Node("identifier", start, end)
        if isinstance(node, ast.Constant):
            v = node.value
            return Node({True: "true", False: "false"}[v] if isinstance(v, bool) else "none" if v is None else CONSTANTS.get(type(v), "ellipsis"), start, end)
        if isinstance(node, ast.JoinedStr):
            return Node("string", start, end, [(None, Node("interpolation", self.span(x)[0], self.span(x)[1], [("expression", self.node(x.value))])) for x in node.values if isinstance(x, ast.FormattedValue)])
        if isinstance(node, ast.Subscript):
            return Node("subscript", start, end, [("value", self.node(node.value)), ("subscript", self.node(node.slice))])
        if isinstance(node, ast.Starred):
            return Node("list_splat", start, end, [(None, self.node(node.value))])
        if isinstance(node, ast.UnaryOp):
            return Node("not_operator" if isinstance(node.op, ast.Not) else "unary_operator", start, end, [("argument", self.node(node.operand))])
        if isinstance(node, ast.BinOp):
            return Node("binary_operator", start, end, [("left", self.node(node.left)), ("right", self.node(node.right))])
        if isinstance(node, ast.Assign):
            made = None
            for target in reversed(node.targets):
                right = made or self.node(node.value)
                left = self.node(target)
                made = Node("assignment", left.start, end, [("left", left), ("right", right)])
            return Node("expression_statement", start, end, [(None, made)])
        if isinstance(node, ast.AnnAssign):
            parts = [("left", self.node(node.target)), ("type", self.node(node.annotation))] + ([("right", self.node(node.value))] if node.value else [])
            return Node("expression_statement", start, end, [(None, Node("assignment", start, end, parts))])
        if isinstance(node, ast.AugAssign):
            return Node("expression_statement", start, end, [(None, Node("augmented_assignment", start, end, [("left", self.node(node.target)), ("right", self.node(node.value))]))])
        if isinstance(node, ast.Dict):
            pairs = []
            for k, v in zip(node.keys, node.values):
                value = self.node(v)
                if k is None:
                    pairs.append(Node("dictionary_splat", value.start, value.end, [(None, value)]))
                else:
                    key = self.node(k)
                    pairs.append(Node("pair", key.start, value.end, [("key", key), ("value", value)]))
            return Node("dictionary", start, end, [(None, p) for p in pairs])
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            children, at = [], start
            if isinstance(node, ast.ImportFrom):
                kind, names = "import_from_statement", "name"
                if node.level:
                    dots = self.text.find(".", start + 4)
                    tail = self.dotted(node.module, dots + node.level, end) if node.module else None
                    children.append(("module_name", Node("relative_import", dots, tail.end if tail else dots + node.level, [(None, tail)] if tail else [])))
                else:
                    children.append(("module_name", self.dotted(node.module, start + 4, end)))
                at = self.text.find("import", children[0][1].end) + 6
            else:
                kind, names, at = "import_statement", "name", start + 6
            for a in node.names:
                if a.name == "*":
                    star = self.text.find("*", at)
                    children.append((None, Node("wildcard_import", star, star + 1)))
                    continue
                own = self.dotted(a.name, at, end)
                at = own.end
                if a.asname:
                    alias = self.word(a.asname, own.end, end)
                    at = alias.end
                    own = Node("aliased_import", own.start, alias.end, [("name", own), ("alias", alias)])
                children.append((names, own))
            return Node(kind, start, end, children)
        children = []
        for name, value in ast.iter_fields(node):
            if isinstance(value, list) and value and isinstance(value[0], ast.stmt):
                children.append(("body" if name == "body" else "alternative", self.body(value)))
            else:
                for x in value if isinstance(value, list) else [value]:
                    children += [(name if isinstance(value, ast.AST) else None, n) for n in self.parts(x)]
        children.sort(key=lambda c: c[1].start)
        return Node(KINDS.get(kind, re.sub(r"(?<!^)(?=[A-Z])", "_", kind).lower()), start, end, children)

    def parts(self, x: object) -> list[Node]:
        """Nodes of a value; of a node without a place (comprehensions, with-items, match-cases) those below it."""
        if not isinstance(x, ast.AST) or isinstance(x, (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)):
            return []
        if hasattr(x, "lineno"):
            return [self.node(x)]
        out = []
        for _, value in ast.iter_fields(x):
            if isinstance(value, list) and value and isinstance(value[0], ast.stmt):
                out.append(self.body(value))
            else:
                for y in value if isinstance(value, list) else [value]:
                    out += self.parts(y)
        return out


def parse_python(text: str) -> Node:
    """The tree of a Python text; a text that does not parse is one ERROR below its module."""
    build = _Builder(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        comments = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
        root = Node("module", 0, len(text), [(None, build.node(s)) for s in tree.body])
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError, MemoryError, IndexError):
        return Node("module", 0, len(text), [(None, Node("ERROR", 0, len(text)))]).settle(build.source)
    starts = build.source.starts
    insert_comments(root, [Node("comment", starts[t.start[0] - 1] + t.start[1], starts[t.start[0] - 1] + t.start[1] + len(t.string)) for t in comments])
    return root.settle(build.source)
