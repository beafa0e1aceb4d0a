"""JavaScript and TypeScript texts as syntax trees.

A parser by binding powers, lexing as it goes, because what a slash or an angle bracket means depends on the place. Types are
passed over, not understood. A statement that does not parse becomes an ERROR up to the next place where one can start.
"""

from __future__ import annotations

import re

from sieveline.syntax.tree import Node, Source, insert_comments

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[#$\w][$\w]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPERATOR = re.compile(r">>>=|\*\*=|<<=|>>=|>>>|===|!==|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
#: Binding powers of operators between two operands.
POWER = {"??": 4, "||": 5, "&&": 6, "|": 7, "^": 8, "&": 9, "==": 10, "!=": 10, "===": 10, "!==": 10, "<": 11, ">": 11, "<=": 11, ">=": 11, "instanceof": 11, "in": 11, "<<": 12, ">>": 12, ">>>": 12, "+": 13, "-": 13, "*": 14, "/": 14, "%": 14, "**": 15}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
KEYWORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let async await of static null true false undefined".split())
BEFORE_OPERAND = set("return typeof instanceof in of new delete void throw case do else yield await extends default".split())


class Failed(Exception):
    pass


class Token:
    __slots__ = ("kind", "text", "start", "end", "line_before")

    def __init__(self, kind: str, text: str, start: int, end: int, line_before: bool):
        self.kind, self.text, self.start, self.end, self.line_before = kind, text, start, end, line_before


class _Parser:
    def __init__(self, text: str, typed: bool, markup: bool):
        self.text, self.typed, self.markup = text, typed, markup
        self.comments: dict[int, Node] = {}
        self.cache: dict[tuple[int, bool], Token] = {}
        self.tok = Token("start", "", 0, 0, True)
        self.tok = self.lex(0, True)
        self.last = 0
        self.errors = 0
        self.depth = 0

    # tokens

    def lex(self, at: int, operand: bool) -> Token:
        """The token from a place on; operand: whether a slash would open a regular expression."""
        found = self.cache.get((at, operand))
        if found is None:
            found = self.cache[at, operand] = self._lex(at, operand)
        return found

    def _lex(self, at: int, operand: bool) -> Token:
        text, n, line = self.text, len(self.text), False
        while at < n:
            if m := _SPACE.match(text, at):
                line = line or "\n" in m[0]
                at = m.end()
            elif text.startswith("//", at) or at == 0 and text.startswith("#!"):
                end = text.find("\n", at)
                end = n if end < 0 else end
                self.comments[at] = Node("comment", at, end)
                at = end
            elif text.startswith("/*", at):
                end = text.find("*/", at + 2)
                end = n if end < 0 else end + 2
                self.comments[at] = Node("comment", at, end)
                line = line or "\n" in text[at:end]
                at = end
            else:
                break
        if at >= n:
            return Token("end", "", n, n, True)
        c = text[at]
        if c == "`":
            return Token("template", "`", at, self._template_end(at), line)
        for kind, shape in (("string", _STRING), ("name", _NAME), ("number", _NUMBER)):
            if (kind != "name" or not c.isdigit()) and (m := shape.match(text, at)):
                return Token(kind, m[0], at, m.end(), line)
        if c == "/" and operand and (m := _REGEX.match(text, at)):
            return Token("regex", m[0], at, m.end(), line)
        if m := _OPERATOR.match(text, at):
            return Token("op", m[0], at, m.end(), line)
        return Token("other", c, at, at + 1, line)

    def _template_end(self, at: int) -> int:
        text, n, at = self.text, len(self.text), at + 1
        while at < n and text[at] != "`":
            if text[at] == "\\":
                at += 2
            elif text.startswith("${", at):
                at = self._braces_end(at + 1)
            else:
                at += 1
        return min(n, at + 1)

    def _braces_end(self, at: int) -> int:
        depth, operand = 0, True
        while True:
            t = self.lex(at, operand)
            if t.kind == "end":
                return t.end
            depth += {"{": 1, "}": -1}.get(t.text, 0) if t.kind == "op" else 0
            if depth == 0:
                return t.end
            operand, at = self._operand_next(t), t.end

    @staticmethod
    def _operand_next(t: Token) -> bool:
        return t.kind == "op" and t.text not in (")", "]", "}", "++", "--") or t.kind == "name" and t.text in BEFORE_OPERAND

    def advance(self) -> Token:
        old = self.tok
        self.last = old.end
        self.tok = self.lex(old.end, self._operand_next(old) or old.text in ("}", ";") and old.kind == "op")
        return old

    def to(self, at: int, operand: bool = False) -> None:
        self.last = at
        self.tok = self.lex(at, operand)

    def mark(self):
        return self.tok, self.last

    def back(self, mark) -> None:
        self.tok, self.last = mark

    def peek(self, k: int = 1) -> Token:
        t = self.tok
        for _ in range(k):
            t = self.lex(t.end, self._operand_next(t))
        return t

    def at(self, *texts: str) -> bool:
        return self.tok.kind in ("op", "name") and self.tok.text in texts

    def take(self, text: str) -> Token:
        if not self.at(text):
            raise Failed(text)
        return self.advance()

    def taken(self, *texts: str) -> bool:
        if self.at(*texts):
            self.advance()
            return True
        return False

    def leaf(self, kind: str) -> Node:
        t = self.advance()
        return Node(kind, t.start, t.end)

    def made(self, kind: str, start: int, children: list) -> Node:
        return Node(kind, start, self.last, [c if isinstance(c, tuple) else (None, c) for c in children if c is not None])

    # statements

    def program(self) -> Node:
        out = self.statements(None)
        root = Node("program", 0, len(self.text), [(None, n) for n in out])
        seen = sorted(self.comments.values(), key=lambda c: c.start)
        insert_comments(root, [c for c in seen if not self.inside_text(root, c.start)])
        return root

    @staticmethod
    def inside_text(root: Node, at: int) -> bool:
        """Whether a place that looked like a comment lies in a string, template, text or regular expression."""
        node = root
        while node:
            if node.kind in ("string", "regex", "jsx_text", "template_chars"):
                return True
            below = next((n for _, n in node.children if n.start <= at < n.end), None)
            if below is None and node.kind == "template_string":
                return True
            node = below
        return False

    def statements(self, until: str | None) -> list[Node]:
        out = []
        while self.tok.kind != "end" and not (until and self.at(until)):
            before, mark = self.tok.start, self.mark()
            try:
                self.depth += 1
                if self.depth > 150:
                    raise Failed("depth")
                found = self.statement()
            except Failed:
                self.back(mark)
                found = self.recover(until)
            finally:
                self.depth -= 1
            if found is not None:
                out.append(found)
            if self.tok.start == before and self.tok.kind != "end":
                self.advance()
        return out

    def recover(self, until: str | None) -> Node:
        """Passes over tokens to the end of a line or statement outside brackets."""
        start, depth = self.tok.start, 0
        self.errors += 1
        while self.tok.kind != "end":
            if depth <= 0 and until and self.at(until):
                break
            t = self.advance()
            if t.kind == "op":
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(t.text, 0)
            if depth <= 0 and (t.kind == "op" and t.text in (";", "}") or self.tok.line_before):
                break
        return self.made("ERROR", start, [])

    def semicolon(self) -> None:
        if not self.taken(";") and not (self.at("}") or self.tok.kind == "end" or self.tok.line_before):
            raise Failed(";")

    def block(self, kind: str = "statement_block") -> Node:
        start = self.take("{").start
        inner = self.statements("}")
        self.take("}")
        return self.made(kind, start, inner)

    def statement(self) -> Node | None:
        t = self.tok
        start, word = t.start, t.text if t.kind in ("name", "op") else ""
        if word == "{":
            return self.block()
        if word == ";":
            return self.leaf("empty_statement")
        if word == "@":
            marks = self.decorators()
            inner = self.statement()
            if inner is None:
                raise Failed("decorated")
            target = inner.field("declaration") or inner
            target.children[:0] = [(None, m) for m in marks]
            target.start = inner.start = start
            return inner
        after = self.peek()
        call = after.kind == "op" and after.text in ("(", ".", "=", "[", "?.", ",", ";", ":", ")")
        if word == "import" and not (after.kind == "op" and after.text in ("(", ".")):
            return self.import_statement()
        if word == "export":
            return self.export_statement()
        if word in ("var", "const", "let") and not (word == "let" and call and after.text != "["):
            if word == "const" and after.text == "enum":
                self.advance()
                return self.enum(start)
            made = self.variables()
            self.semicolon()
            made.end = self.last
            return made
        if word == "function" or word == "async" and after.text == "function" and not after.line_before:
            return self.function(start, "function_declaration")
        if word == "class" or word == "abstract" and after.text == "class":
            self.taken("abstract")
            return self.class_(start, "class_declaration")
        if word in ("interface", "type", "enum", "namespace", "module", "declare") and self.typed and after.kind in ("name", "string") and not after.line_before:
            return self.type_statement(start)
        if word == "declare" and self.typed and after.text == "global":
            return self.type_statement(start)
        if word == "if":
            self.advance()
            parts = [("condition", self.parens())]
            parts.append(("consequence", self.inner()))
            if self.at("else"):
                begin = self.advance().start
                other = self.inner()
                parts.append(("alternative", Node("else_clause", begin, self.last, [(None, other)])))
            return self.made("if_statement", start, parts)
        if word == "for":
            return self.for_(start)
        if word == "while":
            self.advance()
            return self.made("while_statement", start, [("condition", self.parens()), ("body", self.inner())])
        if word == "do":
            self.advance()
            body = self.inner()
            self.take("while")
            parts = [("body", body), ("condition", self.parens())]
            self.taken(";")
            return self.made("do_statement", start, parts)
        if word == "try":
            self.advance()
            parts = [("body", self.block())]
            if self.at("catch"):
                begin, own = self.advance().start, []
                if self.taken("("):
                    own.append(("parameter", self.pattern()))
                    self.annotation()
                    self.take(")")
                own.append(("body", self.block()))
                parts.append(("handler", self.made("catch_clause", begin, own)))
            if self.at("finally"):
                begin = self.advance().start
                parts.append(("finalizer", self.made("finally_clause", begin, [("body", self.block())])))
            return self.made("try_statement", start, parts)
        if word == "switch":
            self.advance()
            value = self.parens()
            begin, cases = self.take("{").start, []
            while not self.at("}") and self.tok.kind != "end":
                own, at = [], self.tok.start
                if self.taken("default"):
                    kind = "switch_default"
                else:
                    self.take("case")
                    kind, own = "switch_case", [("value", self.expression())]
                self.take(":")
                while not self.at("}", "case", "default") and self.tok.kind != "end":
                    found = self.statement()
                    if found is not None:
                        own.append(("body", found))
                cases.append(self.made(kind, at, own))
            self.take("}")
            return self.made("switch_statement", start, [("value", value), ("body", Node("switch_body", begin, self.last, [(None, c) for c in cases]))])
        if word in ("return", "throw", "break", "continue") and not (after.kind == "op" and after.text in ("=", ":")):
            self.advance()
            value = None
            if not (self.at(";", "}") or self.tok.kind == "end" or self.tok.line_before):
                value = self.leaf("statement_identifier") if word in ("break", "continue") else self.expression()
            self.semicolon()
            return self.made(f"{word}_statement", start, [value])
        if word == "debugger" and not call or word == "debugger" and after.text == ";":
            self.advance()
            self.semicolon()
            return self.made("debugger_statement", start, [])
        if t.kind == "name" and after.kind == "op" and after.text == ":" and word not in KEYWORDS:
            label = self.leaf("statement_identifier")
            self.advance()
            body = self.statement()
            return self.made("labeled_statement", start, [("label", label), ("body", body)])
        value = self.expression()
        self.semicolon()
        return self.made("expression_statement", start, [value])

    def inner(self) -> Node:
        found = self.statement()
        if found is None:
            raise Failed("statement")
        return found

    def parens(self) -> Node:
        start = self.take("(").start
        value = self.expression()
        self.take(")")
        return self.made("parenthesized_expression", start, [value])

    def for_(self, start: int) -> Node:
        self.advance()
        self.taken("await")
        self.take("(")
        parts: list = []
        first = None
        if self.at("var", "const", "let"):
            first = self.variables(bare=True)
        elif not self.at(";"):
            first = self.expression(no_in=True)
        if self.at("of", "in"):
            self.advance()
            left = first
            if first.kind in ("lexical_declaration", "variable_declaration") and first.children:
                left = first.children[0][1].field("name") or first
            parts = [("left", left), ("right", self.expression())]
            kind = "for_in_statement"
        else:
            kind = "for_statement"
            parts = [("initializer", first)] if first is not None else []
            self.take(";")
            if not self.at(";"):
                parts.append(("condition", self.expression()))
            self.take(";")
            if not self.at(")"):
                parts.append(("increment", self.expression()))
        self.take(")")
        parts.append(("body", self.inner()))
        return self.made(kind, start, parts)

    def variables(self, bare: bool = False) -> Node:
        start = self.tok.start
        kind = "variable_declaration" if self.advance().text == "var" else "lexical_declaration"
        out = []
        while True:
            at = self.tok.start
            parts = [("name", self.pattern())]
            self.taken("!")
            if note := self.annotation():
                parts.append(("type", note))
            if self.taken("="):
                parts.append(("value", self.assignment(no_in=bare)))
            out.append(self.made("variable_declarator", at, parts))
            if not self.taken(","):
                return self.made(kind, start, out)

    def pattern(self) -> Node:
        """What is bound: a name, or an object or array taken apart."""
        t = self.tok
        if t.kind == "name":
            return self.leaf("identifier")
        if self.at("["):
            start, out = self.advance().start, []
            while not self.at("]"):
                if not self.taken(","):
                    out.append(self.with_default(self.rest()))
            self.advance()
            return self.made("array_pattern", start, out)
        start, out = self.take("{").start, []
        while not self.at("}"):
            if self.at("..."):
                out.append(self.rest())
            else:
                begin = self.tok.start
                key = self.property_name()
                if self.taken(":"):
                    out.append(self.made("pair_pattern", begin, [("key", key), ("value", self.with_default(self.pattern()))]))
                else:
                    key.kind = "shorthand_property_identifier_pattern"
                    out.append(self.with_default(key))
            if not self.taken(","):
                break
        self.take("}")
        return self.made("object_pattern", start, out)

    def rest(self) -> Node:
        if self.at("..."):
            start = self.advance().start
            return self.made("rest_pattern", start, [self.pattern()])
        return self.pattern()

    def with_default(self, left: Node) -> Node:
        if self.taken("="):
            return self.made("assignment_pattern", left.start, [("left", left), ("right", self.assignment())])
        return left

    # declarations

    def decorators(self) -> list[Node]:
        out = []
        while self.at("@"):
            start = self.advance().start
            out.append(self.made("decorator", start, [self.postfix(self.primary())]))
        return out

    def parameters(self) -> Node:
        start, out = self.take("(").start, []
        while not self.at(")"):
            begin, marks = self.tok.start, self.decorators()
            while self.typed and self.at("public", "private", "protected", "readonly", "override") and self.peek().kind == "name":
                self.advance()
            own = self.rest()
            self.taken("?")
            note = self.annotation()
            own = self.with_default(own)
            if note or marks:
                own = self.made("required_parameter", begin, [*marks, ("pattern", own), ("type", note) if note else None])
            out.append(own)
            if not self.taken(","):
                break
        self.take(")")
        return self.made("formal_parameters", start, out)

    def signature(self) -> list:
        self.generics()
        parts: list = [("parameters", self.parameters())]
        if note := self.annotation():
            parts.append(("return_type", note))
        return parts

    def function(self, start: int, kind: str) -> Node:
        self.taken("async")
        self.take("function")
        if self.taken("*"):
            kind = kind.replace("function", "generator_function", 1)
        parts: list = []
        if self.tok.kind == "name":
            parts.append(("name", self.leaf("identifier")))
        parts += self.signature()
        if not self.at("{"):
            self.semicolon()
            return self.made("function_signature", start, parts)
        parts.append(("body", self.block()))
        return self.made(kind, start, parts)

    def class_(self, start: int, kind: str) -> Node:
        self.take("class")
        parts: list = []
        if self.tok.kind == "name" and not self.at("extends", "implements"):
            parts.append(("name", self.leaf("type_identifier" if self.typed else "identifier")))
        self.generics()
        if self.at("extends"):
            begin = self.advance().start
            value = self.postfix(self.primary())
            self.generics()
            parts.append(self.made("class_heritage", begin, [value]))
        if self.at("implements"):
            self.advance()
            self.skip_type({"{"})
        parts.append(("body", self.class_body()))
        return self.made(kind, start, parts)

    def class_body(self) -> Node:
        begin, out = self.take("{").start, []
        while not self.at("}"):
            if self.tok.kind == "end":
                raise Failed("}")
            if self.taken(";"):
                continue
            out.append(self.member())
        self.advance()
        return self.made("class_body", begin, out)

    def member(self) -> Node:
        start, marks = self.tok.start, self.decorators()
        while self.tok.kind == "name" and self.at("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor") and (self.peek().kind in ("name", "string", "number") or self.peek().text in ("[", "*", "{")):
            if self.at("static") and self.peek().text == "{":
                self.advance()
                return self.made("class_static_block", start, [("body", self.block())])
            self.advance()
        self.taken("*")
        if self.at("[") and self.typed and self.peek(2).text == ":":
            self.skip_type({";", "}"}, lines=True)
            self.taken(";")
            return self.made("index_signature", start, [])
        name = self.property_name()
        self.taken("?", "!")
        if self.at("(", "<"):
            parts = [*marks, ("name", name), *self.signature()]
            if not self.at("{"):
                self.taken(";")
                return self.made("method_signature", start, parts)
            parts.append(("body", self.block()))
            return self.made("method_definition", start, parts)
        parts = [*marks, ("name" if self.typed else "property", name)]
        if note := self.annotation():
            parts.append(("type", note))
        if self.taken("="):
            parts.append(("value", self.assignment()))
        self.semicolon()
        return self.made("public_field_definition" if self.typed else "field_definition", start, parts)

    def property_name(self) -> Node:
        if self.at("["):
            start = self.advance().start
            value = self.assignment()
            self.take("]")
            return self.made("computed_property_name", start, [value])
        if self.tok.kind == "name":
            return self.leaf("private_property_identifier" if self.tok.text.startswith("#") else "property_identifier")
        if self.tok.kind in ("string", "number"):
            return self.leaf(self.tok.kind)
        raise Failed("property")

    # types, which are passed over

    def annotation(self) -> Node | None:
        if not self.typed or not self.at(":"):
            return None
        start = self.advance().start
        self.skip_type({",", ")", "=", ";", "}", "]", "=>", "{"}, lines=True)
        return Node("type_annotation", start, self.last)

    def skip_type(self, until: set[str], lines: bool = False) -> None:
        """Passes over a type, to a token of `until` outside brackets. A brace that opens a type is part of it."""
        operand = True
        while self.tok.kind != "end":
            t = self.tok
            if lines and t.line_before and not operand and not (t.kind == "op" and t.text in ("|", "&", "=>", "?", ":", ".", "[")):
                return
            if t.kind == "op" and t.text == "=>" and not operand and self.arrow_type:
                self.advance()
                operand, self.arrow_type = True, False
                continue
            if t.kind == "op" and t.text in until and not (operand and t.text in ("{", "[")):
                return
            if t.kind == "op" and t.text in ("(", "[", "{", "<"):
                opened = t.text
                self.skip_brackets()
                self.arrow_type = opened == "("
                operand = False
            else:
                self.advance()
                operand = t.kind == "op" and t.text in ("|", "&", "=>", "?", ":", ".", ",", "-", "+", "...") or t.text in ("keyof", "typeof", "readonly", "infer", "extends", "is", "new", "unique", "asserts", "in")
                if t.kind == "op" and t.text in (")", "]", "}", ">"):
                    return

    arrow_type = False

    def skip_brackets(self) -> None:
        close = {"(": ")", "[": "]", "{": "}", "<": ">"}
        stack = [close[self.advance().text]]
        while stack:
            t = self.tok
            if t.kind == "end":
                raise Failed(stack[-1])
            if t.kind == "op" and t.text.startswith(">") and t.text != ">=" and stack[-1] == ">":
                self.to(t.start + 1)
                stack.pop()
                continue
            self.advance()
            if t.kind == "op":
                if t.text == stack[-1]:
                    stack.pop()
                elif t.text in close and (t.text != "<" or ">" in stack):
                    stack.append(close[t.text])
                elif t.text in (")", "]", "}"):
                    while stack and stack[-1] == ">":
                        stack.pop()
                    if not stack or stack.pop() != t.text:
                        raise Failed(t.text)

    def generics(self) -> None:
        if self.typed and self.at("<"):
            self.skip_brackets()

    def enum(self, start: int) -> Node:
        self.take("enum")
        name = self.leaf("identifier")
        begin = self.tok.start
        self.skip_brackets()
        return self.made("enum_declaration", start, [("name", name), ("body", Node("enum_body", begin, self.last))])

    def type_statement(self, start: int) -> Node:
        word = self.advance().text
        if word == "declare":
            if self.at("global"):
                self.advance()
                return self.made("ambient_declaration", start, [self.block()])
            inner = self.statement()
            return self.made("ambient_declaration", start, [("declaration", inner)])
        if word == "enum":
            self.back((self.lex(start, True), start))
            return self.enum(start)
        if word in ("namespace", "module"):
            begin = self.tok.start
            name = self.leaf("string" if self.tok.kind == "string" else "identifier")
            while self.taken("."):
                self.advance()
                name = Node("nested_identifier", begin, self.last)
            body = ("body", self.block()) if self.at("{") else None
            if body is None:
                self.semicolon()
            return self.made("module" if word == "module" else "internal_module", start, [("name", name), body])
        name = self.leaf("type_identifier")
        self.generics()
        if word == "type":
            self.take("=")
            self.skip_type({";", "}"}, lines=True)
            self.taken(";")
            return self.made("type_alias_declaration", start, [("name", name)])
        if self.taken("extends"):
            self.skip_type({"{"})
        begin = self.tok.start
        self.skip_brackets()
        return self.made("interface_declaration", start, [("name", name), ("body", Node("interface_body", begin, self.last))])

    # modules

    def import_statement(self) -> Node:
        start = self.advance().start
        parts: list = []
        if self.tok.kind == "string":
            parts.append(("source", self.leaf("string")))
        else:
            if self.at("type", "typeof") and (self.peek().kind == "name" and self.peek().text != "from" or self.peek().text in ("{", "*")):
                self.advance()
            begin, own = self.tok.start, []
            if self.tok.kind == "name" and self.peek().text == "=":
                name = self.leaf("identifier")
                self.advance()
                if self.at("require"):
                    self.advance()
                    self.take("(")
                    parts.append(self.made("import_require_clause", begin, [name, ("source", self.leaf("string"))]))
                    self.take(")")
                else:
                    parts.append(self.made("import_alias", begin, [name, self.postfix(self.primary())]))
                self.semicolon()
                return self.made("import_statement", start, parts)
            while not self.at("from"):
                if self.at("*"):
                    at = self.advance().start
                    self.take("as")
                    own.append(self.made("namespace_import", at, [self.leaf("identifier")]))
                elif self.at("{"):
                    own.append(self.specifiers("named_imports", "import_specifier"))
                elif self.tok.kind == "name":
                    own.append(self.leaf("identifier"))
                else:
                    raise Failed("import")
                if not self.taken(","):
                    break
            parts.append(self.made("import_clause", begin, own))
            self.take("from")
            if self.tok.kind != "string":
                raise Failed("source")
            parts.append(("source", self.leaf("string")))
        if self.taken("with", "assert"):
            self.skip_brackets()
        self.semicolon()
        return self.made("import_statement", start, parts)

    def specifiers(self, kind: str, each: str) -> Node:
        begin, out = self.take("{").start, []
        while not self.at("}"):
            if self.at("type") and self.peek().kind == "name" and self.peek().text != "as":
                self.advance()
            at = self.tok.start
            parts = [("name", self.leaf("string" if self.tok.kind == "string" else "identifier"))]
            if self.taken("as"):
                parts.append(("alias", self.leaf("string" if self.tok.kind == "string" else "identifier")))
            out.append(self.made(each, at, parts))
            if not self.taken(","):
                break
        self.take("}")
        return self.made(kind, begin, out)

    def export_statement(self) -> Node:
        start = self.advance().start
        parts: list = []
        if self.at("type") and self.peek().text in ("{", "*"):
            self.advance()
        if self.at("*"):
            at = self.advance().start
            if self.taken("as"):
                parts.append(self.made("namespace_export", at, [self.leaf("string" if self.tok.kind == "string" else "identifier")]))
            self.take("from")
            parts.append(("source", self.leaf("string")))
            self.semicolon()
        elif self.at("{"):
            parts.append(self.specifiers("export_clause", "export_specifier"))
            if self.taken("from"):
                parts.append(("source", self.leaf("string")))
            self.semicolon()
        elif self.at("=") and self.typed:
            self.advance()
            parts.append(self.expression())
            self.semicolon()
            return self.made("export_statement", start, [Node("export_assignment", start, self.last, [c if isinstance(c, tuple) else (None, c) for c in parts])])
        elif self.at("as") and self.typed and self.peek().text == "namespace":
            self.advance()
            self.advance()
            parts.append(Node("namespace_name", self.tok.start, self.advance().end))
            self.semicolon()
        elif self.at("default"):
            self.advance()
            at = self.tok.start
            if self.at("function") or self.at("async") and self.peek().text == "function":
                parts.append(("declaration", self.function(at, "function_declaration")))
            elif self.at("class", "abstract", "@", "interface"):
                parts.append(("declaration", self.inner()))
            else:
                parts.append(("value", self.assignment()))
                self.semicolon()
            made = self.made("export_statement", start, parts)
            made.children.insert(0, (None, Node("default", start, at)))
            return made
        else:
            parts.append(("declaration", self.inner()))
        return self.made("export_statement", start, parts)

    # expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.at(","):
            return first
        out = [first]
        while self.taken(","):
            out.append(self.assignment(no_in))
        return self.made("sequence_expression", first.start, out)

    def arrow_ahead(self) -> bool:
        """Whether the parentheses here are an arrow function's parameters."""
        mark = self.mark()
        try:
            self.generics()
            if not self.at("("):
                return False
            self.skip_brackets()
            if self.at("=>"):
                return True
            if self.typed and self.at(":"):
                self.advance()
                self.arrow_type = False
                self.skip_type({"=>", ",", ")", ";", "=", "?"}, lines=True)
                return self.at("=>")
            return False
        except Failed:
            return False
        finally:
            self.back(mark)

    def arrow(self, start: int) -> Node:
        if self.at("(", "<"):
            parts = self.signature()
        else:
            parts = [("parameter", self.leaf("identifier"))]
        self.take("=>")
        parts.append(("body", self.block() if self.at("{") else self.assignment()))
        return self.made("arrow_function", start, parts)

    def assignment(self, no_in: bool = False) -> Node:
        self.depth += 1
        try:
            if self.depth > 150:
                raise Failed("depth")
            return self._assignment(no_in)
        finally:
            self.depth -= 1

    def _assignment(self, no_in: bool) -> Node:
        t = self.tok
        start = t.start
        if t.kind == "name":
            after = self.peek()
            if after.kind == "op" and after.text == "=>" and t.text not in KEYWORDS - {"async", "of", "let", "static"}:
                return self.arrow(start)
            if t.text == "async" and not after.line_before and (after.kind == "name" and self.peek(2).text == "=>" or after.text in ("(", "<")):
                mark = self.mark()
                self.advance()
                if self.tok.kind == "name" or self.arrow_ahead():
                    return self.arrow(start)
                self.back(mark)
            if t.text == "yield":
                self.advance()
                self.taken("*")
                stop = self.at(")", "]", "}", ",", ";", ":") or self.tok.kind == "end" or self.tok.line_before
                return self.made("yield_expression", start, [] if stop else [self.assignment(no_in)])
        elif self.at("(") or self.typed and self.at("<"):
            if self.arrow_ahead():
                return self.arrow(start)
        left = self.binary(0, no_in)
        if self.at("?"):
            self.advance()
            yes = self.assignment()
            self.take(":")
            return self.made("ternary_expression", start, [("condition", left), ("consequence", yes), ("alternative", self.assignment(no_in))])
        if self.tok.kind == "op" and self.tok.text in ASSIGN:
            kind = "assignment_expression" if self.advance().text == "=" else "augmented_assignment_expression"
            return self.made(kind, start, [("left", left), ("right", self.assignment(no_in))])
        return left

    def binary(self, least: int, no_in: bool) -> Node:
        left = self.unary()
        while True:
            t = self.tok
            if self.typed and t.kind == "name" and t.text in ("as", "satisfies") and not t.line_before:
                self.advance()
                self.arrow_type = False
                self.skip_type({",", ")", ";", "}", "]", ":", "=", "?", "==", "===", "!=", "!==", "&&", "||", "??", "+", "-", "*", "/", "=>"}, lines=True)
                left = self.made(f"{t.text}_expression", left.start, [left])
                continue
            power = POWER.get(t.text) if t.kind in ("op", "name") else None
            if power is None or power <= least or no_in and t.text == "in":
                return left
            self.advance()
            right = self.binary(power - (t.text == "**"), no_in)
            left = self.made("binary_expression", left.start, [("left", left), ("right", right)])

    def unary(self) -> Node:
        t = self.tok
        if t.kind == "op" and t.text in ("!", "~", "+", "-") or t.kind == "name" and t.text in ("typeof", "void", "delete"):
            self.advance()
            return self.made("unary_expression", t.start, [("argument", self.unary())])
        if self.at("++", "--"):
            self.advance()
            return self.made("update_expression", t.start, [("argument", self.unary())])
        if t.kind == "name" and t.text == "await" and self.peek().text not in (")", ",", ";", "=", "."):
            self.advance()
            return self.made("await_expression", t.start, [self.unary()])
        if self.typed and not self.markup and self.at("<"):
            self.skip_brackets()
            return self.made("type_assertion", t.start, [self.unary()])
        value = self.postfix(self.primary())
        if self.at("++", "--") and not self.tok.line_before:
            self.advance()
            return self.made("update_expression", t.start, [("argument", value)])
        return value

    def postfix(self, value: Node, calls: bool = True) -> Node:
        start = value.start
        while True:
            t = self.tok
            if t.kind == "template":
                value = self.made("call_expression", start, [("function", value), ("arguments", self.template())])
            elif t.kind != "op":
                return value
            elif t.text in (".", "?."):
                self.advance()
                if t.text == "?." and self.at("("):
                    value = self.made("call_expression", start, [("function", value), ("arguments", self.arguments())])
                elif t.text == "?." and self.at("["):
                    value = self.index(value)
                elif self.tok.kind == "name":
                    kind = "private_property_identifier" if self.tok.text.startswith("#") else "property_identifier"
                    value = self.made("member_expression", start, [("object", value), ("property", self.leaf(kind))])
                else:
                    raise Failed("member")
            elif t.text == "[":
                value = self.index(value)
            elif t.text == "(" and calls:
                value = self.made("call_expression", start, [("function", value), ("arguments", self.arguments())])
            elif t.text == "!" and self.typed and not t.line_before and self.peek().text not in ("=",):
                self.advance()
                value = self.made("non_null_expression", start, [value])
            elif t.text in ("<", "<<") and self.typed and calls:
                mark = self.mark()
                try:
                    self.skip_brackets()
                    if not self.at("(") and self.tok.kind != "template":
                        raise Failed("<")
                except (Failed, KeyError):
                    self.back(mark)
                    return value
            else:
                return value

    def index(self, value: Node) -> Node:
        self.take("[")
        index = self.expression()
        self.take("]")
        return self.made("subscript_expression", value.start, [("object", value), ("index", index)])

    def arguments(self) -> Node:
        start, out = self.take("(").start, []
        while not self.at(")"):
            out.append(self.spread())
            if not self.taken(","):
                break
        self.take(")")
        return self.made("arguments", start, out)

    def spread(self) -> Node:
        if self.at("..."):
            start = self.advance().start
            return self.made("spread_element", start, [self.assignment()])
        return self.assignment()

    def template(self) -> Node:
        t = self.tok
        out, at, end = [], t.start + 1, t.end - 1
        while at < end:
            if self.text[at] == "\\":
                at += 2
            elif self.text.startswith("${", at):
                close = self._braces_end(at + 1)
                self.to(at + 2, True)
                inner = None if self.at("}") else self.expression()
                self.last = close
                out.append(Node("template_substitution", at, close, [(None, inner)] if inner else []))
                at = close
            else:
                at += 1
        self.to(t.end)
        return Node("template_string", t.start, t.end, [(None, n) for n in out])

    def primary(self) -> Node:
        t = self.tok
        start = t.start
        if t.kind in ("string", "number", "regex"):
            return self.leaf(t.kind)
        if t.kind == "template":
            return self.template()
        if t.kind == "name":
            word = t.text
            if word in ("this", "super", "null", "true", "false", "undefined"):
                return self.leaf(word)
            if word == "function" or word == "async" and self.peek().text == "function":
                return self.function(start, "function_expression")
            if word == "class":
                return self.class_(start, "class")
            if word == "new":
                self.advance()
                if self.taken("."):
                    self.advance()
                    return self.made("meta_property", start, [])
                made = self.postfix(self.primary(), calls=False)
                self.generics()
                parts = [("constructor", made)]
                if self.at("("):
                    parts.append(("arguments", self.arguments()))
                return self.made("new_expression", start, parts)
            if word == "import":
                return self.leaf("import")
            if word in KEYWORDS - {"async", "await", "of", "let", "static", "yield"}:
                raise Failed(word)
            return self.leaf("identifier")
        if self.at("("):
            self.advance()
            value = self.expression()
            self.annotation()
            self.take(")")
            return self.made("parenthesized_expression", start, [value])
        if self.at("["):
            self.advance()
            out = []
            while not self.at("]"):
                if not self.taken(","):
                    out.append(self.spread())
                    if not self.at("]"):
                        self.take(",")
            self.advance()
            return self.made("array", start, out)
        if self.at("{"):
            return self.object()
        if self.at("@"):
            marks = self.decorators()
            made = self.class_(self.tok.start, "class")
            made.children[:0] = [(None, m) for m in marks]
            return made
        if self.at("<") and self.markup:
            return self.element()
        raise Failed(t.text)

    def object(self) -> Node:
        start, out = self.take("{").start, []
        while not self.at("}"):
            begin = self.tok.start
            if self.at("..."):
                self.advance()
                out.append(self.made("spread_element", begin, [self.assignment()]))
            else:
                while self.at("async", "get", "set", "*") and (self.at("*") or self.peek().kind in ("name", "string", "number") or self.peek().text in ("[", "*")):
                    self.advance()
                key = self.property_name()
                if self.taken(":"):
                    out.append(self.made("pair", begin, [("key", key), ("value", self.assignment())]))
                elif self.at("(", "<"):
                    out.append(self.made("method_definition", begin, [("name", key), *self.signature(), ("body", self.block())]))
                else:
                    key.kind = "shorthand_property_identifier"
                    if self.taken("="):
                        self.assignment()
                    out.append(key)
            if not self.taken(","):
                break
        self.take("}")
        return self.made("object", start, out)

    # markup in expressions

    def element(self) -> Node:
        start = self.take("<").start
        out: list = []
        name = None
        if not self.at(">"):
            begin = self.tok.start
            end = begin
            while self.tok.kind == "name" or self.at(".", "-", ":"):
                end = self.advance().end
                if self.tok.start != end:
                    break
            name = Node("identifier", begin, end)
            out.append(("name", name))
            if self.typed and self.at("<"):
                self.skip_brackets()
            while not self.at(">", "/"):
                out.append(self.attribute())
            if self.at("/"):
                self.advance()
                if not self.at(">"):
                    raise Failed(">")
                close = self.tok.end
                self.to(close)
                return Node("jsx_self_closing_element", start, close, [c if isinstance(c, tuple) else (None, c) for c in out])
        at = self.tok.end
        opening = Node("jsx_opening_element", start, at, [c if isinstance(c, tuple) else (None, c) for c in out])
        inner: list[Node] = [opening]
        text, n = self.text, len(self.text)
        while True:
            begin = at
            while at < n and text[at] not in "<{":
                at += 1
            if at > begin and text[begin:at].strip():
                inner.append(Node("jsx_text", begin, at))
            if at >= n:
                raise Failed("element")
            if text[at] == "{":
                close = self._braces_end(at)
                self.to(at + 1, True)
                value = None if self.at("}") else self.spread()
                inner.append(Node("jsx_expression", at, close, [(None, value)] if value else []))
                at = close
            elif text.startswith("</", at):
                close = text.find(">", at)
                if close < 0:
                    raise Failed("element")
                inner.append(Node("jsx_closing_element", at, close + 1))
                self.to(close + 1)
                return Node("jsx_element", start, close + 1, [(None, n_) for n_ in inner])
            else:
                self.to(at, True)
                child = self.element()
                inner.append(child)
                at = child.end

    def attribute(self) -> Node:
        start = self.tok.start
        if self.at("{"):
            close = self._braces_end(start)
            self.advance()
            value = self.spread()
            self.to(close)
            return Node("jsx_expression", start, close, [(None, value)])
        end = start
        if self.tok.kind != "name":
            raise Failed("attribute")
        while self.tok.kind == "name" or self.at("-", ":"):
            end = self.advance().end
            if not (self.tok.start == end):
                break
        parts: list = [Node("property_identifier", start, end)]
        if self.at("="):
            self.advance()
            if self.tok.kind == "string":
                parts.append(self.leaf("string"))
            elif self.at("{"):
                begin, close = self.tok.start, self._braces_end(self.tok.start)
                self.advance()
                value = self.expression()
                self.to(close)
                parts.append(Node("jsx_expression", begin, close, [(None, value)]))
            else:
                parts.append(self.element())
        return self.made("jsx_attribute", start, parts)


def tokens(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    """The tokens of a range of a text that begins where an operand may stand; comments are left out."""
    end = len(text) if end is None else end
    parser = _Parser(text, typed=False, markup=False)
    out, at, operand = [], start, True
    while at < end:
        t = parser.lex(at, operand)
        if t.kind == "end" or t.start >= end:
            break
        out.append(t)
        at, operand = t.end, parser._operand_next(t)
    return out


def parse_script(text: str, lang: str = "javascript") -> Node:
    """The tree of a JavaScript, TypeScript or TSX text."""
    source = Source(text)
    parser = _Parser(text, typed=lang in ("typescript", "tsx"), markup=lang in ("javascript", "tsx"))
    try:
        root = parser.program()
    except RecursionError:
        root = Node("program", 0, len(text), [(None, Node("ERROR", 0, len(text)))])
    return root.settle(source)
