"""Relations extracted from source code.

Each file is parsed once, in Arrow batches, and yields all its rows (path, lang, kind, name, value, detail, line, col, end_line):

| kind | name | value | detail |
|-|-|-|-|
| error | class of the node | | |
| comment | line or block | its text | |
| import | package or top module, empty if relative | specifier | local binding |
| usage | package | member | subpath |
| function | its name or that of its variable | normalised tokens, if LEAST_TOKENS or more | their number |
| declaration | its name | its text | kind of node, or `decorated` |
| assignment | variable, key or parameter | the string | range of characters of the literal |
| ident | identifier | how often it stands in the file | |
| string | | literal with its quotes | |
| env | environment key | | |
| member | object | attribute | |
| export | name, or * | module of a wildcard | dynamic, reexport or empty |
| rule | rule id | matched text | kind of node |

Lines and columns are from 1, columns in UTF-8 bytes. Null texts and unknown languages have no rows.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.schema import as_findings
from sieveline.syntax.python_tree import parse_python
from sieveline.syntax.query import Query, anchors
from sieveline.syntax.script_tree import KEYWORDS, parse_script, tokens
from sieveline.syntax.tree import Node

FIELDS = ("kind", "name", "value", "detail", "line", "col", "end_line")
SCHEMA = "path string, lang string, kind string, name string, value string, detail string, line int, col int, end_line int"
#: Shortest function, in tokens, that is fingerprinted, and lines of a commented block.
LEAST_TOKENS, LEAST_LINES = 25, 3
#: A license marker counts within so many lines from the top.
LICENSE_LINES = 20
IDENTIFIERS = ("identifier", "property_identifier", "shorthand_property_identifier", "shorthand_property_identifier_pattern", "type_identifier")
SCRIPT_FUNCTIONS = ("function_declaration", "function_expression", "arrow_function", "method_definition", "generator_function_declaration", "generator_function_expression")
#: What shows that a text is code.
CODE_SHAPED = {
    "call_expression", "call", "assignment_expression", "variable_declarator", "assignment", "if_statement", "for_statement", "while_statement", "function_declaration", "function_definition",
    "class_declaration", "class_definition", "import_statement", "export_statement", "import_from_statement",
}
Row = tuple


def parse(text: str, lang: str) -> Node:
    return parse_python(text) if lang == "python" else parse_script(text, lang)


def literal(node: Node | None) -> str | None:
    """The content of a plain string; None for other nodes, for strings with values in them and for f- and b-strings."""
    if node is None or node.kind != "string" or node.children:
        return None
    m = re.fullmatch(r"""(?s)[rRuU]?(\"\"\"|'''|"|')(.*)\1""", node.text)
    return m[2] if m and len(node.text) >= 2 * len(m[1]) else None


def row(kind: str, node: Node, name: str | None, value: str | None = None, detail: str | None = None, end: Node | None = None) -> Row:
    return kind, name, value, detail, node.line, node.column, (end or node).end_line


def script_tokens(node: Node) -> list[str]:
    """Tokens below a node: names as ID, strings and templates as STR, numbers as NUM; comments go."""
    kinds = {"string": "STR", "template": "STR", "number": "NUM"}
    return ["ID" if t.kind == "name" and t.text not in KEYWORDS else kinds.get(t.kind, t.text) for t in tokens(node.source.text, node.start, node.end)]


def python_tokens(text: str) -> list[tuple[int, str]]:
    """(place, token) with names as ID, strings as STR, numbers as NUM; comments and layout dropped."""
    import io
    import keyword
    import tokenize

    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    out, depth = [], 0
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            name = tokenize.tok_name[t.type]
            token = None
            if name == "FSTRING_START":
                depth += 1
                token = "STR" if depth == 1 else None
            elif name == "FSTRING_END":
                depth -= 1
            elif depth:
                continue
            elif t.type == tokenize.NAME:
                token = t.string if keyword.iskeyword(t.string) else "ID"
            elif t.type == tokenize.STRING:
                token = "STR"
            elif t.type == tokenize.NUMBER:
                token = "NUM"
            elif t.type == tokenize.OP:
                token = t.string
            if token:
                out.append((starts[t.start[0] - 1] + t.start[1], token))
    except (tokenize.TokenError, SyntaxError, IndexError):
        return []
    return out


def package_of(spec: str) -> str:
    """The package of a script's module specifier; empty if it is relative."""
    return "" if spec.startswith((".", "/")) else "/".join(spec.split("/")[: 2 if spec.startswith("@") else 1])


def subpath_of(spec: str) -> str | None:
    return spec[len(package_of(spec)) :].strip("/") or None


def _common(root: Node) -> Iterator[Row]:
    idents: Counter = Counter()
    first: dict[str, Node] = {}
    for node in root.walk():
        if node.kind in ("ERROR", "MISSING"):
            yield row("error", node, node.kind)
        elif node.kind == "comment":
            yield row("comment", node, "block" if node.text.startswith("/*") else "line", node.text)
        elif node.kind in IDENTIFIERS:
            idents[node.text] += 1
            first.setdefault(node.text, node)
        elif node.kind in ("string", "template_string"):
            yield row("string", node, None, node.text)
    for name, n in idents.items():
        yield row("ident", first[name], name, str(n))


def _assignment(target: Node | None, value: Node | None) -> Iterator[Row]:
    text = literal(value)
    if target is not None and text:
        name = target.text if target.kind in ("identifier", "property_identifier") else literal(target)
        if name:
            yield row("assignment", value, name, text, f"{value.start}:{value.end}")


def python_rows(text: str, root: Node | None = None) -> list[Row]:
    root = root or parse_python(text)
    rows = list(_common(root))
    if any(r[0] == "error" for r in rows):
        return [r for r in rows if r[0] == "error"]
    lexed = python_tokens(text)
    bound: dict[str, str] = {}
    members: list[Node] = []
    for node in root.walk():
        kind = node.kind
        if kind in ("import_statement", "import_from_statement"):
            module = node.field("module_name")
            for child in [n for f, n in node.children if f == "name" or n.kind == "wildcard_import"]:
                whole = child.field("name") if child.kind == "aliased_import" else child
                alias = child.field("alias")
                if kind == "import_statement":
                    top = whole.text.split(".")[0]
                    bound[alias.text if alias else top] = top
                    rows.append(row("import", node, top, whole.text, alias.text if alias else top))
                else:
                    relative = module.kind == "relative_import"
                    top = "" if relative else module.text.split(".")[0]
                    star = whole.kind == "wildcard_import"
                    rows.append(row("import", node, top, module.text, "*" if star else (alias or whole).text))
                    if not relative and not star:
                        rows.append(row("usage", whole, top, whole.text))
        elif kind == "function_definition":
            own = [t for at, t in lexed if node.start <= at < node.end]
            rows.append(row("function", node, node.field("name").text, " ".join(own) if len(own) >= LEAST_TOKENS else None, str(len(own))))
        elif kind == "assignment":
            left = node.field("left")
            rows += _assignment(left if left.kind == "identifier" else None, node.field("right"))
        elif kind == "keyword_argument":
            rows += _assignment(node.field("name"), node.field("value"))
        elif kind == "attribute":
            members.append(node)
            if node.field("object").kind == "identifier":
                rows.append(row("member", node, node.field("object").text, node.field("attribute").text))
        elif kind == "subscript" and node.field("value").text == "os.environ" and literal(node.field("subscript")):
            rows.append(row("env", node.field("subscript"), literal(node.field("subscript"))))
        elif kind == "call" and node.field("function").text in ("os.getenv", "os.environ.get"):
            args = node.field("arguments").children
            if args and literal(args[0][1]):
                rows.append(row("env", args[0][1], literal(args[0][1])))
        if kind in ("function_definition", "class_definition"):
            above, decorated = node, False
            while above is not None and not decorated:
                decorated, above = above.kind == "decorated_definition", above.parent
            rows.append(row("declaration", node.field("name"), node.field("name").text, node.text, "decorated" if decorated else kind, node))
    for node in members:
        if node.field("object").kind == "identifier" and node.field("object").text in bound:
            rows.append(row("usage", node.field("attribute"), bound[node.field("object").text], node.field("attribute").text))
    return rows + list(python_exports(root))


def python_exports(root: Node) -> Iterator[Row]:
    """Names that a module offers: those at its top, and those of __all__; a wildcard or __getattr__ makes it dynamic."""
    tops = []
    for _, node in root.children:
        inner = node.children[0][1] if node.kind == "expression_statement" and node.children else node
        tops.append(inner.field("definition") if inner.kind == "decorated_definition" else inner)
        if inner.kind in ("if_statement", "try_statement"):  # what is defined under a condition counts
            tops += [x for n in inner.walk() if n.kind == "block" and n.parent is not None and n.parent.kind in ("if_statement", "try_statement", "except_handler") for _, s in n.children for x in [s.children[0][1] if s.kind == "expression_statement" and s.children else s]]
    for node in tops:
        if node.kind in ("function_definition", "class_definition"):
            name = node.field("name").text
            yield row("export", node, "*", None, "dynamic") if name == "__getattr__" else row("export", node, name)
        elif node.kind in ("assignment", "augmented_assignment"):
            left, right = node.field("left"), node.field("right")
            if left.text == "__all__":
                for n in right.walk() if right else ():
                    if literal(n):
                        yield row("export", n, literal(n), None, None)
            else:
                for n in [left] if left.kind == "identifier" else [n for _, n in left.children] if left.kind in ("tuple", "list") else []:
                    if n.kind == "identifier":
                        yield row("export", n, n.text)
        elif node.kind in ("import_statement", "import_from_statement"):
            for f, n in node.children:
                if n.kind == "wildcard_import":
                    relative = node.field("module_name").kind == "relative_import"
                    yield row("export", n, "*", node.field("module_name").text, "reexport" if relative else "dynamic")
                elif f == "name":
                    name = n.field("alias") or (n.children[0][1] if node.kind == "import_statement" and n.children else n)
                    yield row("export", n, name.text if n.kind == "aliased_import" or node.kind == "import_statement" else n.text)


def script_rows(text: str, lang: str = "javascript", root: Node | None = None) -> list[Row]:
    """Rows of a JavaScript or TypeScript text."""
    root = root or parse_script(text, lang)
    rows = list(_common(root))
    bound: dict[str, str] = {}
    members: list[Node] = []

    def bind(name: str, spec: str, at: Node) -> None:
        bound[name] = spec
        rows.append(row("import", at, package_of(spec), spec, name))

    for node in root.walk():
        kind = node.kind
        if kind == "import_statement":
            clause = next((n for _, n in node.children if n.kind in ("import_clause", "import_require_clause")), None)
            spec = literal(node.field("source") or (clause.field("source") if clause else None))
            if spec is None:
                continue
            count = len(rows)
            for _, n in clause.children if clause else ():
                if n.kind == "identifier":
                    bind(n.text, spec, node)
                elif n.kind == "namespace_import":
                    bind(n.children[0][1].text, spec, node)
                elif n.kind == "named_imports":
                    for _, s in n.children:
                        name = s.field("name")
                        rows.append(row("import", node, package_of(spec), spec, (s.field("alias") or name).text))
                        if package_of(spec):
                            rows.append(row("usage", name, package_of(spec), literal(name) or name.text, subpath_of(spec)))
            if len(rows) == count:
                rows.append(row("import", node, package_of(spec), spec, ""))
        elif kind == "export_statement" and node.field("source") is not None and literal(node.field("source")) is not None:
            spec = literal(node.field("source"))
            rows.append(row("import", node, package_of(spec), spec, ""))
        elif kind == "call_expression" and node.field("function").text in ("require", "import"):
            args = node.field("arguments").children
            spec = literal(args[0][1]) if args else None
            if spec:
                holder = node.parent
                name = holder.field("name") if holder is not None and holder.kind == "variable_declarator" else None
                if name is not None and name.kind == "identifier" and node.field("function").text == "require":
                    bind(name.text, spec, node)
                else:
                    rows.append(row("import", node, package_of(spec), spec, ""))
        elif kind in SCRIPT_FUNCTIONS:
            own = script_tokens(node)
            name = node.field("name")
            if name is None and node.parent is not None:
                name = node.parent.field("name") or node.parent.field("key") or node.parent.field("left")
            rows.append(row("function", node, name.text if name is not None else "", " ".join(own) if len(own) >= LEAST_TOKENS else None, str(len(own))))
        elif kind == "variable_declarator":
            rows += _assignment(node.field("name") if node.field("name").kind == "identifier" else None, node.field("value"))
            value = node.field("value")
            if value is not None and node.field("name").kind == "object_pattern" and value.text == "process.env":
                for _, n in node.field("name").children:
                    inner = n.field("left") if n.kind == "assignment_pattern" else n
                    key = inner.field("key") if inner.kind == "pair_pattern" else inner
                    if key is not None and key.kind != "rest_pattern":
                        rows.append(row("env", key, literal(key) or key.text))
        elif kind == "assignment_expression":
            rows += _assignment(node.field("left") if node.field("left").kind == "identifier" else None, node.field("right"))
        elif kind == "pair":
            rows += _assignment(node.field("key"), node.field("value"))
        elif kind == "member_expression":
            inner, prop = node.field("object"), node.field("property")
            members.append(node)
            if inner.kind == "identifier":
                rows.append(row("member", node, inner.text, prop.text))
            elif inner.text in ("process.env", "import.meta.env"):
                rows.append(row("env", prop, prop.text))
        elif kind == "subscript_expression" and node.field("object").text == "process.env" and literal(node.field("index")):
            rows.append(row("env", node.field("index"), literal(node.field("index"))))
        named = kind in ("function_declaration", "class_declaration", "generator_function_declaration") or kind == "variable_declarator" and node.field("value") is not None and node.field("value").kind in ("arrow_function", "function_expression") and node.field("name").kind == "identifier"
        if named and node.field("name") is not None:
            decorated = any(n.kind == "decorator" for _, n in node.children)
            rows.append(row("declaration", node.field("name"), node.field("name").text, node.text, "decorated" if decorated else kind, node))
    for node in members:
        inner = node.field("object")
        if inner.kind == "identifier" and inner.text in bound and package_of(bound[inner.text]):
            rows.append(row("usage", node.field("property"), package_of(bound[inner.text]), node.field("property").text, subpath_of(bound[inner.text])))
    return rows + list(script_exports(root))


def declared_names(node: Node) -> Iterator[Node]:
    """The names that a declaration introduces."""
    if node.kind in ("lexical_declaration", "variable_declaration"):
        for _, d in node.children:
            name = d.field("name")
            if name is not None:
                yield from [name] if name.kind == "identifier" else [n for n in name.walk() if n.kind in ("identifier", "shorthand_property_identifier_pattern")]
    elif node.kind == "ambient_declaration":
        for _, n in node.children:
            yield from declared_names(n)
    elif node.field("name") is not None and node.field("name").kind != "string":
        yield node.field("name")


def script_exports(root: Node, own: str | None = None) -> Iterator[Row]:
    """Names that a module offers. What it adds to other modules (`declare module "x"`) is not its own, unless x is `own`;
    a wildcard module or `export =` makes the surface dynamic."""
    for node in root.walk():
        foreign, at = None, node.parent
        while at is not None:
            if at.kind == "module" and at.field("name") is not None and at.field("name").kind == "string":
                foreign = literal(at.field("name"))
                break
            if at.kind == "internal_module":
                foreign = ""  # members of a namespace are not names of the module
                break
            at = at.parent
        if foreign is not None and foreign != own:
            continue
        if node.kind == "module" and node.field("name") is not None and "*" in node.field("name").text:
            yield row("export", node, "*", None, "dynamic")
        if foreign is not None and node.kind in ("function_signature", "lexical_declaration", "variable_declaration", "class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration") and node.parent.kind == "statement_block":
            for name in declared_names(node):
                yield row("export", name, name.text)
        if node.kind != "export_statement":
            continue
        spec = literal(node.field("source"))
        kinds = {n.kind: n for _, n in node.children}
        if "export_assignment" in kinds:
            yield row("export", node, "*", None, "dynamic")
        elif "default" in kinds:
            yield row("export", node, "default")
        elif "namespace_export" in kinds:
            yield row("export", node, kinds["namespace_export"].children[0][1].text)
        elif "export_clause" in kinds:
            for _, s in kinds["export_clause"].children:
                name = s.field("alias") or s.field("name")
                yield row("export", name, literal(name) or name.text)
        elif node.field("declaration") is not None:
            for name in declared_names(node.field("declaration")):
                yield row("export", name, name.text)
        elif spec is not None:
            yield row("export", node, "*", spec, "reexport" if spec.startswith(".") else "dynamic")


class Matchers:
    """The syntax rules of a pack, read once in a worker: by language, (rule id, path pattern, query)."""

    def __init__(self, rules: list[tuple[str, list[str], list[str], str]]):
        self.by_lang: dict[str, list] = {}
        for rule, langs, globs, text in rules:
            query = Query(text)
            for lang in langs:
                self.by_lang.setdefault(lang, []).append((rule, [re.compile(g.replace("\\z", r"\Z")) for g in globs], query))

    def fitting(self, path: str, lang: str) -> tuple[int, ...]:
        """Places of the language's rules whose path patterns a path fits."""
        return tuple(i for i, (_, globs, _) in enumerate(self.by_lang.get(lang, ())) if not globs or any(g.search(path) for g in globs))

    def rows(self, fitting: tuple[int, ...], lang: str, root: Node) -> Iterator[Row]:
        for i in fitting:
            rule, _, query = self.by_lang[lang][i]
            seen = set()
            for node in anchors(query, root):
                if (node.start, node.end) not in seen:
                    seen.add((node.start, node.end))
                    yield row("rule", node, rule, node.text, node.kind)


#: Characters of texts, and texts, whose rows a worker keeps, so that files that hold the same text are parsed once there.
KEPT, KEPT_TEXTS = 1 << 20, 4096


class _Kept:
    """Results by key, the oldest ones go first; so bounded by the characters of their texts and by their number."""

    def __init__(self):
        self.found: OrderedDict = OrderedDict()
        self.size = 0

    def of(self, key: tuple, size: int, make: Callable[[], object]):
        if key in self.found:
            self.found.move_to_end(key)
            return self.found[key][0]
        value = make()
        if size <= KEPT // 16:
            self.found[key] = (value, size)
            self.size += size
            while self.size > KEPT or len(self.found) > KEPT_TEXTS:
                self.size -= self.found.popitem(last=False)[1][1]
        return value


def extract(files: DataFrame, rules: list[tuple[str, list[str], list[str], str]] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
    """All rows of files (path, lang, text), or those of the given kinds; rules: what rules.syntax_rules() gives of a pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers, kept = Matchers(list(rules)), _Kept()

        def rows_of(text: str, lang: str, fitting: tuple[int, ...]) -> list[Row]:
            root = parse(text, lang)
            found = [] if kinds == ("rule",) else list(python_rows(text, root) if lang == "python" else script_rows(text, lang, root))
            found += matchers.rows(fitting, lang, root)
            return [r for r in found if r[0] in kinds] if kinds else found

        for batch in batches:
            out: list[tuple] = []
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "text"))):
                if text and lang in ("python", "javascript", "typescript", "tsx"):
                    fitting = matchers.fitting(path, lang) if not kinds or "rule" in kinds else ()
                    out += [(path, lang, *r) for r in kept.of((lang, fitting, text), len(text), lambda: rows_of(text, lang, fitting))]
            types = [pa.string()] * 6 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=["path", "lang", *FIELDS])

    return files.select("path", "lang", "text").mapInArrow(run, SCHEMA)


def rule_findings(rows: DataFrame, pack: DataFrame) -> DataFrame:
    """Findings of the rows that rules made; pack: rules.pack_frame()."""
    own = pack.select("rule_id", "severity", "confidence", "message", "remediation", "description").dropDuplicates(["rule_id"])
    hits = rows.where("kind = 'rule'").join(F.broadcast(own), F.col("name") == F.col("rule_id"))
    return as_findings(
        hits, id=F.col("rule_id"), command=F.split_part(F.col("rule_id"), F.lit("/"), F.lit(1)), severity=F.col("severity"), confidence=F.col("confidence"), file=F.col("path"), line=F.col("line"), column=F.col("col"),
        end_line=F.col("end_line"), message=F.col("message"), detail=F.when(F.col("confidence") != "high", F.col("description")), remediation=F.col("remediation"), fixable=False, seed_kind=F.col("detail"), seed_text=F.col("value"),
    )


def function_counts(rows: DataFrame) -> DataFrame:
    """By file: functions, and whether it has syntax errors."""
    return rows.groupBy("path", "lang").agg(F.count_if(F.col("kind") == "function").alias("functions"), F.max((F.col("kind") == "error")).alias("has_syntax_errors"))


def is_code(text: str, lang: str) -> bool:
    """Whether a text parses without an error and holds something that is shaped like code."""
    if lang == "python":
        import textwrap

        text = textwrap.dedent(text)
    try:
        root = parse(text, lang)
    except (RecursionError, ValueError):
        return False
    return not root.has_error() and any(n.kind in CODE_SHAPED for n in root.walk())


def comment_runs(comments: DataFrame) -> DataFrame:
    """(path, lang, line, end_line, is_doc, raw, text): neighbouring line comments as one run, each block comment alone.

    text: without comment marks; raw: as it stands, in lower case.
    """
    from pyspark.sql import Window

    own = comments.where("kind = 'comment'")
    w = Window.partitionBy("path").orderBy("line", "col")
    joined = (F.lag("name").over(w) == "line") & (F.col("name") == "line") & (F.lag("end_line").over(w) == F.col("line") - 1)
    marked = own.withColumn("opens", F.when(joined, 0).otherwise(1)).withColumn("island", F.sum("opens").over(w))
    line = F.regexp_replace("value", r"\A\s*(//|#)", "")
    inner = F.regexp_replace(F.regexp_replace(F.trim("value"), r"\A/\*", ""), r"\*/\z", "")
    block = F.array_join(F.transform(F.split(inner, "\n"), lambda x: F.regexp_replace(F.ltrim(x), r"\A\*", "")), "\n")
    parts = F.array_sort(F.collect_list(F.struct("line", "col", F.when(F.col("name") == "block", block).otherwise(line).alias("bare"), "value")))
    runs = marked.groupBy("path", "lang", "island").agg(F.min("line").alias("line"), F.max("end_line").alias("end_line"), F.max((F.col("name") == "block") & F.col("value").startswith("/**")).alias("is_doc"), parts.alias("parts"))
    joined_text = F.array_join(F.transform("parts", lambda p: p["bare"]), "\n")
    raw = F.lower(F.array_join(F.transform("parts", lambda p: p["value"]), ""))
    return runs.select("path", "lang", "line", "end_line", "is_doc", raw.alias("raw"), joined_text.alias("text"))


def commented_code(rows: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """(path, line, end_line, text) of comment runs of `least` or more lines whose text is code; documentation and license headers are none."""
    runs = comment_runs(rows).where((F.col("end_line") - F.col("line") + 1 >= least) & ~F.col("is_doc"))
    runs = runs.where(~((F.col("line") <= LICENSE_LINES) & F.col("raw").rlike("copyright|license|spdx")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept()
        for batch in batches:
            good = pa.array([kept.of((lang, t), len(t), lambda: is_code(t, lang)) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())], pa.bool_())
            yield batch.filter(good).select(["path", "line", "end_line", "text"])

    return runs.select("path", "line", "end_line", "text", "lang").mapInArrow(keep, "path string, line int, end_line int, text string")
