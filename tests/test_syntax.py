"""Syntax trees, queries over them, and the shipped rules on texts of our own."""

import random

import pytest

from sieveline.operators import rules
from sieveline.operators.code import is_code, parse, python_rows, script_rows
from sieveline.operators.rewrites import insert_import
from sieveline.syntax.query import Query, QueryError, anchors
from sieveline.syntax.script_tree import parse_script


def kinds(text, lang):
    return [n.kind for n in parse(text, lang).walk()]


@pytest.mark.parametrize("text", [
    "a = b / c / d; x = /[/]\\/(x)/g.test(y)", "`a ${b + `c ${d}`} e`", "async (a, {b, c: [d = 1], ...e}) => { await f(a)?.[b]?.(c) ?? d }", "for (const [k, v] of Object.entries(x)) if (k) continue; else break",
    "class A extends B { static #x = 1; get y() { return this.#x } async *z() { yield* q } static { w() } }", "label: while (true) { do x++; while (x < 3) }", "switch (a) { case 1: b(); break; default: c() }",
    "try { a() } catch { b() } finally { c() }", "export default class extends React.Component {}", "import d, * as n from 'm'; export { a as b, default } from './x'", "var a = b ? c => d : (e, f) => ({ g, h() {}, [i]: j })",
    "const e = <A b=\"c\" {...d}>it's {f ? <B/> : null} <></></A>;", "new Foo.Bar(1)(2).x`y`", "if (a) { } // end\n/* b */ let x = 1\nlet y", "a\n++b", "x = a ? (b) : c", "#!/usr/bin/env node\nf()",
])
def test_scripts_parse(text):
    assert not parse_script(text, "javascript").has_error(), parse_script(text, "javascript")


@pytest.mark.parametrize("text", [
    "interface A<T extends B> { x: T; y(z: string): void }\ntype C = { a: 1 } | (b: D) => E;\nlet f = <T,>(x: T): T => x", "abstract class A<T> implements B, C { private readonly x?: number = 1; constructor(public y: string) { super() } abstract z(): void; [k: string]: any }",
    "declare module 'x' { export function f(a?: number, ...b: string[]): Promise<Array<Map<string, number>>>; }", "enum E { A = 1, B }\nnamespace N.M { export const a = 1 }", "const a = b as unknown as C<D>; const d = e!.f satisfies G", "function f(this: A, x = 1): x is B { return g<C>(x) }",
    "export type { A } from './a'; import type B from 'b'; import x = require('y'); export = x;", "@Dec({ a: 1 })\nexport class A { @In() b: string; @Out() c(@P() d: E) {} }", "let x: (a: number) => void = () => {}; let y: A[] = [], z: [a: string, b?: number]", "function over(a: string): void;\nfunction over(a: any) { }",
    "const f = async <T>(x: T): Promise<void> => { }; type M = { [K in keyof T]?: T[K] }; declare global { interface Window { a: B } }",
])
def test_typed_scripts_parse(text):
    assert not parse_script(text, "typescript").has_error(), parse_script(text, "typescript")


def test_errors_are_kept_to_a_statement():
    root = parse_script("let a = ;\nfoo(1);\nconst = 3;\nbar();", "javascript")
    assert root.has_error() and [n.text for n in root.walk() if n.kind == "call_expression"] == ["foo(1)", "bar()"]
    assert parse("def f(:", "python").has_error()


def test_any_text_gives_a_tree():
    rng = random.Random(1)
    pieces = ["{", "}", "(", ")", "[", "]", "<", ">", "=>", "`", "${", "'", '"', "/", "//", "/*", "*/", "\n", " ", "a", "1", "=", ":", ";", ",", ".", "...", "class", "function", "import", "export", "from", "@", "?", "é", "#"]
    for _ in range(1500):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 40)))
        for lang in ("javascript", "typescript", "tsx"):
            root = parse_script(text, lang)
            assert all(0 <= n.start <= n.end <= len(text) for n in root.walk()), text


def test_places_are_lines_and_bytes():
    node = next(n for n in parse("x = 'é'; y(z)\n", "javascript").walk() if n.kind == "call_expression")
    assert (node.line, node.column) == (1, 11)
    node = next(n for n in parse("x = 'é'; y(z)\n", "python").walk() if n.kind == "call")
    assert (node.line, node.column, node.text) == (1, 11, "y(z)")


@pytest.mark.parametrize(("query", "text", "want"), [
    ("(call_expression function: (identifier) @f) @finding", "a(b(1)); c.d()", ["a(b(1))", "b(1)"]),
    ("(arguments . (string) @finding .)", "f('x'); f('y', 1); f(1, 'z')", ["'x'"]),
    ("(arguments (string) @a (string) @finding)", "f('x', 1, 'y')", ["'y'"]),
    ("((identifier) @finding (#eq? @finding \"a\"))", "a; b; a.b", ["a", "a"]),
    ("((identifier) @finding (#not-eq? @finding \"a\"))", "a; b", ["b"]),
    ("((identifier) @finding (#match? @finding \"^[ab]$\"))", "a; b; c", ["a", "b"]),
    ("((identifier) @finding (#not-match? @finding \"a\"))", "a; b", ["b"]),
    ("((identifier) @finding (#any-of? @finding \"a\" \"c\"))", "a; b; c", ["a", "c"]),
    ("((identifier) @finding (#not-any-of? @finding \"a\" \"c\"))", "a; b; c", ["b"]),
    ("(assignment_expression left: (identifier) @l right: (identifier) @r (#eq? @l @r)) @finding", "a = a; a = b", ["a = a"]),
    ("(array (number)* @n (#any-eq? @n \"2\")) @finding", "[1, 2]; [3]", ["[1, 2]"]),
    ("(array (number)+ @n (#any-match? @n \"[5-9]\")) @finding", "[1, 7]; [3]; []", ["[1, 7]"]),
    ("[(number) (string)] @finding", "1; 'a'; b", ["1", "'a'"]),
    ("(return_statement !value (_) @finding)", "function f() { return g }", ["g"]),
    ("(member_expression object: (_) @o property: \"b\") @finding", "a.b; a.c", ["a.b"]),
    ("(if_statement alternative: (_)? @e consequence: (_) @finding)", "if (a) b(); else c()", ["b();"]),
])
def test_queries(query, text, want):
    assert [n.text for n in anchors(Query(query), parse(text, "javascript"))] == want


@pytest.mark.parametrize("query", ["", "(a", "(a))", "((a) (#is? @x))", "((a) @x (#eq? @y \"1\"))", "((a) @x (#match? @x \"(\"))", "((a) @x (#eq? @x))", "{a}", "((a) @x (#any-of? @x))"])
def test_unreadable_queries_are_refused(query):
    with pytest.raises(QueryError):
        Query(query)


#: (rule, language, texts that it finds, texts that it leaves alone)
CASES = (
    ("audit/api-key-in-client-bundle", "javascript", ("const REACT_APP_K = 'AKIA0123'", "x = { VITE_A: 'sk-ant-1' }"), ("const K = 'AKIA0123'", "const VITE_A = 'hello'", "const VITE_A = env.A")),
    ("audit/client-only-validation", "tsx", ("form.reportValidity()",), ("checkValidity()", "form.check()")),
    ("audit/cookie-insecure", "javascript", ("res.cookie('a', b)", "res.cookie('a', b, { secure: false })"), ("res.cookie('a', b, { secure: true })", "cookie('a', b)", "res.cookie('a')")),
    ("audit/cookie-insecure", "python", ("r.set_cookie('a', 'b')", "r.set_cookie('a', b, secure=False)"), ("r.set_cookie('a', b)", "r.set_cookie('a', 'b', secure=True)")),
    ("audit/cors-wildcard", "typescript", ("cors({ a: 1, origin: \"*\" })",), ("cors({ origin: 'https://a' })", "other({ origin: '*' })")),
    ("audit/cors-wildcard", "python", ('app.add_middleware(CORSMiddleware, allow_origins=["*"])',), ('app.add_middleware(CORSMiddleware, allow_origins=["a"])', 'app.add_middleware(Other, allow_origins=["*"])')),
    ("audit/debug-mode-enabled", "python", ("app.run(debug=True)", "app.debug = True", "FastAPI(debug=True)"), ("app.run(debug=False)", "Flask(debug=True)", "app.debug = x")),
    ("audit/debug-mode-enabled", "javascript", ('app.set("env", "development")', 'process.env.NODE_ENV = "development"'), ("app.set('env', 'development')", 'x = "development"')),
    ("audit/eval-user-input", "javascript", ("eval(a)", "eval(a.b)", "eval(f())"), ("eval('1')", "x.eval(a)", "evaluate(a)")),
    ("audit/eval-user-input", "python", ("eval(a)", "eval(a.b)"), ("eval('1')", "ast.literal_eval(a)")),
    ("audit/exec-user-input", "javascript", ("child_process.exec(a)", "execSync('x' + a)"), ("exec('ls')", "spawn(a)", "re.exec(a)")),
    ("audit/exec-user-input", "python", ("os.system(a)", "os.system('x' + a)", "subprocess.run(a, shell=True)", "exec(a)"), ("subprocess.run(a)", "os.system('ls')", "subprocess.run(['a', b], shell=True)")),
    ("audit/shell-interpolation", "javascript", ("child_process.exec(`a ${b}`)",), ("child_process.exec(`a`)", "child_process.exec(a)")),
    ("audit/sql-string-concat", "python", ("c.execute('a' + b)", "c.execute(f'a {b}')", "c.execute('a %s' % b)"), ("c.execute('a')", "c.execute('a ?', [b])", "f('a' + b)")),
    ("audit/sql-string-concat", "typescript", ("db.query(`a ${b}`)", "db.query('a' + b)"), ("db.query(sql`a ${b}`)", "db.query('a', [b])")),
    ("audit/supabase-permissive-rls", "javascript", ("createClient(u, process.env.SUPABASE_SERVICE_ROLE_KEY)",), ("createClient(u, ANON_KEY)", "createClient(SERVICE_ROLE)")),
    ("review/debug-leftover", "javascript", ("console.trace(a)", "debugger;"), ("console.error(a)", "log(a)")),
    ("review/debug-leftover", "python", ("import pdb", "pdb.set_trace()", "breakpoint()"), ("print(a)", "import pdbx")),
    ("review/todo-introduced", "python", ("x = 1  # fixme: later",), ("x = 'TODO'", "# todos")),
    ("ship/hardcoded-port", "javascript", ("app.listen(80)",), ("app.listen(process.env.PORT)", "listen(80)")),
    ("ship/hardcoded-port", "python", ("app.run(port=80)",), ("app.run(port=p)", "app.go(port=80)")),
    ("audit/missing-auth-middleware", "javascript", ("app.get('/x', h)", "export function GET(r) {}"), ("app.get('/x', guard, h)", "app.get('/x', () => 1)", "export const GET = () => 1")),
    ("audit/missing-auth-middleware", "python", ("@app.route('/x')\ndef f(): pass", "@router.get('/x')\ndef f(): pass"), ("@app.route('/x')\n@login_required\ndef f(): pass", "@app.get('/x', dependencies=d)\ndef f(): pass")),
)


@pytest.mark.parametrize(("rule", "lang", "found", "quiet"), CASES)
def test_shipped_rules(rule, lang, found, quiet):
    own = [Query(q) for r, langs, _, q in rules.syntax_rules(rules.shipped(), list(rules.FRAMEWORKS)) if r == rule and lang in langs]
    hits = lambda text: sum(len(list(anchors(q, parse(text, lang)))) for q in own)
    assert own and all(hits(t) for t in found) and not any(hits(t) for t in quiet), [(t, hits(t)) for t in found + quiet]


def test_every_syntax_rule_has_cases():
    assert {r.id for r in rules.shipped() if any(m.query for m in r.matchers)} == {c[0] for c in CASES}


@pytest.mark.parametrize("text", [
    "id: a/x\nseverity: awful\n", "id: nopack\nseverity: high\n", "id: a/x\nseverity: high\nodd: 1\n", "id: a/x\nseverity: high\nlanguages: [cobol]\nmatchers:\n  - query: (a)\n", "id: a/x\nseverity: high\nlanguages: [python]\nmatchers:\n  - query: (a\n",
    "id: a/x\nseverity: high\nlanguages: [python]\nmatchers:\n  - query: (a)\n    secret: true\n", "id: a/x\nseverity: high\nlanguages: [python]\nmatchers:\n  - text_pattern: a\n", "- {id: a/x, severity: low}\n- {id: a/x, severity: low}\n",
])
def test_wrong_packs_are_refused(tmp_path, text):
    (tmp_path / "a.yaml").write_text(text)
    with pytest.raises(rules.PackError):
        rules.load_pack(str(tmp_path))


def test_own_packs_win(tmp_path):
    (tmp_path / "a.yml").write_text("id: audit/eval-user-input\nseverity: low\nlanguages: [python]\nmatchers:\n  - language: python\n    query: '(call function: (identifier) @f (#eq? @f \"eval\")) @finding'\n")
    pack, replaced = rules.register_rule_pack(str(tmp_path))
    assert replaced == ["audit/eval-user-input"] and [r.severity for r in pack if r.id in replaced] == ["low"]


def row_set(rows, *wanted):
    return {(r[0], r[1], r[2]) for r in rows if r[0] in wanted}


def test_script_relations():
    text = "import a, { b as c } from '@s/p/q';\nimport * as d from 'e';\nimport 'f';\nexport { g } from './h';\nconst i = require('j');\nconst { k } = require('l');\nimport('m');\na.n; d.o; i.p; z.q;\n"
    assert row_set(script_rows(text), "usage") == {("usage", "@s/p", "b"), ("usage", "@s/p", "n"), ("usage", "e", "o"), ("usage", "j", "p")}
    assert {(r[1], r[2], r[3]) for r in script_rows(text) if r[0] == "import"} == {("@s/p", "@s/p/q", "a"), ("@s/p", "@s/p/q", "c"), ("e", "e", "d"), ("f", "f", ""), ("", "./h", ""), ("j", "j", "i"), ("l", "l", ""), ("m", "m", "")}
    many = "import {" + ", ".join(f"n{i}" for i in range(400)) + "} from 'p';\n" + "function f() {" + "a;" * 400 + "}\n"
    assert len([r for r in script_rows(many) if r[0] == "import"]) == 400 and [r[1] for r in script_rows(many) if r[0] == "function"] == ["f"]
    functions = {r[1] for r in script_rows("const a = () => 1; class B { c() {} } x.d = function () {}; function e() {}") if r[0] == "function"}
    assert functions == {"a", "c", "x.d", "e"}
    names = {(r[1], r[3]) for r in script_rows("function a() {} class B {} const c = () => 1; const d = 1; @E class F {}") if r[0] == "declaration"}
    assert names == {("a", "function_declaration"), ("B", "class_declaration"), ("c", "variable_declarator"), ("F", "decorated")}
    assert row_set(script_rows("x = 'a' + b; y = `c`; z = 'd'; const w = { 'k': \"e\", l: f('g') }"), "assignment") == {("assignment", "z", "d"), ("assignment", "k", "e")}


def test_python_relations():
    text = "import a.b, c as d\nfrom e.f import g as h, i\nfrom . import j\nfrom k import *\na.x; d.y; h.z\n"
    assert row_set(python_rows(text), "usage") == {("usage", "e", "g"), ("usage", "e", "i"), ("usage", "a", "x"), ("usage", "c", "y")}
    assert row_set(python_rows("x = 'a'\ny = f'{x}'\nz = b'c'\nf(k='d')\nw = \"\"\"e\"\"\"\nv.u = 'q'\n"), "assignment") == {("assignment", "x", "a"), ("assignment", "k", "d"), ("assignment", "w", "e")}
    exports = {(r[1], r[3]) for r in python_rows("__all__ = ['a', 'b']\nimport os.path as p\nfrom m import n\ndef f(): pass\nclass C: pass\nx, y = 1, 2\nif T:\n    z = 1\ndef __getattr__(n): pass\nfrom .s import *\n") if r[0] == "export"}
    assert exports == {("a", None), ("b", None), ("p", None), ("n", None), ("f", None), ("C", None), ("x", None), ("y", None), ("z", None), ("*", "dynamic"), ("*", "reexport")}


def test_declaration_file_exports():
    text = "export declare function f(): void;\nexport const a: number, b: string;\nexport interface I {}\nexport { x as y, z } from './m';\nexport * from './n';\nexport * as ns from './o';\nexport default class D {}\ndeclare module 'other' { export function no(): void }\ndeclare module 'own' { function yes(): void }\nexport namespace N { export const inner: 1 }\n"
    from sieveline.operators.code import script_exports

    found = {(r[1], r[3]) for r in script_exports(parse(text, "typescript"), "own")}
    assert found == {("f", None), ("a", None), ("b", None), ("I", None), ("y", None), ("z", None), ("*", "reexport"), ("ns", None), ("default", None), ("yes", None), ("N", None)}
    assert {(r[1], r[3]) for r in script_exports(parse("declare const x: any; export = x;", "typescript"))} == {("*", "dynamic")}


@pytest.mark.parametrize(("text", "lang", "want"), [("a = 1\nb(a)", "python", True), ("see the notes below\nand more", "python", False), ("  x = 1\n  y = 2", "python", True), ("const a = 1;\nb(a);", "javascript", True), ("this is prose, mostly", "javascript", False), ("a", "python", False)])
def test_commented_text_is_code(text, lang, want):
    assert is_code(text, lang) == want


@pytest.mark.parametrize(("text", "want"), [
    ("x = 1\n", "import os\nx = 1\n"), ("#!/usr/bin/python\n# c\nx = 1\n", "#!/usr/bin/python\n# c\nimport os\nx = 1\n"), ('"""doc"""\nfrom __future__ import annotations\nx = 1\n', '"""doc"""\nfrom __future__ import annotations\nimport os\nx = 1\n'),
    ("import os\nx = 1\n", "import os\nx = 1\n"), ('"""doc"""', '"""doc"""\nimport os\n'), ("", "import os\n"),
])
def test_import_is_put_in_its_place(text, want):
    assert insert_import(text) == want
