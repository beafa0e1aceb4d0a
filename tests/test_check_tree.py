"""check() on trees with installed packages, path aliases, changes and foreign stacks."""

import json
import subprocess

from sieveline import check
from sieveline.sources import files, installed


def put(root, tree):
    for path, text in tree.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


TREE = {
    "package.json": json.dumps({"dependencies": {"stubbed": "1", "typed-deep": "1", "bare": "1"}}),
    "requirements.txt": "pymod\nsingle\n-r more/a.txt\n",
    "more/a.txt": "-r b.txt\n",
    "more/b.txt": "-r c.txt\n",
    "more/c.txt": "-r a.txt\n-r d.txt\n",
    "more/d.txt": "deepdep\n",
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"~lib/*": ["src/lib/*"],},}} // end\n',
    "vite.config.ts": "export default { resolve: { alias: { '@ui': './src/ui' } } }\n",
    "src/a.ts": "import * as s from 'stubbed';\nimport { gone, here } from 'typed-deep';\nimport x from '~lib/x';\nimport y from '@ui/y';\nimport z from 'unknown-package';\ns.present();\ns.absent();\ngone();\nhere();\n",
    "app/m.py": "import pymod\nimport single\npymod.known()\npymod.missing()\nsingle.one()\nsingle.two()\n",
    "node_modules/stubbed/package.json": json.dumps({"types": "main.d.ts"}),
    "node_modules/stubbed/main.d.ts": "export declare function present(): void;\nexport * from './more';\n",
    "node_modules/stubbed/more.d.ts": "export declare const other: number;\n",
    "node_modules/stubbed/node_modules/inner/index.d.ts": "export declare const inner: number;\n",
    "node_modules/typed-deep/index.d.ts": "export declare function here(): void;\n",
    "node_modules/never-asked/index.d.ts": "export declare const n: number;\n",
    ".venv/lib/python3.9/site-packages/pymod/__init__.py": "def known():\n    pass\n",
    ".venv/lib/python3.12/site-packages/pymod/__init__.py": "def known():\n    pass\n",
    ".venv/lib/python3.12/site-packages/single.py": "def one():\n    pass\n",
    ".venv/pyvenv.cfg": "",
}


def test_surfaces_come_from_installed_packages(spark, tmp_path):
    put(tmp_path, TREE)
    context = check.scan(spark, str(tmp_path))
    assert {r.name for r in context.declared.collect()} == {"stubbed", "typed-deep", "bare", "pymod", "single", "deepdep"}
    assert context.aliases == ("@ui/", "~lib/")
    found = {(r.id, r.seed_text) for r in check.real(spark, context).collect()}
    assert {s for i, s in found if i == "real/nonexistent-api"} == {"stubbed.absent", "typed-deep.gone", "pymod.missing", "single.two"}
    assert {s for i, s in found if i == "real/phantom-import"} == {"unknown-package"}
    asked = spark.createDataFrame([("npm", "stubbed"), ("npm", "stubbed"), ("npm", "../up"), ("npm", None), ("pypi", "single"), ("pypi", "pymod"), ("pypi", "no")], "ecosystem string, package string")
    rows = {(r.package, r.path) for r in installed.installed_files(spark, str(tmp_path), asked).collect()}
    assert rows == {("stubbed", "package.json"), ("stubbed", "main.d.ts"), ("stubbed", "more.d.ts"), ("single", "single.py"), ("pymod", "__init__.py")}


def test_a_foreign_stack_is_noted(spark, tmp_path):
    put(tmp_path, {"go.mod": "module x\n", "main.go": "package main\n", "sub/Cargo.toml": "[package]\n"})
    out = check.real(spark, check.scan(spark, str(tmp_path))).collect()
    assert [(r.id, r.message, r.severity) for r in out] == [("real/unsupported-stack", "'rust' is not analysed", "info")]
    put(tmp_path, {"tool.py": "x = 1\n"})
    assert check.real(spark, check.scan(spark, str(tmp_path))).collect() == []


def test_only_changes_of_a_scope_are_reviewed(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    put(tmp_path, {"src/old.js": "console.log('old');\n", "src/both.js": "console.log('kept');\nconst a = 1;\n"})
    git("add", "-A")
    git("commit", "-qm", "one")
    put(tmp_path, {"src/both.js": "console.log('kept');\nconst a = 1;\nconsole.log('fresh');\n", "src/fresh.js": "console.log('untracked');\n"})
    leftover = lambda **more: {(r.file, r.line) for r in check.check(spark, str(tmp_path), **more)["kept"].collect() if r.id == "review/debug-leftover"}
    assert leftover() == {("src/old.js", 1), ("src/both.js", 1), ("src/both.js", 3), ("src/fresh.js", 1)}
    assert leftover(scope="worktree") == {("src/both.js", 3), ("src/fresh.js", 1)}


def test_requirements_in_circles(spark):
    texts = spark.createDataFrame([(f"r{i}.txt", f"-r r{(i + 1) % 12}.txt\npackage{i}\n") for i in range(12)], "path string, text string")
    rows = {(r.manifest, r.name) for r in files.requirements(texts).collect()}
    assert rows == {(f"r{i}.txt", f"package{k}") for i in range(12) for k in range(12)}
