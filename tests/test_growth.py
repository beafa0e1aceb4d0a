"""Queries and operators over larger keys and tables than the test data's, against values by hand or a plain way."""

from datetime import datetime

from pyspark.sql import functions as F

from sieveline.operators import code, detect, references, similarity
from sieveline.plans import scalar_plans


def test_sizes_of_large_keys(spark, tmp_path):
    keys = [8, 150_000, 9_000_002, 60_000_001, 3_000_000_001]
    spark.createDataFrame([(k, 1, datetime(2024, 1, 1)) for k in keys], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r["size"] for r in scalar_plans.time_functions(spark, str(tmp_path)).collect()}
    assert got == {k: _size((k * k * 2 + 1) * {0: 1, 1: 333, 2: 77_777}[k % 3]) for k in keys}


def _size(n: int) -> str:
    for unit, name in ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")):
        if n >= unit:
            return f"{n / unit:.1f} {name}"
    return f"{n} B"


def test_sites_of_names_are_those_of_resolved_imports(spark):
    rows = [("p1", 3, "npm", "a", "a", 2), ("p0", 9, "npm", "a", "./a", 1), ("p2", 1, "npm", "fs", "fs", 5), ("p3", 1, "npm", "b", "node:b", 4), ("p4", 1, "npm", "c", "./c", 7), ("p5", 2, "pypi", "X_y", "X_y", 3), ("p6", 2, "npm", "", "./z", 6), ("p7", 2, "npm", "l", "l", 8)]
    imports = spark.createDataFrame(rows, "path string, line int, ecosystem string, name string, spec string, seq int")
    known = [spark.createDataFrame(r, "ecosystem string, name string") for r in ([("pypi", "x-Y")], [("npm", "l")], [("npm", "fs")])]
    known.append(spark.createDataFrame([], "ecosystem string, name string, package string"))
    got = {tuple(r) for r in detect.import_sites(imports, *known).collect()}
    assert got == {tuple(r) for r in detect.sites_of(detect.resolve_imports(imports, *known)).collect()}
    assert got == {("npm", "a", "p0", 9, True), ("npm", "fs", "p2", 1, False), ("npm", "b", "p3", 1, False), ("npm", "c", "p4", 1, False), ("pypi", "X_y", "p5", 2, False), ("npm", "l", "p7", 2, False)}


def test_sketches_are_those_of_shingles(spark):
    texts = [(1, "a b c d e f a b c d e"), (2, "a b c d"), (3, "é ü c d e f"), (4, ""), (5, None), (6, "x  y z w v")]
    rows = spark.createDataFrame(texts, "id int, value string")
    for little in (False, True):
        hashes = similarity.shingles(F.split("value", " "), little_endian=little)
        want = {r.id: (sorted(r.hashes or []), r.sketch or []) for r in rows.select("id", hashes.alias("hashes"), similarity.sketch(hashes).alias("sketch")).collect()}
        got = similarity.sketched(rows, "value", little_endian=little).collect()
        assert {r.id: (sorted(f"{h & (1 << 64) - 1:016x}" for h in r.hashes), r.sketch) for r in got} == want
    assert {r.id for r in similarity.sketched(rows, "value", least=5).collect()} == {1, 3, 6}


def test_files_ask_for_their_bases(spark):
    paths = ["a/p.ts", "a/q/index.ts", "b", "a/r.jsx", "a/s.py", "index.js", "a/index.tsx", "a/t.ts", "c/t.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    imports = spark.createDataFrame([(b,) for b in ("a/p", "a/q", "b", "a/r.jsx", "a/r.jsx", "a/none", "a")], "base string")
    want = {r.path for r in files.join(references.reached(imports), "path", "left_anti").collect()}
    assert {r.path for r in references.orphan_files(files, imports).collect()} == want
    used = [("x/f.ts", "", "./p"), ("x/g.ts", "", "./p"), ("m.ts", "", "./n"), ("x/k.py", "", ".s"), ("k.py", "", ".u"), (None, "", "./o")]
    added = spark.createDataFrame([(p,) for p in ("x/p.ts", "p.ts", "n.js", "x/s.py", "s.py", "u.py", "o.ts")], "path string")
    assert {r.file for r in detect.orphan_files(added, spark.createDataFrame(used, "path string, name string, value string")).collect()} == {"p.ts", "s.py", "o.ts"}


def test_reexports_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(references, "REEXPORTS", 2)
    surface = spark.createDataFrame([("t", f"m{i % 7}") for i in range(20)] + [("u", "m1"), ("u", "z"), ("p3", "m1"), ("p3", "w")], "package string, member string")
    reexports = [(f"p{i}", "t") for i in range(40)] + [("p3", "u"), ("p3", "u"), ("u", "t"), ("p9", "none")]
    got = [tuple(r) for r in references.expand_reexports(surface, spark.createDataFrame(reexports, "package string, target string")).collect()]
    own = {tuple(r) for r in surface.collect()}
    assert len(got) == len(set(got)) and set(got) == own | {(p, m) for p, t in reexports for s, m in own if s == t}


def test_files_of_the_same_text_are_parsed_once(spark, monkeypatch):
    texts = ["eval(x)\n", "# a = f(1)\n# if a:\n#     g(a)\nx = 1\n"]
    files = spark.createDataFrame([(f"d{i % 3}/f{i}.py", "python", texts[i % 2]) for i in range(40)], "path string, lang string, text string").coalesce(1)
    rows = [("r", ["python"], [r"\Ad1/"], "(call function: (identifier) @f)")]
    every = sorted(map(tuple, code.extract(files, rows).collect()))
    some = sorted(map(tuple, code.extract(files, rows, ("rule", "comment")).collect()))
    assert some == [r for r in every if r[2] in ("rule", "comment")] and {r[0][:2] for r in every if r[2] == "rule"} == {"d1"}
    assert sum(r[2] == "rule" for r in every) == sum(i % 3 == 1 and i % 2 == 0 for i in range(40))
    kept, made = code._Kept(), []
    for key in [1, 2, 1, 1, 2]:
        kept.of((key,), 10, lambda: made.append(key))
    kept.of((3,), code.KEPT, lambda: made.append(3))
    assert made == [1, 2, 3] and kept.size == 20
