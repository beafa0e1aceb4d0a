"""What installed packages offer: names of TypeScript declarations and of Python modules, with how far they can be trusted.

Files are a table (ecosystem, package, path, text), with paths inside the package's folder; one parse gives every file's exports.
Tiers: resolved (all names are known), dynamic (there may be more), unreadable (nothing to read), not-installed (no files).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.paths import resolve_dotted, resolve_relative
from sieveline.operators.code import parse, python_exports, script_exports

DECLARATIONS = r"\.d\.(ts|mts|cts)\z"
#: Suffixes of compiled Python modules.
COMPILED = r"\.(so|pyd)\z"


def _types_of(entry: object) -> str | None:
    """The declarations that an entry of an exports map names."""
    if isinstance(entry, str):
        return entry if entry.endswith((".d.ts", ".d.mts", ".d.cts")) else None
    if isinstance(entry, dict):
        found = entry.get("types")
        if isinstance(found, str):
            return found
        for key in ("import", "require", "default"):
            below = _types_of(entry.get(key)) if isinstance(entry.get(key), (dict, str)) else None
            if below:
                return below
    return None


def manifest_entries(text: str | None) -> list[tuple[str, str]]:
    """(subpath, declarations) that a package.json names; the root has the subpath ''."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    out: dict[str, str] = {}
    root = data.get("types") or data.get("typings")
    exports = data.get("exports")
    if isinstance(exports, dict) and not any(k.startswith(".") for k in exports):
        exports = {".": exports}
    for key, entry in (exports.items() if isinstance(exports, dict) else ()):
        found = _types_of(entry)
        if found and "*" not in key:
            out[key.removeprefix(".").removeprefix("/")] = found
    if isinstance(root, str):
        out[""] = root
    return [(k, v.removeprefix("./")) for k, v in out.items()]


def entries(files: DataFrame) -> DataFrame:
    """(package, subpath, path, trusted) of the declarations at which a package's surfaces begin.

    The manifest's types, then its exports, then index.d.ts, then the first declarations by name, which are a guess and not trusted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, sub, path) for p, text in zip(batch.column("package").to_pylist(), batch.column("text").to_pylist()) for sub, path in manifest_entries(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["package", "subpath", "path"])

    own = files.where("ecosystem = 'npm'")
    named = own.where("path = 'package.json'").select("package", "text").mapInArrow(run, "package string, subpath string, path string")
    declared = own.where(F.col("path").rlike(DECLARATIONS)).select("package", "path")
    spelled = F.array("path", F.concat("path", F.lit(".d.ts")), F.concat(F.regexp_replace("path", r"\.[mc]?js\z", ""), F.lit(".d.ts")), F.concat("path", F.lit("/index.d.ts")))
    exact = named.select("package", "subpath", F.posexplode(spelled).alias("k", "path")).join(declared, ["package", "path"], "left_semi").select("package", "subpath", F.lit(0).alias("rank"), "k", "path")
    index = declared.where("path = 'index.d.ts'").select("package", F.lit("").alias("subpath"), F.lit(1).alias("rank"), F.lit(0).alias("k"), "path")
    guess = declared.groupBy("package").agg(F.min("path").alias("path")).select("package", F.lit("").alias("subpath"), F.lit(2).alias("rank"), F.lit(0).alias("k"), "path")
    below = declared.select("package", F.regexp_replace("path", r"(/index)?\.d\.(ts|mts|cts)\z", "").alias("subpath"), F.lit(1).alias("rank"), F.length("path").alias("k"), "path").where("subpath not in ('', 'index')")
    best = exact.unionByName(index).unionByName(guess).unionByName(below).groupBy("package", "subpath").agg(F.min(F.struct("rank", "k", "path")).alias("b"))
    return best.select("package", "subpath", F.col("b.path").alias("path"), (F.col("b.rank") < 2).alias("trusted"))


def file_exports(files: DataFrame) -> DataFrame:
    """(ecosystem, package, path, name, value, detail) of the exports of declaration files and Python modules; a file that does not parse has the detail `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for eco, package, path, text in zip(*(batch.column(c).to_pylist() for c in ("ecosystem", "package", "path", "text"))):
                root = parse(text or "", "typescript" if eco == "npm" else "python")
                if root.has_error():
                    out.append((eco, package, path, None, None, "error"))
                found = script_exports(root, package) if eco == "npm" else python_exports(root)
                out += [(eco, package, path, r[1], r[2], r[3]) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(6)], names=["ecosystem", "package", "path", "name", "value", "detail"])

    kinds = (F.col("ecosystem") == "npm") & F.col("path").rlike(DECLARATIONS) | (F.col("ecosystem") == "pypi") & F.col("path").rlike(r"\.pyi?\z")
    return files.where(kinds).select("ecosystem", "package", "path", "text").mapInArrow(run, "ecosystem string, package string, path string, name string, value string, detail string")


def surfaces(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiers (ecosystem, package, subpath, tier), members (ecosystem, package, subpath, member)) of installed packages.

    A wildcard export is followed one level deep; one that goes further, or to a file that is not there, makes the surface dynamic.
    """
    exports = file_exports(files)
    script = entries(files).withColumn("ecosystem", F.lit("npm"))
    python = _python_entries(files)
    starts = script.select("ecosystem", "package", "subpath", "path", "trusted").unionByName(python.select("ecosystem", "package", F.lit("").alias("subpath"), "path", F.lit(True).alias("trusted")))
    at = ["ecosystem", "package", "path"]
    first = starts.join(exports, at)
    stars = first.where("detail = 'reexport'")
    target = F.when(F.col("ecosystem") == "npm", resolve_relative(F.col("path"), F.col("value"))).otherwise(resolve_dotted(F.col("path"), F.col("value")))
    spelled = F.when(F.col("ecosystem") == "npm", F.array(*(F.concat("base", F.lit(s)) for s in (".d.ts", ".d.mts", ".d.cts", "/index.d.ts", "")))).otherwise(F.array(*(F.concat("base", F.lit(s)) for s in (".py", ".pyi", "/__init__.py"))))
    plain = F.regexp_replace(target, r"(\.d)?\.[mc]?[jt]s\z", "")
    known = files.select("ecosystem", "package", "path").distinct()
    goals = stars.select("ecosystem", "package", "subpath", "trusted", F.concat_ws("#", "path", "value").alias("star"), F.when(F.col("ecosystem") == "npm", plain).otherwise(target).alias("base"))
    reached = goals.select("ecosystem", "package", "subpath", "trusted", "star", F.explode(spelled).alias("path")).join(known, at, "left_semi")
    second = reached.join(exports, at)
    lost = goals.join(reached.select("ecosystem", "package", "subpath", "star").distinct(), ["ecosystem", "package", "subpath", "star"], "left_anti")
    here = ["ecosystem", "package", "subpath"]
    open_ = (
        first.where("detail in ('dynamic', 'error')").select(*here)
        .unionByName(second.where("detail in ('dynamic', 'reexport', 'error')").select(*here))
        .unionByName(lost.select(*here))
        .unionByName(starts.where("not trusted").select(*here))
    ).distinct()
    members = first.where("name <> '*'").select(*here, F.col("name").alias("member")).unionByName(second.where("name <> '*' and name <> 'default'").select(*here, F.col("name").alias("member")))
    modules = files.where("ecosystem = 'pypi'").select("ecosystem", "package", F.lit("").alias("subpath"), F.regexp_extract("path", r"\A([A-Za-z_]\w*)(\.pyi?|\.[^/]*\.(?:so|pyd)|/__init__\.pyi?)\z", 1).alias("member")).where("member not in ('', '__init__')")
    members = members.unionByName(modules).distinct()
    tiers = starts.select(*here).distinct().join(open_.withColumn("open", F.lit(True)), here, "left").select(*here, F.when(F.col("open"), "dynamic").otherwise("resolved").alias("tier"))
    unread = files.select("ecosystem", "package").distinct().join(starts.where("subpath = ''").select("ecosystem", "package"), ["ecosystem", "package"], "left_anti").select("ecosystem", "package", F.lit("").alias("subpath"), F.lit("unreadable").alias("tier"))
    return tiers.unionByName(unread), members


def _python_entries(files: DataFrame) -> DataFrame:
    """(ecosystem, package, path) at which a Python package's surface begins: its __init__ (stubs first), or its single module."""
    own = files.where("ecosystem = 'pypi'")
    rank = F.when(F.col("path") == "__init__.pyi", 0).when(F.col("path") == "__init__.py", 1).when(F.col("path") == F.concat("package", F.lit(".pyi")), 2).when(F.col("path") == F.concat("package", F.lit(".py")), 3)
    best = own.withColumn("rank", rank).where("rank is not null").groupBy("ecosystem", "package").agg(F.min(F.struct("rank", "path")).alias("b"))
    return best.select("ecosystem", "package", F.col("b.path").alias("path"))


def site_packages(root: str, environ: dict[str, str] | None = None) -> str | None:
    """Where a project's Python packages are: the active environment, then .venv, venv and env, the newest Python in it; else a plain folder."""
    base = Path(root)
    named = (environ or {}).get("VIRTUAL_ENV")
    for home in [*([Path(named)] if named else []), *(base / n for n in (".venv", "venv", "env"))]:
        newest = sorted(home.glob("lib/python*/site-packages"), key=lambda p: [int(x) for x in p.parent.name.removeprefix("python").split(".") if x.isdigit()])
        for found in [*reversed(newest), home / "Lib" / "site-packages"]:
            if found.is_dir():
                return str(found)
    plain = base / "site-packages"
    return str(plain) if plain.is_dir() else None


