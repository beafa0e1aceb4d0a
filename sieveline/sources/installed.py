"""Installed packages of a project as a table of files, read by the tasks: only the packages that are asked for, and of these only what tells their surface."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.files import LARGEST
from sieveline.sources.surfaces import COMPILED, DECLARATIONS, site_packages

#: Names that are folders of packages, with a scope or without.
_NAME = re.compile(r"(@[A-Za-z0-9._-]+/)?[A-Za-z0-9_][A-Za-z0-9._-]*")
_SCRIPT, _COMPILED = re.compile(DECLARATIONS.replace("\\z", "\\Z")), re.compile(COMPILED.replace("\\z", "\\Z"))


def folders(root: str) -> tuple[str | None, str | None]:
    """Where a project's script packages and Python packages are; None where there are none."""
    scripts = Path(root) / "node_modules"
    return str(scripts) if scripts.is_dir() else None, site_packages(root)


def _files(top: Path, single: str, scripts: bool) -> Iterator[tuple[str, Path]]:
    """(path inside the package, file) of what tells a package's surface; single: the name of a module that is a file."""
    if top.is_dir():
        todo = [top]
        while todo:
            for p in sorted(todo.pop().iterdir()):
                if p.is_dir():
                    if p.name not in ("node_modules", "__pycache__") and not p.is_symlink():
                        todo.append(p)
                elif (_SCRIPT.search(p.name) or p == top / "package.json") if scripts else (p.suffix in (".py", ".pyi") or _COMPILED.search(p.name)):
                    yield str(p.relative_to(top)), p
    elif not scripts and top.parent.is_dir():
        for p in sorted(top.parent.glob(f"{single}.*")):
            if p.name in (f"{single}.py", f"{single}.pyi") or _COMPILED.search(p.name):
                yield p.name, p


def installed_files(spark: SparkSession, root: str, packages: DataFrame) -> DataFrame:
    """(ecosystem, package, path, text) of the installed ones among packages (ecosystem, package); compiled modules have an empty text, files over the cap too.

    Packages are dealt to the tasks one by one; names that could leave the folder have no files. The folder must be there for all tasks.
    """
    scripts, python = folders(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["ecosystem", "package", "path", "text"])
            rows.clear()
            return made

        for batch in batches:
            for eco, package in zip(batch.column("ecosystem").to_pylist(), batch.column("package").to_pylist()):
                home = scripts if eco == "npm" else python
                if home is None or not _NAME.fullmatch(package or ""):
                    continue
                for inside, p in _files(Path(home) / package, package, eco == "npm"):
                    plain = not _COMPILED.search(p.name) and p.stat().st_size <= LARGEST
                    rows.append((eco, package, inside, p.read_bytes().decode("utf-8", "replace") if plain else ""))
                    if len(rows) == 64:
                        yield out()
        if rows:
            yield out()

    asked = packages.select("ecosystem", "package").where("package is not null").distinct()
    return asked.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("ecosystem", "package")).mapInArrow(read, "ecosystem string, package string, path string, text string")
