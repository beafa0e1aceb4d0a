"""Trees, changes and environment keys as data sources of Spark: `spark.read.format("source_tree").load(root)` after register(spark).

Partitions are planned before the read, from a short walk or a list of changed paths, and hold about as much each; filters on path and language
are taken over by the source, so files that they leave out are neither read nor, where a path's begin rules out a folder, listed. A schema
without `text` reads no contents.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

#: Languages by the suffixes of files.
SUFFIXES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python"}
_ENV = re.compile(r"(^|/)\.env(\.[^/]*)?$")
_KEY = re.compile(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=")
#: Entries that planning lists, and the rows of a batch.
PLANNED, ROWS = 20_000, 64


def language(path: str) -> str | None:
    found = re.search(r"\.([A-Za-z]+)$", path)
    return SUFFIXES.get(found[1].lower()) if found else None


def fits(filters: list[Filter], values: dict[str, object]) -> bool:
    """Whether a row with these values passes the filters that were taken over; a null passes none."""
    for f in filters:
        value = values[f.attribute[0]]
        if value is None:
            return False
        if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value:
            return False
        if isinstance(f, StringStartsWith) and not value.startswith(f.value) or isinstance(f, StringEndsWith) and not value.endswith(f.value) or isinstance(f, StringContains) and f.value not in value:
            return False
    return True


def may_hold(filters: list[Filter], folder: str) -> bool:
    """Whether paths below a folder may pass the filters on `path`."""
    begins = [f.value for f in filters if isinstance(f, StringStartsWith) and f.attribute == ("path",)] + [f.value for f in filters if isinstance(f, EqualTo) and f.attribute == ("path",)]
    below = folder + "/" if folder else ""
    return all(b.startswith(below) or below.startswith(b) for b in begins)


class _Filtered(DataSourceReader):
    """A reader that takes over filters on some of its columns."""

    own: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema, self.filters = options, schema, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in self.own and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains, IsNotNull)):
                self.filters.append(f)
            else:
                yield f

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Share(InputPartition):
    """What a task reads: files that planning met (path, bytes), and folders to walk."""

    files: list[tuple[str, int]]
    folders: list[str]


def shares(root: str, filters: list[Filter], parts: int, planned: int = PLANNED) -> list[Share]:
    """A tree's shares: files are dealt by bytes, folders beyond the planned entries in turn."""
    from sieveline.sources.files import _opened, walk_some

    system, base = _opened(root)
    files, todo = [], [base]
    inside = lambda f: may_hold(filters, f[len(base) :].lstrip("/"))
    while todo and len(files) < planned and (len(todo) < 4 * parts or len(files) + len(todo) < planned):
        more, left = walk_some(system, [todo.pop(0)], base, 1)
        files += [f for f in more if fits(filters, {"path": f[0], "lang": language(f[0])})]
        todo += [f for f in left if inside(f)]
    out = [Share([], []) for _ in range(max(1, parts))]
    loads = [0] * len(out)
    for f in sorted(files, key=lambda f: -f[1]):
        k = loads.index(min(loads))
        loads[k] += f[1] + 4096
        out[k].files.append(f)
    for i, folder in enumerate(todo):
        out[i % len(out)].folders.append(folder)
    return [s for s in out if s.files or s.folders]


class TreeReader(_Filtered):
    own = ("path", "lang")

    def partitions(self) -> list[Share]:
        return shares(self.options["path"], self.filters, int(self.options.get("partitions", 64))) or [Share([], [])]

    def paths(self, share: Share) -> Iterator[tuple[str, int]]:
        from sieveline.sources.files import _opened, walk_some

        yield from share.files
        system, base = _opened(self.options["path"])
        todo = list(share.folders)
        while todo:
            more, left = walk_some(system, [todo.pop()], base, 1)
            todo += [f for f in left if may_hold(self.filters, f[len(base) :].lstrip("/"))]
            yield from (f for f in more if fits(self.filters, {"path": f[0], "lang": language(f[0])}))

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        from sieveline.sources.files import LARGEST, _opened

        system, base = _opened(self.options["path"])
        rows = []
        for path, size in self.paths(share):
            text = None
            if "text" in self.schema.names and size <= LARGEST:
                with system.open_input_stream(f"{base}/{path}") as f:
                    raw = f.read(LARGEST + 1)
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    pass
            row = {"path": path, "lang": language(path), "n_bytes": size, "text": text}
            rows.append(tuple(row[n] for n in self.schema.names))
            if len(rows) == ROWS:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)


class TreeSource(DataSource):
    """(path, lang, n_bytes, text) of the files of a folder; text is null for files over the cap and those that are not UTF-8, lang for other files.

    Options: path, partitions. Ignore files are rows, not rules: they are applied by files.listing().
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, lang string, n_bytes long, text string"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options), schema)


class EnvReader(TreeReader):
    """The environment files of a tree, a row for each key."""

    own = ("path",)

    def partitions(self) -> list[Share]:
        return shares(self.options["path"], self.filters, int(self.options.get("partitions", 16))) or [Share([], [])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        from sieveline.sources.files import LARGEST, _opened

        system, base = _opened(self.options["path"])
        for path, size in self.paths(share):
            if _ENV.search(path) and size <= LARGEST:
                with system.open_input_stream(f"{base}/{path}") as f:
                    lines = f.read().decode("utf-8", "replace").splitlines()
                found = [(i, m[1]) for i, line in enumerate(lines, 1) if (m := _KEY.match(line))]
                if found:
                    yield self.batch([tuple({"path": path, "line": i, "key": key}[n] for n in self.schema.names) for i, key in found])


class EnvSource(DataSource):
    """(path, line, key) of the environment files (.env, .env.*) of a folder. Options: path, partitions."""

    @classmethod
    def name(cls) -> str:
        return "source_env"

    def schema(self) -> str:
        return "path string, line int, key string"

    def reader(self, schema: StructType) -> EnvReader:
        return EnvReader(dict(self.options), schema)


@dataclass
class Changed(InputPartition):
    """Changed files that a task asks for: (status, path, path before)."""

    files: list[tuple[str, str, str]]


def name_status(records: str) -> list[tuple[str, str, str]]:
    """(status, path, path before) of NUL-separated records; renames and copies have both, others the same twice."""
    fields, out = iter(records.split("\0")), []
    for status in fields:
        if not status:
            continue
        before = next(fields)
        out.append((status[0], next(fields) if status[0] in "RC" else before, before))
    return out


class ChangeReader(_Filtered):
    """Changed files by the version control program: their names are asked for once, their hunks by the tasks."""

    own = ("path", "status")

    def _git(self, *arguments: str) -> str:
        run = subprocess.run(["git", "-C", self.options["path"], "-c", "core.quotePath=false", *arguments], check=True, capture_output=True, timeout=600)
        return run.stdout.decode("utf-8", "replace")

    def _scope(self) -> list[str]:
        from sieveline.sources.diff import SCOPES

        scope = self.options.get("scope", "worktree")
        if scope.startswith("-"):
            raise ValueError(f"not a revision: {scope}")
        return SCOPES.get(scope, [*scope.split("..", 1)] if ".." in scope else [scope])

    def partitions(self) -> list[Changed]:
        found = name_status(self._git("diff", "--name-status", "-z", "--find-renames", "--no-ext-diff", *self._scope(), "--"))
        if self.options.get("scope", "worktree") == "worktree":
            found += [("?", p, p) for p in self._git("ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
        known = {"R": "M", "C": "A", "T": "M", "?": "A"}
        kept = [f for f in found if fits(self.filters, {"path": f[1], "status": known.get(f[0], f[0])})]
        parts = min(len(kept), int(self.options.get("partitions", 64)))
        return [Changed(kept[i::parts]) for i in range(parts)] or [Changed([])]

    def read(self, share: Changed) -> Iterator[pa.RecordBatch]:
        from pathlib import Path

        from sieveline.sources.files import LARGEST

        rows = []
        for status, path, before in share.files:
            if status == "?":
                raw = (Path(self.options["path"]) / path).read_bytes()
                n = raw.count(b"\n") + (not raw.endswith(b"\n"))
                spans = [(1, n)] if 0 < len(raw) <= LARGEST else [(None, None)]
            else:
                text = self._git("diff", "-U0", "--no-color", "--no-ext-diff", "--find-renames", *self._scope(), "--", *dict.fromkeys((before, path)))
                spans = []
                for m in re.finditer(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", text, re.M):
                    if int(m[2] or 1):
                        spans.append((int(m[1]), int(m[1]) + int(m[2] or 1) - 1))
                spans = spans or [(None, None)]
            status = {"R": "M", "C": "A", "T": "M", "?": "A"}.get(status, status)
            rows += [tuple({"path": path, "status": status, "start": a, "end": b}[n] for n in self.schema.names) for a, b in spans]
        if rows:
            yield self.batch(rows)


class ChangeSource(DataSource):
    """(path, status, start, end) of the changes of a folder under version control, a row for each added range, or one without a range.

    Options: path; scope: worktree (with files that are not tracked), staged, a revision, or two with `..` between them; partitions. The
    folder must be there for all tasks. Status: A, D or M; a renamed or copied file counts under its new name, as M or A.
    """

    @classmethod
    def name(cls) -> str:
        return "source_changes"

    def schema(self) -> str:
        return "path string, status string, start int, end int"

    def reader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the sources known by name, and lets Spark hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TreeSource, EnvSource, ChangeSource):
        spark.dataSource.register(source)
