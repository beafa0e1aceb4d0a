"""Source trees, key files and manifests as tables."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.paths import parent
from sieveline.functions.text import glob_regex, language_of, normalize_name
from sieveline.operators.staging import staged

#: Bytes beyond which a file is skipped, folders that are never entered, and what marks a virtual environment.
LARGEST = 5 * 1024 * 1024
EXCLUDED = ("node_modules", ".venv", "site-packages", "__pycache__", ".git", "target")
MARKER = "pyvenv.cfg"
IGNORE_FILES = (".gitignore", ".ignore")
#: Names that begin with a dot and are read nevertheless.
ENV_NAME = r"(\A|/)\.env(\.[^/]*)?\z"


def _opened(root: str):
    """(file system, folder) of a path or URI. Spark's own readers pass over names that begin with `_` or `.`, such as __init__.py, so files
    are listed and read through Arrow's file systems, on the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root.rstrip("/") if "://" in root else os.path.abspath(root))


def _wanted(name: str) -> bool:
    """Whether a file of this name takes part: hidden ones do not, but for ignore and environment files."""
    return not name.startswith(".") or name in IGNORE_FILES or bool(re.search(ENV_NAME.replace("\\z", "\\Z"), name))


def walk_some(system, folders: list[str], base: str, most: int) -> tuple[list[tuple[str, int]], list[str]]:
    """((path from the base, bytes) of files below folders, folders that are left) once `most` entries have been seen, or all are.

    Hidden and excluded folders and virtual environments are not entered. One folder at least is listed, however many entries it has.
    """
    from pyarrow import fs

    todo, files, seen = list(reversed(folders)), [], 0
    while todo and seen < most:
        infos = system.get_file_info(fs.FileSelector(todo.pop()))
        seen += len(infos)
        if any(i.base_name == MARKER for i in infos):
            continue
        for info in infos:
            if info.type == fs.FileType.Directory:
                if info.base_name not in EXCLUDED and not info.base_name.startswith("."):
                    todo.append(info.path)
            elif info.type == fs.FileType.File and _wanted(info.base_name):
                files.append((info.path[len(base) :].lstrip("/"), info.size))
    return files, todo


#: Entries that the driver lists by itself, and those that a task lists before it hands its other folders on.
DRIVER_ENTRIES, TASK_ENTRIES = 2_000, 20_000


def listing(spark: SparkSession, root: str, driver_entries: int = DRIVER_ENTRIES, task_entries: int = TASK_ENTRIES) -> DataFrame:
    """(path, n_bytes) of all files of a tree, without their contents: hidden ones, excluded folders, virtual environments and ignored paths left out.

    A small tree is listed by the driver. Of a larger one the folders that are left are a frontier, dealt to all tasks in rounds: a task lists
    folders until it has seen its share of entries, and what it has not entered is dealt out again, so one deep folder is shared like many.
    """
    system, base = _opened(root)
    first, left = walk_some(system, [base], base, driver_entries)
    seen = spark.createDataFrame(first, "path string, n_bytes long")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = _opened(root)
        folders = [f for batch in batches for f in batch.column(0).to_pylist()]
        if folders:
            files, todo = walk_some(own, folders, start, task_entries)
            for lo in range(0, len(files), 10_000):
                part = files[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in part]), pa.array([f[1] for f in part], pa.int64()), pa.array([False] * len(part))], names=["path", "n_bytes", "is_folder"])
            if todo:
                yield pa.RecordBatch.from_arrays([pa.array(todo), pa.nulls(len(todo), pa.int64()), pa.array([True] * len(todo))], names=["path", "n_bytes", "is_folder"])

    tasks = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(f,) for f in left], "folder string")
    while not frontier.isEmpty():
        step = staged(frontier.repartition(tasks).mapInArrow(walk, "path string, n_bytes long, is_folder boolean"))
        seen = seen.unionByName(step.where("not is_folder").drop("is_folder"))
        frontier = step.where("is_folder").select(F.col("path").alias("folder"))
    rules = ignore_rules(spark, root, seen.where(F.col("path").rlike(_named(IGNORE_FILES))))
    return without_ignored(seen, rules).where(~F.col("path").rlike(_named(IGNORE_FILES)))


def _named(names: tuple[str, ...]) -> str:
    return r"(\A|/)(" + "|".join(re.escape(n) for n in names) + r")\z"


def ignore_rules(spark: SparkSession, root: str, found: DataFrame) -> list[tuple[str, bool]]:
    """(pattern, keeps) of a tree's ignore files in the order in which they hold, folders above before those below; the last that fits decides.

    found: (path) of the ignore files, which people write; their lines are gathered to the driver.
    """
    paths = sorted((r.path for r in found.select("path").collect()), key=lambda p: (p.count("/"), p))
    system, base = _opened(root)
    out = []
    for name in paths:
        with system.open_input_stream(f"{base}/{name}") as f:
            lines = f.read().decode("utf-8", "replace").splitlines()
        out += [rule for line in lines if (rule := ignore_pattern(line, name.rpartition("/")[0]))]
    return out


def ignore_pattern(line: str, folder: str = "") -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression of paths, whether it keeps them); None for comments and blank lines."""
    text = line.rstrip("\r\n")
    text = text if text.endswith("\\ ") else text.rstrip()
    if not text or text.startswith("#"):
        return None
    keeps = text.startswith("!")
    text = text[1:] if keeps else text.removeprefix("\\")
    only_folder, text = text.endswith("/"), text.rstrip("/")
    anchored = "/" in text
    body = glob_regex(text.lstrip("/"))[2:-2]  # without the marks of its ends
    prefix = re.escape(folder) + "/" if folder else ""
    middle = "" if anchored else "(?:[^/]+/)*"
    tail = "/.*" if only_folder else "(?:/.*)?"
    return rf"\A{prefix}{middle}(?:{body}){tail}\z", keeps


def without_ignored(files: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    hidden: Column = F.lit(False)
    for pattern, keeps in rules:
        hidden = F.when(F.col("path").rlike(pattern), F.lit(not keeps)).otherwise(hidden)
    return files.where(~hidden)


def _contents(root: str, wanted: DataFrame) -> DataFrame:
    """wanted (path, n_bytes, ..) with `content`; files over the cap must be gone already."""
    schema = T.StructType([*wanted.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                held = []
                for path in part.column("path").to_pylist():
                    with system.open_input_stream(f"{base}/{path}") as f:
                        held.append(f.read(LARGEST + 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=schema.names)

    return wanted.mapInArrow(read, schema)


def scan(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The files of a tree: `files` (path, lang, text, n_bytes) of sources, `other` (path), `skipped` (path, reason).

    Too large files and those that are not UTF-8 are skipped with the reason; the cap is tested before contents are read.
    """
    seen = listing(spark, root).withColumn("lang", language_of(F.col("path")))
    sources = seen.where("lang is not null")
    read = _contents(root, sources.where(F.col("n_bytes") <= LARGEST))
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    large = sources.where(F.col("n_bytes") > LARGEST).select("path", F.lit("too large").alias("reason"))
    return {
        "files": read.where(good).select("path", "lang", text.alias("text"), "n_bytes"),
        "other": seen.where("lang is null").select("path"),
        "skipped": large.unionByName(read.where(~good).select("path", F.lit("not UTF-8").alias("reason"))),
    }


def read_texts(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, text) of the files that are no sources (manifests, rules, environment files), capped and UTF-8; pattern: a regular expression of paths."""
    seen = listing(spark, root).where(language_of(F.col("path")).isNull())
    seen = seen.where(F.col("path").rlike(pattern)) if pattern else seen
    text = F.col("content").cast("string")
    return _contents(root, seen.where(F.col("n_bytes") <= LARGEST)).where(F.is_valid_utf8(text)).select("path", text.alias("text"))


def sources_only(found: dict[str, DataFrame], *langs: str) -> DataFrame:
    """The sources of a scan, of some languages if named."""
    return found["files"].where(F.col("lang").isin(*langs)) if langs else found["files"]


_KEY = r"\A\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*="


def env_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key) of an env file: comments skipped, `export` allowed."""
    return spark.read.text(path).select(F.regexp_extract("value", _KEY, 1).alias("key")).where("key <> ''").distinct()


def keys_of(texts: DataFrame) -> DataFrame:
    """(key) of env files as texts (path, text)."""
    return texts.select(F.explode(F.split("text", r"\r?\n")).alias("value")).select(F.regexp_extract("value", _KEY, 1).alias("key")).where("key <> ''").distinct()


def package_json(texts: DataFrame) -> DataFrame:
    """(manifest, name, is_direct) of package.json texts (path, text): all four groups; malformed ones have no rows."""
    groups = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parsed = texts.select("path", F.from_json("text", ", ".join(f"{g} map<string,string>" for g in groups)).alias("j"))
    names = F.flatten(F.array(*(F.coalesce(F.map_keys(f"j.{g}"), F.array().cast("array<string>")) for g in groups)))
    return parsed.where("j is not null").select(F.col("path").alias("manifest"), F.explode(F.array_distinct(names)).alias("name"), F.lit(True).alias("is_direct"))


def _requirement_lines(texts: DataFrame) -> DataFrame:
    line = F.trim(F.regexp_replace(F.col("line"), r"(\A|\s)#.*\z", ""))
    return texts.select("path", F.explode(F.split("text", r"\r?\n")).alias("line")).select("path", line.alias("line"))


def includes(texts: DataFrame) -> DataFrame:
    """(path, goal) of the `-r` lines of requirements texts."""
    goes = _requirement_lines(texts).select("path", F.regexp_extract("line", r"\A(?:-r|--requirement)[\s=]+(\S+)", 1).alias("goal")).where("goal <> ''")
    folder = parent(F.col("path"))
    return goes.select("path", F.when(folder == "", F.col("goal")).otherwise(F.concat(folder, F.lit("/"), "goal")).alias("goal")).select("path", F.regexp_replace("goal", r"(\A|/)(\./)+", "$1").alias("goal")).distinct()


#: Fixed value: names of requirements files.
REQUIREMENTS = r"(\A|/)requirements[^/]*\.txt\z"


def followed(spark: SparkSession, root: str, texts: DataFrame) -> DataFrame:
    """texts with the files of other names that requirements files follow, directly or not; people name these, so the driver asks for them."""
    known: set[str] = set()
    fresh = texts.where(F.col("path").rlike(REQUIREMENTS))
    while True:
        goals = {r.goal for r in includes(fresh).select("goal").distinct().collect() if not re.search(REQUIREMENTS.replace("\\z", "\\Z"), r.goal)} - known
        if not goals:
            return texts
        known |= goals
        fresh = read_texts(spark, root, "|".join(rf"\A{re.escape(g)}\z" for g in sorted(goals))).persist()
        texts = texts.unionByName(fresh)


def requirements(texts: DataFrame, manifests: str | None = None) -> DataFrame:
    """(manifest, name, is_direct) of requirements texts: options, urls and comments skipped, `-r` files followed to the end, in circles once.

    Names of a followed file belong to the manifest that names it. manifests: a pattern of the paths that are manifests by themselves.
    """
    rows, edges = _requirement_lines(texts), includes(texts)
    own = texts.where(F.col("path").rlike(manifests)) if manifests else texts
    reach = own.select(F.col("path").alias("manifest"), "path").distinct()
    if not edges.isEmpty():
        edges, fresh = staged(edges), reach
        while not fresh.isEmpty():
            fresh = staged(fresh.join(edges, "path").select("manifest", F.col("goal").alias("path")).distinct().join(reach, ["manifest", "path"], "left_anti"))
            reach = staged(reach.unionByName(fresh))
    name = F.regexp_extract("line", r"\A([A-Za-z0-9][A-Za-z0-9._\-]*)\s*(\[|[<>=!~;@]|\z)", 1)
    named = rows.where(~F.col("line").rlike(r"\A(-|[A-Za-z+]+://)")).select("path", normalize_name(name).alias("name")).where("name <> ''")
    return reach.join(named, "path").select("manifest", "name", F.lit(True).alias("is_direct")).distinct()


def _in_batches(texts: DataFrame, names) -> DataFrame:
    """(manifest, name, is_direct) that names(path, text) gives of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {(path, *found) for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for found in names(path, text or "")}
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=["manifest", "name", "is_direct"])

    return texts.select("path", "text").mapInArrow(run, "manifest string, name string, is_direct boolean")


def _toml_names(name: str, text: str) -> list[tuple[str, bool]]:
    import tomllib

    try:
        data = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return []
    bare = lambda s: re.sub(r"[-_.]+", "-", re.match(r"\s*([A-Za-z0-9._-]*)", s)[1]).lower()
    if name.endswith((".lock",)):
        return [(bare(p.get("name", "")), False) for p in data.get("package", [])]
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    found = list(project.get("dependencies", []))
    for extra in project.get("optional-dependencies", {}).values():
        found += extra
    for group in data.get("dependency-groups", {}).values():
        found += [x for x in group if isinstance(x, str)]
    tables = [poetry.get("dependencies", {}), poetry.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())]
    found += [n for t in tables for n in t if n.lower() != "python"]
    return [(bare(n), True) for n in found if bare(n)]


def toml_manifests(texts: DataFrame) -> DataFrame:
    """(manifest, name, is_direct) of pyproject.toml, poetry.lock and uv.lock texts; malformed ones have no rows."""
    return _in_batches(texts, _toml_names)


def _lock_names(path: str, text: str) -> list[str]:
    if path.endswith("package-lock.json"):
        try:
            data = json.loads(text or "")
        except ValueError:
            return []
        flat = {k.rsplit("node_modules/", 1)[-1] for k in data.get("packages", {}) if "node_modules/" in k}

        def nested(level: dict) -> set[str]:
            return set(level) | {n for v in level.values() if isinstance(v, dict) for n in nested(v.get("dependencies", {}))}

        return sorted(flat | nested(data.get("dependencies", {})))
    if path.endswith("yarn.lock"):
        return sorted({m[1] for m in re.finditer(r'^"?(@?[^@"\s][^@"\n]*)@[^\n]*:\s*$', text or "", re.M)})
    return sorted({m[1] for m in re.finditer(r"^  ['\"]?/?(@?[^@'\"\s(]+)[@/]\d[^\n]*:\s*$", text or "", re.M)})


def script_locks(texts: DataFrame) -> DataFrame:
    """(manifest, name, is_direct) of package-lock.json (both forms), yarn.lock and pnpm-lock.yaml texts."""
    return _in_batches(texts, lambda path, text: [(n, False) for n in _lock_names(path, text)])


#: Manifests and locks by their file names, with the ecosystem.
MANIFESTS = (
    (r"(\A|/)package\.json\z", "npm", package_json), (r"(\A|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml)\z", "npm", script_locks), (REQUIREMENTS, "pypi", requirements),
    (r"(\A|/)(pyproject\.toml|poetry\.lock|uv\.lock)\z", "pypi", toml_manifests),
)


#: Settings of compilers that name path aliases.
SETTINGS = r"(\A|/)(tsconfig|jsconfig)[^/]*\.json\z"


def manifest_pattern() -> str:
    return "|".join(pattern for pattern, _, _ in MANIFESTS)


def declared(texts: DataFrame) -> DataFrame:
    """(ecosystem, name, manifest, is_direct) of all manifests and locks among texts (path, text), nested ones too."""
    found = None  # files of other names are what requirements files follow
    for pattern, ecosystem, read in MANIFESTS:
        named = F.col("path").rlike(pattern)
        found_ = read(texts.where(named | ~F.col("path").rlike(manifest_pattern() + "|" + SETTINGS)), pattern) if read is requirements else read(texts.where(named))
        own = found_.select(F.lit(ecosystem).alias("ecosystem"), "name", "manifest", "is_direct")
        found = own if found is None else found.unionByName(own)
    return found


#: Settings of bundlers, which are scripts, name path aliases too.
_BUNDLER = r"(\A|/)vite\.config\.[mc]?[jt]s\z"


def alias_prefixes(texts: DataFrame, files: DataFrame) -> tuple[str, ...]:
    """The alias prefixes of a tree's compiler settings, among texts (path, text), and bundler settings, among its sources; people write these, so the driver reads them."""
    out: set[str] = set()
    for r in texts.where(F.col("path").rlike(SETTINGS)).select("text").collect():
        out |= set(path_aliases(r.text or ""))
    for r in files.where(F.col("path").rlike(_BUNDLER)).select("text").collect():
        out |= set(bundler_aliases(r.text or ""))
    return tuple(sorted(out))


def path_aliases(text: str) -> dict[str, str]:
    """Alias prefixes of a tsconfig text (comments and trailing commas allowed): what stands before `*`, with the folder that it means."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return {}
    base = str(options.get("baseUrl", ".")).strip("./")
    out = {}
    for key, goals in (options.get("paths") or {}).items():
        if goals and key.rstrip("*"):
            goal = re.sub(r"\A(\./)+", "", str(goals[0]).rstrip("*"))
            out[key.rstrip("*")] = f"{base}/{goal}" if base else goal
    return out


def bundler_aliases(text: str) -> dict[str, str]:
    """Alias prefixes of a bundler's configuration: string pairs of its `alias` object, paths in them taken from the project's root."""
    from sieveline.operators.code import literal
    from sieveline.syntax.script_tree import parse_script

    out = {}
    for node in parse_script(text, "typescript").walk():
        key = node.field("key") if node.kind == "pair" else None
        if key is not None and (literal(key) or key.text) == "alias" and node.field("value").kind == "object":
            for _, pair in node.field("value").children:
                if pair.kind == "pair":
                    goal = next((literal(n) for n in reversed(list(pair.field("value").walk())) if literal(n)), None)
                    if goal:
                        out[(literal(pair.field("key")) or pair.field("key").text).rstrip("/") + "/"] = re.sub(r"\A(\./|/)+", "", goal).rstrip("/") + "/"
    return out
