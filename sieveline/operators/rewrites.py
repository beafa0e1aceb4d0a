"""Planned rewrites of texts, as tables; writing them to disk is the caller's act, on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import dotenv_quote, env_key
from sieveline.operators.free_names import numbers


def apply_spans(texts: DataFrame, spans: DataFrame, key: str = "path") -> DataFrame:
    """(key, text, stale) with each file's spans (start, end, old, new; characters from 0) replaced from the end backwards.

    A file whose text at a span is not `old` any more is left as it is and marked stale.
    """
    grouped = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "old", "new")), asc=False).alias("spans"))
    part = lambda t, a, b: F.substring(t, a + 1, b - a)
    joined = texts.withColumnRenamed("text", "before").join(grouped, key)  # another name, as lambdas see a select's aliases first
    stale = F.exists("spans", lambda s: part(F.col("before"), s["start"], s["end"]) != s["old"])
    done = F.aggregate("spans", F.col("before"), lambda t, s: F.concat(part(t, F.lit(0), s["start"]), s["new"], F.substring(t, s["end"] + 1, F.length(t))))
    return joined.select(key, F.when(stale, F.col("before")).otherwise(done).alias("text"), stale.alias("stale"))


def env_lines(plan: DataFrame, present: DataFrame) -> DataFrame:
    """(key, line) to append to an env file: keys that it has are left alone."""
    return plan.join(present.select("key"), "key", "left_anti").select("key", F.concat("key", F.lit("="), dotenv_quote(F.col("value"))).alias("line"))


def accessor(lang: Column, key: Column) -> Column:
    """How code of a language reads an environment key."""
    return F.when(lang == "python", F.concat(F.lit('os.environ["'), key, F.lit('"]'))).otherwise(F.concat(F.lit("process.env."), key))


def free_keys(rows: DataFrame, base: str, order: list[str], taken: list[str] = ()) -> DataFrame:
    """rows with `key`: each base name in order, or the first of _2, _3, .. that is free of earlier keys and of those taken.

    A base of which no suffixed form is another base or taken only needs its rows numbered. The others, of families (names that agree but for
    number suffixes) with several bases, are numbered as free_names says.
    """
    named = rows.withColumn("family", F.regexp_replace(base, r"(_\d+)+\z", ""))
    used = list(taken)
    held = rows.sparkSession.createDataFrame([(t,) for t in used], f"`{base}` string").withColumn("family", F.regexp_replace(base, r"(_\d+)+\z", ""))
    bases = named.select(base, "family").distinct().unionByName(held.select(base, "family"))
    tight = bases.groupBy("family").agg(F.count("*").alias("n")).where("n > 1").select("family")
    w = Window.partitionBy(base).orderBy(*order)
    free = named.join(tight, "family", "left_anti").withColumn("own number", F.row_number().over(w))
    plain = free.withColumn("key", F.when(F.col("own number") == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), F.col("own number").cast("string")))).select(*rows.columns, "key")
    dealt = numbers(named.join(tight, "family", "left_semi").select(*rows.columns), base, order, used)
    return plain.unionByName(dealt.withColumn("key", F.when(F.col("number") == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), F.col("number").cast("string")))).drop("number"))


def env_plan(secrets: DataFrame, present: list[str] = ()) -> DataFrame:
    """The plan that moves classified secrets (path, lang, name, value, detail as start:end, line, col, pattern) to the environment, in order of place:
    with `var_name`, a free key, and the span of the literal."""
    at = F.split("detail", ":")
    rows = secrets.withColumns({"start": at[0].cast("int"), "end": at[1].cast("int"), "base": env_key(F.col("name"))})
    return free_keys(rows, "base", ["path", "start"], list(present)).withColumnRenamed("key", "var_name").drop("base")


def insert_import(text: str) -> str:
    """A Python text with `import os` after its shebang, comments, docstring and __future__ imports; as it is if it imports os already."""
    from sieveline.syntax.python_tree import parse_python

    root = parse_python(text)
    at = 0
    for _, node in root.children:
        if node.kind == "import_statement" and any(n.kind == "dotted_name" and n.text == "os" for _, n in node.children):
            return text
    for k, (_, node) in enumerate([c for c in root.children if c[1].kind != "comment"]):
        doc = k == 0 and node.kind == "expression_statement" and node.children and node.children[0][1].kind == "string"
        future = node.kind == "import_from_statement" and node.field("module_name").text == "__future__"
        if not (doc or future):
            break
        at = node.end
    if at == 0:
        for line in text.splitlines(keepends=True):
            if not line.startswith("#"):
                break
            at += len(line)
        return text[:at] + "import os\n" + text[at:]
    end = text.find("\n", at)
    end = len(text) if end < 0 else end + 1
    return text[:end] + ("" if text[:end].endswith("\n") else "\n") + "import os\n" + text[end:]


def moved_to_env(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, text, stale, parses) of the files of a plan with their literals replaced by reads of the environment.

    Spans are replaced from the end backwards; a file that no longer holds a literal at its place stays as it is and is stale; Python files
    get their import; the result is parsed again, so that a file that would no longer parse can be left alone.
    """
    spans = plan.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value", "var_name")), asc=False).alias("spans"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sieveline.operators.code import parse

        for batch in batches:
            out = []
            for path, lang, text, own in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "text", "spans"))):
                made, stale = text, any(s["value"] not in text[s["start"] : s["end"]] for s in own)
                if not stale:
                    for s in own:
                        read = f'os.environ["{s["var_name"]}"]' if lang == "python" else f"process.env.{s['var_name']}"
                        made = made[: s["start"]] + read + made[s["end"] :]
                    made = insert_import(made) if lang == "python" else made
                out.append((path, made, stale, not parse(made, lang).has_error()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.bool_()), pa.array([r[3] for r in out], pa.bool_())], names=["path", "text", "stale", "parses"])

    return files.select("path", "lang", "text").join(spans, "path").mapInArrow(rewrite, "path string, text string, stale boolean, parses boolean")


def example_lines(plan: DataFrame, present: DataFrame) -> DataFrame:
    """(key, line) to append to the example file: keys without values, those that it has left alone."""
    keys = plan.select(F.col("var_name").alias("key")).distinct()
    return keys.join(present.select("key"), "key", "left_anti").select("key", F.concat("key", F.lit("=")).alias("line"))


def ignores_env(lines: DataFrame, name: str = ".env") -> DataFrame:
    """(covered): whether ignore lines (value) cover an environment file."""
    bare = F.trim("value")
    return lines.agg(F.coalesce(F.bool_or(bare.isin(name, f"/{name}", f"{name}*", "*.env", f"**/{name}", f"{name}.*" if name != ".env" else ".env")), F.lit(False)).alias("covered"))


def write_planned(root: str, planned: list[tuple[str, str]], before: Callable[[list[str]], None] | None = None) -> list[str]:
    """Writes planned texts (path, text) below a folder, on the driver: all of them or none.

    Each is written beside its place and moved there; if one fails, those that were moved get their former content back. `before` is
    called with the paths if there are several, so that a snapshot can be taken. Paths that leave the folder are refused.
    """
    base = Path(root).resolve()
    goals = [(base / path).resolve() for path, _ in planned]
    if any(base not in g.parents for g in goals):
        raise ValueError("a path leaves the folder")
    if before and len(planned) > 1:
        before([path for path, _ in planned])
    done: list[tuple[Path, bytes | None]] = []
    try:
        for goal, (_, text) in zip(goals, planned):
            former = goal.read_bytes() if goal.exists() else None
            goal.parent.mkdir(parents=True, exist_ok=True)
            beside = goal.with_name(goal.name + ".new")
            beside.write_text(text, encoding="utf-8", newline="")
            beside.replace(goal)
            done.append((goal, former))
    except OSError:
        for goal, former in reversed(done):
            goal.unlink() if former is None else goal.write_bytes(former)
        raise
    return [str(g.relative_to(base)) for g in goals]


#: Files of a deployment by stack; {port} is filled in.
_NODE = "FROM node:20-slim AS build\nWORKDIR /app\nCOPY package*.json ./\nRUN npm ci\nCOPY . .\n{build}FROM node:20-slim\nWORKDIR /app\nENV NODE_ENV=production PORT={port}\nCOPY --from=build /app ./\nUSER node\nEXPOSE {port}\nCMD {start}\n"
_PYTHON = "FROM python:3.12-slim\nWORKDIR /app\nENV PYTHONUNBUFFERED=1 PORT={port}\nCOPY requirements.txt ./\nRUN pip install --no-cache-dir -r requirements.txt\nCOPY . .\nRUN useradd --create-home app\nUSER app\nEXPOSE {port}\nCMD {start}\n"
DOCKERFILES = {
    "nextjs": _NODE.replace("{build}", "RUN npm run build\n").replace("{start}", '["npm", "start"]'),
    "node": _NODE.replace("{build}", "").replace("{start}", '["npm", "start"]'),
    "fastapi": _PYTHON.replace("{start}", 'uvicorn main:app --host 0.0.0.0 --port "$PORT"'),
    "flask": _PYTHON.replace("{start}", 'gunicorn --bind 0.0.0.0:"$PORT" app:app'),
    "django": _PYTHON.replace("{start}", 'gunicorn --bind 0.0.0.0:"$PORT" config.wsgi:application'),
}
DOCKERIGNORE = {"node": ".git\n.env\n.env.*\n!.env.example\nnode_modules\ncoverage\n.next/cache\n", "python": ".git\n.env\n.env.*\n!.env.example\n.venv\nvenv\n__pycache__\n*.pyc\n"}


def deploy_files(stacks: DataFrame, keys: DataFrame, port: int = 8080) -> DataFrame:
    """(project, path, text) of the files that deploy a project (project, stack): a build file, its ignore file and a checklist with the environment
    keys (project, key) that it needs. An unknown stack gets the checklist alone."""
    spark = stacks.sparkSession
    rows = [(s, "Dockerfile", t.replace("{port}", str(port))) for s, t in DOCKERFILES.items()] + [(s, ".dockerignore", DOCKERIGNORE["node" if s in ("nextjs", "node") else "python"]) for s in DOCKERFILES]
    templates = spark.createDataFrame(rows, "stack string, path string, text string")  # a few rows of this module
    built = stacks.join(F.broadcast(templates), "stack").select("project", "path", "text")
    needed = keys.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_set("key")), lambda k: F.concat(F.lit("- [ ] set "), k)), "\n").alias("list"))
    head = F.concat(F.lit("# Deployment of "), "project", F.lit("\n\nStack: "), "stack", F.lit(f"\nPort: {port}\n\n"), F.coalesce("list", F.lit("- no environment keys are read")), F.lit("\n"))
    return built.unionByName(stacks.join(needed, "project", "left").select("project", F.lit("DEPLOY.md").alias("path"), head.alias("text")))


def stack_of(declared: DataFrame, by: str = "project") -> DataFrame:
    """(by, stack) of declared names: the first of nextjs, fastapi, flask, django, node, unknown that holds."""
    has = lambda n: F.bool_or(F.col("name") == n)
    stack = F.when(has("next"), "nextjs").when(has("fastapi"), "fastapi").when(has("flask"), "flask").when(has("django"), "django").when(has("express") | F.bool_or(F.col("ecosystem") == "npm"), "node").otherwise("unknown")
    return declared.groupBy(by).agg(stack.alias("stack"))
