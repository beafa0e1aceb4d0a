"""The whole check of a source tree: extract once, run every detector, name, suppress, order and score the findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import datasets
from sieveline.config import Config
from sieveline.functions import text as fn
from sieveline.operators import baseline, code, detect, extraction, identity, report, rules
from sieveline.sources import files as sources
from sieveline.sources import installed, readers, surfaces


@dataclass
class Context:
    """What all detectors share: the files, their rows, declared packages, and whatever the caller knows besides."""

    files: DataFrame
    other: DataFrame
    skipped: DataFrame
    rows: DataFrame
    declared: DataFrame
    frameworks: list[str]
    pack: tuple[rules.Rule, ...]
    keys: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    root: str = ""
    aliases: tuple[str, ...] = ()

    def release(self) -> None:
        """Gives the extracted rows back; a result that was not written yet is then computed anew."""
        for df in (self.rows, self.other, self.declared):
            df.unpersist()


def extract_rows(spark: SparkSession, files: DataFrame, syntax: list[tuple[str, list[str], list[str], str]], folder: str | None = None) -> DataFrame:
    """All rows of files; with a folder, contents that it knows for these rules are not parsed again. Rules look at paths, so what fits is part of the key."""
    if folder is None:
        return code.extract(files, syntax)
    globs = sorted({g for _, _, patterns, _ in syntax for g in patterns})
    fits = F.concat(F.lit(""), *(F.col("path").rlike(g).cast("string") for g in globs))
    cache = extraction.ExtractionCache(spark, folder, extraction.version_of(code.SCHEMA, syntax))
    return cache.extract(files, extraction.digest_of(F.col("lang"), F.col("text"), fits), lambda fresh: code.extract(fresh, syntax)).rows


def scan(spark: SparkSession, root: str, pack: tuple[rules.Rule, ...] | None = None, extracted: str | None = None, **tables: DataFrame) -> Context:
    """One walk and one parse of a tree. tables: cache, metadata, popular, local, tiers, surface, tracked, changed_ranges, added.

    extracted: a folder that keeps extracted rows by content, so that later scans parse only what changed.
    """
    found = sources.scan(spark, root)
    pack = rules.shipped() if pack is None else pack
    globs = [fn.glob_regex(m.file_glob) for r in pack for m in r.matchers if m.file_glob]
    names = [rf"\A{n.replace('.', chr(92) + '.')}\z" for n in detect.ENV_EXAMPLES]
    texts = sources.read_texts(spark, root, "|".join([sources.manifest_pattern(), sources.SETTINGS, *names, *globs])).persist()  # what nothing asks for stays unread
    texts = sources.followed(spark, root, texts)
    declared = sources.declared(texts).persist()
    paths = found["files"].select("path").unionByName(found["other"].select("path"))
    known = detect.frameworks(declared, paths).head()  # one row of flags
    active = [n for n in rules.FRAMEWORKS if known[n]]
    rows = extract_rows(spark, found["files"], rules.syntax_rules(pack, active), extracted).persist()
    keys = sources.keys_of(texts.where(F.col("path").isin(*detect.ENV_EXAMPLES)))
    return Context(found["files"], texts, found["skipped"], rows, declared, active, pack, keys, tables | {"paths": paths}, root, sources.alias_prefixes(texts, found["files"]))


def imports_of(rows: DataFrame) -> DataFrame:
    """Imports (path, line, ecosystem, name, spec, seq) of extracted rows."""
    own = rows.where("kind = 'import'")
    return own.select("path", "line", F.when(F.col("lang") == "python", "pypi").otherwise("npm").alias("ecosystem"), "name", F.col("value").alias("spec"), F.struct("path", "line").alias("seq"))


def local_modules(files: DataFrame) -> DataFrame:
    """(ecosystem, name) of a project's own top modules: Python files and folders that hold some, at any depth."""
    parts = F.split(F.regexp_replace("path", r"\.pyi?\z", ""), "/")
    return files.where("lang = 'python'").select(F.lit("pypi").alias("ecosystem"), F.explode(parts).alias("name")).distinct()


def real(spark: SparkSession, context: Context, now: int = 0, settings: Config | None = None, scope: tuple[str, ...] = ("deps", "apis", "models")) -> DataFrame:
    """Findings about packages, APIs and models."""
    settings = settings or Config()
    imports = detect.resolve_imports(imports_of(context.rows), context.declared, local_modules(context.files), datasets.builtins(spark), datasets.import_aliases(spark), context.aliases)
    legs = [detect.unsupported_stacks(detect.foreign_stack(context.tables["paths"], context.declared))] if "paths" in context.tables else []
    if "deps" in scope:
        legs.append(detect.phantom_imports(imports.where("name <> ''")))
        t = context.tables
        if "cache" in t and not settings.real.offline:
            empty = spark.createDataFrame([], "ecosystem string, name string, downloads long, created_at long, fetched_at long")
            popular = t.get("popular", spark.createDataFrame([], "ecosystem string, name string, pos long"))
            verdicts = detect.package_verdicts(context.declared, imports, t["cache"], t.get("metadata", empty), popular, now, settings.real.typosquat_sensitivity)
            legs += [detect.nonexistent_packages(verdicts), detect.typosquats(verdicts)]
    if "apis" in scope and settings.real.check_apis:
        usages = context.rows.where("kind = 'usage'").select(F.when(F.col("lang") == "python", "pypi").otherwise("npm").alias("ecosystem"), F.col("name").alias("package"), F.col("detail").alias("subpath"), F.col("value").alias("member"), "path", "line", F.struct("path", "line", "col").alias("seq"))
        if "tiers" in context.tables:
            legs.append(detect.nonexistent_apis(usages, context.declared, context.tables["tiers"], context.tables["surface"]))
        elif context.root and any(installed.folders(context.root)):
            tiers, members = surfaces.surfaces(installed.installed_files(spark, context.root, usages).persist())
            legs.append(detect.nonexistent_apis(usages, context.declared, tiers, members))
    if "models" in scope:
        legs.append(detect.unknown_models(context.rows.where("kind = 'assignment'")))
    return _union(legs)


def audit(spark: SparkSession, context: Context, settings: Config | None = None) -> DataFrame:
    """Findings of the rules of the pack, those of whole files and of secrets among them, of the least severity or worse."""
    settings = settings or Config()
    own = rules.pack_frame(spark, context.pack)
    shown = tuple(r for r in context.pack if r.id.startswith("audit/") or not r.id.startswith(("review/", "ship/")))
    found = code.rule_findings(context.rows, rules.pack_frame(spark, shown))
    texts = rules.whole_file_hits(context.other, own, context.frameworks)
    whole = rules.text_findings(texts)
    legs = [found, whole]
    if rules.secret_rules(context.pack):
        legs.append(detect.hardcoded_secrets(detect.classified(context.rows.where("kind = 'assignment'")), "audit"))
    return report.at_least(_union(legs), settings.audit.severity_min)


def review(spark: SparkSession, context: Context) -> DataFrame:
    """Findings about a change: tables changed_ranges (path, start, end) and added (path); without them, every file is one added range."""
    ranges = context.tables.get("changed_ranges")
    if ranges is None:
        ranges = context.files.select("path", F.lit(1).alias("start"), F.lit(2**31 - 1).alias("end"))
    added = context.tables.get("added")
    added = context.files.select("path") if added is None else added
    shown = tuple(r for r in context.pack if r.id.startswith("review/"))
    rows = context.rows
    return _union([
        detect.introduced(code.rule_findings(rows, rules.pack_frame(spark, shown)), ranges), detect.duplicate_helpers(rows.where("kind = 'function'"), ranges), detect.dead_code(rows, ranges),
        detect.commented_blocks(code.commented_code(rows), ranges), detect.orphan_files(added, rows.where("kind = 'import'")),
    ])


def env(spark: SparkSession, context: Context, settings: Config | None = None) -> DataFrame:
    """Findings about secrets that could move to the environment, and about a committed environment file."""
    settings = settings or Config()
    legs = [detect.hardcoded_secrets(detect.classified(context.rows.where("kind = 'assignment'"), settings.env.include_urls))]
    if "tracked" in context.tables:
        legs.append(detect.committed_env_files(context.tables["tracked"], settings.env.env_file))
    return _union(legs)


def ship(spark: SparkSession, context: Context) -> DataFrame:
    """Findings that matter for a deployment."""
    shown = tuple(r for r in context.pack if r.id.startswith("ship/"))
    return _union([code.rule_findings(context.rows, rules.pack_frame(spark, shown)), detect.undeclared_env(context.rows, context.keys), detect.blocking(audit(spark, context))])


def check(spark: SparkSession, root: str, settings: Config | None = None, now: int = 0, known: DataFrame | None = None, mode: str = "none", scope: str | None = None, **tables: DataFrame) -> dict[str, DataFrame]:
    """Findings of a tree: `kept`, `suppressed` and `stale` with tokens, and `context`.

    scope: for a tree under version control, what its changes are measured from, as for the data source `source_changes`; only these count as changed.
    Surfaces of packages are those of the installed ones, if tables has none. The legs real, audit, env and review in this order; an audit's secret goes where env has it at the same place; then tokens, settings'
    suppressions, and the baseline.
    """
    settings = settings or Config()
    if scope is not None and "changed_ranges" not in tables:
        tables |= changed_tables(spark, root, scope)
    context = scan(spark, root, **tables)
    secrets = env(spark, context, settings)
    seen = _union([real(spark, context, now, settings), baseline.without_twins(audit(spark, context, settings), secrets), secrets, review(spark, context)])
    tokens = spark.createDataFrame([(s.fingerprint, s.reason) for s in settings.suppress], "fingerprint string, reason string")
    reasons = baseline.with_reasons(identity.assign_tokens(seen), {r: "rule" for r in settings.ignore.rules}, {p: f"path {p}" for p in settings.ignore.paths}, tokens)
    split = baseline.split(reasons.where("reason is null").drop("reason"), mode, known)
    return split | {"ignored": reasons.where("reason is not null"), "context": context}


def changed_tables(spark: SparkSession, root: str, scope: str = "worktree") -> dict[str, DataFrame]:
    """The tables changed_ranges (path, start, end) and added (path) of a tree under version control."""
    readers.register(spark)
    found = spark.read.format("source_changes").option("path", root).option("scope", scope).load().persist()
    return {"changed_ranges": found.where("start is not null").select("path", "start", "end"), "added": found.where("status = 'A'").select("path").distinct()}


def check_since(spark: SparkSession, root: str, earlier: str, settings: Config | None = None, **tables: DataFrame) -> dict[str, DataFrame]:
    """check() without what an earlier snapshot of the tree already had."""
    before = check(spark, earlier, settings, **tables)
    return check(spark, root, settings, known=before["kept"].select("fingerprint"), mode="since", **tables)


def _union(legs: list[DataFrame]) -> DataFrame:
    found = legs[0]
    for leg in legs[1:]:
        found = found.unionByName(leg)
    return found
