"""Findings of the detectors that are joins: packages, APIs, models, duplicates, dead code, orphans, environment, stacks.

Inputs are tables as their sources give them; each function returns findings without tokens. Texts of findings are this
library's own; seeds, severities and confidences are fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import datasets
from sieveline.functions import text as fn
from sieveline.functions.paths import parent, resolve_dotted, resolve_relative
from sieveline.operators import packages, references, similarity, snapshots
from sieveline.operators.code import LEAST_TOKENS
from sieveline.operators.staging import staged
from sieveline.operators.substrings import contained
from sieveline.schema import as_findings

#: Paths of tests.
TEST_PATHS = ("**/*.test.*", "*.test.*", "**/*.spec.*", "*.spec.*", "**/tests/**", "**/test_*.py", "**/*_test.py")
#: Paths whose names a framework calls, so that nothing refers to them.
ROUTED_PATHS = (
    "pages/**", "**/pages/**", "app/**/page.*", "app/**/layout.*", "app/**/route.*", "**/app/**/page.*", "**/app/**/layout.*", "**/app/**/route.*", "urls.py", "**/urls.py", "views.py", "**/views.py",
)
#: Paths of files that something else than an import starts or loads.
ENTRY_PATHS = (
    "index.*", "**/index.*", "main.*", "**/main.*", "app.*", "**/app.*", "server.*", "**/server.*", "settings.py", "**/settings.py", "manage.py", "**/manage.py", "__init__.py", "**/__init__.py", "*.config.*", "**/*.config.*",
    "scripts/**", "**/scripts/**", "conftest.py", "**/conftest.py", "wsgi.py", "**/wsgi.py", "asgi.py", "**/asgi.py",
)
#: Where a Next.js project answers requests.
API_ROUTES = ("pages/api/**", *(f"app/api/**/route.{x}" for x in ("js", "ts", "jsx", "tsx", "mjs", "cjs")))
#: Names of committed environment files that hold no values.
ENV_EXAMPLES = (".env.example", ".env.sample", ".env.template")


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path fits one of the globs, as one regular expression."""
    return path.rlike("|".join(fn.glob_regex(g) for g in globs))


def is_test_path(path: Column) -> Column:
    return matches_any(path, TEST_PATHS)


# packages


def _explained(names: DataFrame, declared: DataFrame, local: DataFrame, builtins: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct names (ecosystem, name) with b, d and l: true where one is built in, declared or local."""
    key = F.when(F.col("ecosystem") == "pypi", fn.normalize_name(F.col("name"))).otherwise(F.col("name"))
    names = names.select("ecosystem", "name", key.alias("key"))
    also = names.join(aliases, ["ecosystem", "name"]).select("ecosystem", "name", F.col("package").alias("key"))
    have = declared.select("ecosystem", F.when(F.col("ecosystem") == "pypi", fn.normalize_name(F.col("name"))).otherwise(F.col("name")).alias("key")).distinct()
    held = names.select("ecosystem", "name", "key").unionByName(also).join(have, ["ecosystem", "key"], "left_semi").select("ecosystem", "name").distinct().withColumn("d", F.lit(True))
    return names.drop("key").join(builtins.withColumn("b", F.lit(True)), ["ecosystem", "name"], "left").join(held, ["ecosystem", "name"], "left").join(local.select("ecosystem", "name").distinct().withColumn("l", F.lit(True)), ["ecosystem", "name"], "left")


def _by_spec(path_aliases: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether a specifier alone says that an import is local, and that it is built in."""
    relative = F.col("spec").startswith(".") | F.col("spec").startswith("/")
    for prefix in path_aliases:
        relative = relative | F.col("spec").startswith(prefix)
    return relative, F.col("spec").startswith("node:")


def import_sites(imports: DataFrame, declared: DataFrame, local: DataFrame, builtins: DataFrame, aliases: DataFrame, path_aliases: tuple[str, ...] = ()) -> DataFrame:
    """(ecosystem, name, at, line, phantom) of each imported name: its first place by seq, and whether one of its imports is a phantom.

    The same as sites_of(resolve_imports()), but imports are summed up by name before they meet the name tables, so no import is shuffled alone.
    """
    relative, builtin = _by_spec(path_aliases)
    loose = ~(F.coalesce(relative, F.lit(False)) | F.coalesce(builtin, F.lit(False)))
    own = imports.where("name <> ''").groupBy("ecosystem", "name").agg(F.min(F.struct("seq", "path", "line")).alias("s"), F.max(loose).alias("loose"))
    own = staged(own.select("ecosystem", "name", F.col("s.path").alias("at"), F.col("s.line").alias("line"), "loose"))
    flags = _explained(own, declared, local, builtins, aliases)
    unknown = F.coalesce(F.col("b"), F.col("d"), F.col("l")).isNull()
    return own.join(flags, ["ecosystem", "name"]).select("ecosystem", "name", "at", "line", (F.col("loose") & unknown).alias("phantom"))


def sites_of(imports: DataFrame) -> DataFrame:
    """import_sites() of imports that are resolved."""
    own = imports.where("name <> ''").groupBy("ecosystem", "name").agg(F.min(F.struct("seq", "path", "line")).alias("s"), F.max(F.col("resolution") == "phantom").alias("phantom"))
    return own.select("ecosystem", "name", F.col("s.path").alias("at"), F.col("s.line").alias("line"), "phantom")


def resolve_imports(imports: DataFrame, declared: DataFrame, local: DataFrame, builtins: DataFrame, aliases: DataFrame, path_aliases: tuple[str, ...] = ()) -> DataFrame:
    """imports (path, line, ecosystem, name, spec, ..) with `resolution`: local, builtin, declared or phantom, the first that holds.

    Relative specifiers and those under a path alias are local; `node:` is built in; Python names are compared in their normal form
    and through the alias table; local: (ecosystem, name) of the project's own modules. The name tables are joined once a distinct name.
    """
    flags = _explained(imports.select("ecosystem", "name").distinct(), declared, local, builtins, aliases)
    relative, node = _by_spec(path_aliases)
    resolution = F.when(relative, "local").when(node | F.col("b"), "builtin").when(F.col("d"), "declared").when(F.col("l"), "local").otherwise("phantom")
    return imports.join(flags, ["ecosystem", "name"], "left").withColumn("resolution", resolution).drop("b", "d", "l")


def package_verdicts(declared: DataFrame, imports: DataFrame, cache: DataFrame, metadata: DataFrame, popular: DataFrame, now: int, sensitivity: str = "normal", ttl: int = 7 * 86400, meta_ttl: int = 86400) -> DataFrame:
    """What is known of each candidate package: existence, downloads, age, nearest popular name, reasons for suspicion, and its place.

    declared: (ecosystem, name, manifest, is_direct); imports: resolved, with seq for their order, or import_sites() of them; cache: (ecosystem, name, exists_flag,
    fetched_at); metadata: (ecosystem, name, downloads, created_at, fetched_at), of which PyPI has none; popular: (ecosystem, name, pos).
    """
    distance = {"off": 0, "normal": 2, "strict": 3}[sensitivity]
    sites = staged(sites_of(imports) if "resolution" in imports.columns else imports)
    phantoms = sites.where("phantom")
    names = packages.candidates(declared, phantoms)
    known = snapshots.lookup(names, cache, now, ttl).select("ecosystem", "name", "is_direct", "existence")
    live = metadata.where(F.lit(now) - F.col("fetched_at") <= meta_ttl).select("ecosystem", "name", "downloads", "created_at")
    asked = known.join(live, ["ecosystem", "name"], "left")
    asked = asked.withColumns({c: F.when(F.col("existence") == "exists", F.col(c)) for c in ("downloads", "created_at")})
    near = packages.near_names_by(asked.select("ecosystem", "name"), popular, max(distance, 1))
    judged = asked.join(near, ["ecosystem", "name"], "left").withColumn("reasons", packages.reasons(now, distance))
    site = sites.select("ecosystem", "name", "at", "line", F.lit(True).alias("imported"))
    manifest = declared.groupBy("ecosystem", "name").agg(F.min("manifest").alias("manifest"))
    default = F.create_map(*(F.lit(x) for pair in datasets.ECOSYSTEMS.items() for x in pair))
    placed = judged.join(site, ["ecosystem", "name"], "left").join(manifest, ["ecosystem", "name"], "left")
    return placed.select(
        "ecosystem", "name", F.coalesce("at", "manifest", default[F.col("ecosystem")]).alias("file"), "line", "existence", "downloads", "created_at", "nearest", "distance", "reasons", "is_direct",
        F.col("manifest").isNotNull().alias("declared"), F.coalesce("imported", F.lit(False)).alias("imported"),
    )


def nonexistent_packages(verdicts: DataFrame) -> DataFrame:
    """Packages that the registry does not have; an inconclusive answer is no finding."""
    where = F.when(F.col("declared") & F.col("imported"), "declared and imported").when(F.col("declared"), "declared").when(F.col("imported"), "imported").otherwise("referred to")
    hint = F.when(F.col("distance").between(1, 2), F.concat(F.lit("perhaps '"), "nearest", F.lit("' is meant")))
    return as_findings(
        verdicts.where("existence = 'missing'"), id="real/nonexistent-package", command="real", severity="critical", confidence="high", file=F.col("file"), line=F.col("line"), end_line=F.col("line"),
        message=F.concat(F.lit("package '"), "name", F.lit("' is not on "), "ecosystem"), detail=F.concat(where, F.lit("; the registry has no such package")), suggestion=hint,
        remediation="remove the package or name the one that is meant", fixable=False, seed_kind="package_name", seed_text=F.col("name"),
    )


def typosquats(verdicts: DataFrame) -> DataFrame:
    """Packages with reasons for suspicion, which the detail lists."""
    hits = verdicts.where("size(reasons) > 0")
    nearest, distance = F.coalesce("nearest", F.lit("")), F.coalesce("distance", F.lit(0)).cast("string")
    return as_findings(
        hits, id="real/typosquat-suspect", command="real", severity="high", confidence="medium", file=F.col("file"), line=F.col("line"), end_line=F.col("line"), message=F.concat(F.lit("'"), "name", F.lit("' is close to the popular package '"), nearest, F.lit("'")),
        detail=F.concat(F.array_join("reasons", ", "), F.lit("; nearest '"), nearest, F.lit("', distance "), distance), suggestion=F.concat(F.lit("perhaps '"), nearest, F.lit("' is meant")),
        remediation="make sure that this package is the one that is meant", fixable=False, seed_kind="package_name", seed_text=F.col("name"),
    )


def phantom_imports(imports: DataFrame) -> DataFrame:
    """Imports that nothing explains."""
    return as_findings(
        imports.where("resolution = 'phantom'"), id="real/phantom-import", command="real", severity="high", confidence="high", file=F.col("path"), line=F.col("line"), end_line=F.col("line"),
        message=F.concat(F.lit("import '"), "name", F.lit("' is neither declared nor built in nor local")), remediation=F.concat(F.lit("declare '"), "name", F.lit("' or remove the import")), fixable=False,
        seed_kind="import_specifier", seed_text=F.col("name"),
    )


def unknown_models(assignments: DataFrame, families: tuple[str, ...] = datasets.MODEL_FAMILIES) -> DataFrame:
    """Model ids (path, line, name, value) at a model's place that no known family starts."""
    sites = F.lower("name").isin(*(s.lower() for s in datasets.MODEL_SITES))
    hits = assignments.where(sites & fn.model_shape(F.col("value")) & ~datasets.known_family(F.col("value"), families))
    return as_findings(
        hits, id="real/unknown-model-string", command="real", severity="medium", confidence="medium", file=F.col("path"), line=F.col("line"), end_line=F.col("line"), message=F.concat(F.lit("model '"), "value", F.lit("' is of no known family")),
        detail="no family of models has names that begin like this", remediation="make sure that the provider has this model", fixable=False, seed_kind="model_string", seed_text=F.col("value"),
    )


def nonexistent_apis(usages: DataFrame, declared: DataFrame, tiers: DataFrame, surface: DataFrame) -> DataFrame:
    """Uses of members that a declared package's surface lacks.

    usages: (ecosystem, package, subpath, member, path, line, seq); tiers: (ecosystem, package, subpath, tier) with tier resolved, dynamic,
    not-installed or unreadable; surface: (ecosystem, package, subpath, member). Members of resolved and dynamic surfaces are judged one by one;
    packages without a readable surface give one finding with the number of uses.
    """
    key = F.when(F.col("ecosystem") == "pypi", fn.normalize_name(F.col("package"))).otherwise(F.col("package"))
    have = declared.select("ecosystem", F.when(F.col("ecosystem") == "pypi", fn.normalize_name(F.col("name"))).otherwise(F.col("name")).alias("key")).distinct()
    asked = usages.withColumn("key", key).join(have, ["ecosystem", "key"], "left_semi").drop("key").withColumn("sub", F.coalesce("subpath", F.lit("")))
    at = ["ecosystem", "package", "sub"]
    tiered = asked.join(tiers.select("ecosystem", "package", F.coalesce("subpath", F.lit("")).alias("sub"), "tier"), at, "left").withColumn("tier", F.coalesce("tier", F.lit("not-installed")))
    members = surface.select("ecosystem", "package", F.coalesce("subpath", F.lit("")).alias("sub"), "member").distinct()
    missing = tiered.join(members, [*at, "member"], "left_anti")
    single = missing.where("tier in ('resolved', 'dynamic')").select("package", "member", "path", "line", "tier", F.lit(1).alias("n"))
    rolled = missing.where("tier not in ('resolved', 'dynamic')").groupBy("ecosystem", "package").agg(F.count("*").alias("n"), F.min(F.struct("seq", "path", "line", "tier")).alias("f"))
    both = single.unionByName(rolled.select("package", F.lit("").alias("member"), F.col("f.path").alias("path"), F.col("f.line").alias("line"), F.col("f.tier").alias("tier"), "n"))
    whole = F.when(F.col("member") == "", F.col("package")).otherwise(F.concat_ws(".", "package", "member"))
    return as_findings(
        both, id="real/nonexistent-api", command="real", severity=F.when(F.col("tier") == "resolved", "high").otherwise("info"), confidence=F.when(F.col("tier") == "resolved", "high").when(F.col("tier") == "dynamic", "medium").otherwise("low"),
        file=F.col("path"), line=F.col("line"), end_line=F.col("line"),
        message=F.when(F.col("member") == "", F.concat(F.col("n").cast("string"), F.lit(" uses of '"), "package", F.lit("' cannot be checked"))).otherwise(F.concat(F.lit("'"), whole, F.lit("' is not on the package's surface"))),
        detail=F.concat(F.lit("surface: "), "tier"), remediation="look the member up in the installed version", fixable=False, seed_kind="api_member", seed_text=whole,
    )


#: Files that tell a project of a language that is not analysed, the first that is there counts.
FOREIGN = (
    (r"(\A|/)Cargo\.toml\z", "rust"), (r"(\A|/)go\.mod\z", "go"), (r"(\A|/)(pom\.xml|build\.gradle(\.kts)?)\z", "java"), (r"(\A|/)Gemfile\z", "ruby"), (r"(\A|/)composer\.json\z", "php"), (r"\.(csproj|sln)\z", "csharp"),
    (r"(\A|/)Package\.swift\z", "swift"), (r"(\A|/)mix\.exs\z", "elixir"),
)


def foreign_stack(paths: DataFrame, declared: DataFrame) -> DataFrame:
    """(stack) of a project (path) without sources or manifests that are analysed, if some file tells another stack; else no row."""
    kind = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(FOREIGN))):
        kind = F.when(F.col("path").rlike(pattern), i).otherwise(kind)
    seen = paths.agg(F.min(kind).alias("k"), F.count_if(fn.language_of(F.col("path")).isNotNull()).alias("sources"))
    alone = seen.crossJoin(declared.agg(F.count("*").alias("packages"))).where("k is not null and sources = 0 and packages = 0")  # one row each
    return alone.select(F.element_at(F.array(*(F.lit(s) for _, s in FOREIGN)), F.col("k") + 1).alias("stack"))


def unsupported_stacks(projects: DataFrame) -> DataFrame:
    """A note for projects (stack) that are of no language that is analysed."""
    message = F.concat(F.lit("'"), "stack", F.lit("' is not analysed"))
    return as_findings(projects, id="real/unsupported-stack", command="real", severity="info", confidence="high", file=".", message=message, fixable=False, seed_kind="message_fallback", seed_text=message)


# changes


def introduced(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings (file, line) on lines that a change added; ranges: (path, start, end)."""
    hits = references.in_ranges(findings.withColumn("path", F.col("file")), ranges)
    return hits.select(*findings.columns)


def duplicate_helpers(functions: DataFrame, ranges: DataFrame, least: float = similarity.LEAST, cap: int = similarity.BUCKET) -> DataFrame:
    """Added functions that are nearly another function; functions: (path, line, col, end_line, value) with normalised tokens.

    A function's partner is the first in order of path, line and column. Tests are exempt.
    """
    own = functions.where(~is_test_path(F.col("path")))  # null values have too few tokens
    made = similarity.stored(similarity.sketched(own.select(F.struct("path", "line", "col").alias("at"), "path", "line", "col", "end_line", "value"), "value", little_endian=True, least=LEAST_TOKENS))
    pairs = staged(similarity.pairs_of(made, "at", least, cap))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    first = both.groupBy("a").agg(F.min(F.struct("b", "similarity")).alias("f")).select(F.col("a").alias("at"), F.col("f.b").alias("other"), F.col("f.similarity").alias("similarity"))
    fresh = made.drop("hashes").join(first, "at")
    hits = references.in_ranges(fresh, ranges, whole=True)
    seed = F.array_join(F.transform("sketch", lambda h: F.regexp_replace(h, r"\A0+(?=.)", "")), ",")
    return as_findings(
        hits, id="review/duplicate-helper", command="review", severity="low", confidence="medium", file=F.col("path"), line=F.col("line"), column=F.col("col"), end_line=F.col("end_line"), message="an added function is nearly one that is there",
        detail=F.concat(F.round(F.col("similarity") * 100).cast("int").cast("string"), F.lit("% like "), "other.path", F.lit(":"), F.col("other.line").cast("string")), remediation="keep one of them", fixable=False,
        seed_kind="function_shingle_set", seed_text=seed,
    )


def named_in_strings(names: DataFrame, literals: DataFrame) -> DataFrame:
    """names (name) that stand within a string literal (value), as part of a word or as one.

    A name can only lie within a run of word characters; names meet runs by their rarest gram.
    """
    runs = literals.select(F.explode(F.regexp_extract_all("value", F.lit(r"[\w$]+"), 0)).alias("run")).distinct()
    return contained(names, runs, text="run")


def dead_code(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Added declarations that nothing refers to: no other identifier, and no string that holds the name. rows: of code.extract().

    Decorated declarations, tests and files that a framework calls are exempt.
    """
    own = rows.where("kind = 'declaration' and detail <> 'decorated'").where(~matches_any(F.col("path"), TEST_PATHS + ROUTED_PATHS))
    fresh = references.in_ranges(own, ranges, whole=True)
    counts = rows.where("kind = 'ident'").groupBy("name").agg(F.sum(F.col("value").cast("long")).alias("n"))
    once = references.dead_names(fresh, counts)
    dead = once.join(named_in_strings(once, rows.where("kind = 'string'")), "name", "left_anti")
    return as_findings(
        dead, id="review/dead-code-introduced", command="review", severity="medium", confidence="medium", file=F.col("path"), line=F.col("line"), column=F.col("col"), end_line=F.col("end_line"), message=F.concat(F.lit("nothing refers to the added '"), "name", F.lit("'")),
        detail="no other place names it; it may be an entry point or meant for others", remediation="remove it, or use it", fixable=False, seed_kind=F.col("detail"), seed_text=F.col("value"),
    )


def commented_blocks(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Added blocks of commented code (path, line, end_line, text): one added line of them is enough."""
    touched = (F.col("h.path") == F.col("r.path")) & (F.col("r.start") <= F.col("h.end_line")) & (F.col("h.line") <= F.col("r.end"))
    hits = blocks.alias("h").join(ranges.alias("r"), touched, "left_semi")
    return as_findings(
        hits, id="review/commented-code-block", command="review", severity="low", confidence="medium", file=F.col("path"), line=F.col("line"), message="an added comment holds code", detail="its lines parse as code",
        remediation="delete the code, or bring it back", fixable=False, seed_kind="comment_run", seed_text=F.col("text"),
    )


def orphan_files(added: DataFrame, imports: DataFrame) -> DataFrame:
    """Added files (path) that no relative import (path, value) reaches; tests, entries and files that a framework calls are exempt."""
    python = F.col("path").endswith(".py")
    # a specifier means the same from each file of a folder, so it is resolved once there
    folder = F.concat(parent(F.col("path")), F.when(python, F.lit("/x.py")).otherwise(F.lit("/x")))
    said = imports.where("name = '' and path is not null").select(F.when(F.contains("path", F.lit("/")), folder).otherwise(F.when(python, "x.py").otherwise("x")).alias("path"), "value").distinct()
    based = said.select(python.alias("python"), F.when(python, resolve_dotted(F.col("path"), F.col("value"))).otherwise(resolve_relative(F.col("path"), F.col("value"))).alias("base")).where("base is not null")
    modules = based.where("python").select(F.explode(F.array("base", F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))).alias("path"))
    own = added.where(~matches_any(F.col("path"), TEST_PATHS + ROUTED_PATHS + ENTRY_PATHS))
    hits = references.orphan_files(own, based.where("not python")).join(modules.distinct(), "path", "left_anti")
    message = F.concat(F.lit("no file imports the added '"), "path", F.lit("'"))
    return as_findings(
        hits, id="review/orphan-file", command="review", severity="low", confidence="medium", file=F.col("path"), message=message, detail="no relative import reaches it; it may be an entry point", remediation="import it, or delete it", fixable=False,
        seed_kind="message_fallback", seed_text=message,
    )


# environment and deployment


def classified(assignments: DataFrame, include_urls: bool = False) -> DataFrame:
    """Assignments (path, name, value, ..) that hold a secret, with `pattern`: a known shape, `entropy` outside tests, or `url` if asked for."""
    pattern = F.coalesce(fn.secret_kind(F.col("value")), F.when(fn.opaque_value(F.col("name"), F.col("value")) & ~is_test_path(F.col("path")), F.lit("entropy")))
    if include_urls:
        pattern = F.coalesce(pattern, F.when(fn.url_kind(F.col("value")).isNotNull(), F.lit("url")))
    return assignments.withColumn("pattern", pattern).where("pattern is not null")


def hardcoded_secrets(secrets: DataFrame, command: str = "env") -> DataFrame:
    """Findings of classified assignments; for `env` they can be fixed, for `audit` they stand beside other rules."""
    return as_findings(
        secrets, id=f"{command}/hardcoded-secret", command=command, severity="critical", confidence=F.when(F.col("pattern") == "entropy", "medium").otherwise("high"), file=F.col("path"), line=F.col("line"), column=F.col("col"), end_line=F.col("line"),
        message=F.concat("pattern", F.lit(" in '"), "name", F.lit("' ("), fn.mask_secret(F.col("value")), F.lit(")")), detail=F.concat(F.lit("pattern "), "pattern"), suggestion=fn.env_key(F.col("name")) if command == "env" else None,
        remediation="move the value to the environment", fixable=command == "env", seed_kind="secret_literal", seed_text=F.col("value"),
    )


def committed_env_files(tracked: DataFrame, name: str = ".env") -> DataFrame:
    """The environment file, if it is among the tracked paths (path)."""
    return as_findings(
        tracked.where(F.col("path") == name).distinct(), id="env/env-file-committed", command="env", severity="critical", confidence="high", file=F.col("path"), message=F.concat("path", F.lit(" is under version control")),
        remediation="take it out of version control and replace its secrets", fixable=False, seed_kind="message_fallback", seed_text=F.concat("path", F.lit(" is under version control")),
    )


def undeclared_env(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Environment keys that are read and declared nowhere; keys: (key)."""
    hits = references.undeclared(rows.where("kind = 'env'").withColumnRenamed("name", "key"), keys, "key")
    return as_findings(
        hits, id="ship/missing-env-declaration", command="ship", severity="medium", confidence="medium", file=F.col("path"), line=F.col("line"), column=F.col("col"), end_line=F.col("line"), message=F.concat(F.lit("environment key "), "key", F.lit(" is declared nowhere")),
        detail="a deployment cannot know that it needs the key", suggestion=F.concat("key", F.lit("=")), remediation="declare it in the example file", fixable=False, seed_kind="env_var_ref", seed_text=F.col("key"),
    )


def blocking(audit: DataFrame) -> DataFrame:
    """Critical findings of the audit once more, as what keeps a project from being shipped."""
    hits = audit.where("severity = 'critical'")
    return hits.withColumns({"id": F.lit("ship/blocking-findings"), "command": F.lit("ship"), "confidence": F.lit("high"), "message": F.concat(F.lit("critical ("), "id", F.lit("): "), "message"), "detail": F.lit("resolve it first"), "suggestion": F.lit(None).cast("string"), "fixable": F.lit(False)})


def frameworks(declared: DataFrame, files: DataFrame) -> DataFrame:
    """One row (express, nextjs, fastapi, flask, django, node): declared frameworks; nextjs needs a path that answers requests too."""
    has = lambda eco, name: F.coalesce(F.bool_or((F.col("ecosystem") == eco) & (F.col("name") == name)), F.lit(False))
    found = declared.agg(has("npm", "express").alias("express"), has("npm", "next").alias("next"), has("pypi", "fastapi").alias("fastapi"), has("pypi", "flask").alias("flask"), has("pypi", "django").alias("django"), F.coalesce(F.bool_or(F.col("ecosystem") == "npm"), F.lit(False)).alias("node"))
    routes = files.agg(F.coalesce(F.bool_or(matches_any(F.col("path"), API_ROUTES)), F.lit(False)).alias("routes"))
    return found.crossJoin(routes).select("express", (F.col("next") & F.col("routes")).alias("nextjs"), "fastapi", "flask", "django", "node")  # one row each


def stack(found: DataFrame) -> DataFrame:
    """(stack) of frameworks(): the first of nextjs, fastapi, flask, django, node that holds, else unknown."""
    return found.select(F.when(F.col("nextjs"), "nextjs").when(F.col("fastapi"), "fastapi").when(F.col("flask"), "flask").when(F.col("django"), "django").when(F.col("node"), "node").otherwise("unknown").alias("stack"))
