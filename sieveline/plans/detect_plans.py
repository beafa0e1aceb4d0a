"""Queries of the detectors that are joins, of reports, suppression and versions, with the test tables as packages, uses, functions and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import datasets
from sieveline.functions import text as fn
from sieveline.operators import baseline, detect, identity, report, rewrites, snapshots
from sieveline.operators.staging import spread
from sieveline.plans.findings_plans import _F, _ORDER, _RANK, _SCORE, _TOKENS, findings
from sieveline.sources import diff, registry

NOW = 1_000_000


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (shape, begin of a value, a letter, how many of it a value needs, what follows)
SHAPES = (
    ("stripe-live-secret-key", "sk_live_", "a", 16, ""), ("stripe-live-restricted-key", "rk_live_", "b", 16, ""), ("aws-access-key-id", "AKIA", "C", 16, ""), ("github-token", "ghp_", "d", 36, ""), ("github-fine-grained-pat", "github_pat_", "e", 50, ""),
    ("google-api-key", "AIza", "f", 35, ""), ("anthropic-api-key", "sk-ant-", "g", 24, ""), ("openai-api-key", "sk-proj-", "h", 32, ""), ("npm-token", "npm_", "i", 36, ""), ("slack-token", "xoxb-", "j", 10, ""),
    ("sendgrid-key", "SG.kkkkkkkkkkkkkkkk.", "k", 16, ""), ("twilio-key", "SK", "a", 32, ""), ("supabase-access-token", "sbp_", "b", 40, ""), ("supabase-secret-key", "sb_secret_", "m", 20, ""), ("private-key-block", "-----BEGIN RSA PRIVATE KE", "Y", 1, "-----"),
)


def secret_shapes(spark, sf_dir):
    """Parts as values of each shape in turn, of the length that it needs and one character shorter."""
    k, short = F.col("p_partkey") % len(SHAPES), (F.col("p_partkey") / len(SHAPES)).cast("int") % 2
    value = F.lit(None).cast("string")
    for i, (_, begin, letter, n, end) in enumerate(SHAPES):
        value = F.when(k == i, F.concat(F.lit(begin), F.repeat(F.lit(letter), F.lit(n) - short), F.lit(end))).otherwise(value)
    return _t(spark, sf_dir, "part").select("p_partkey", value.alias("value")).select("p_partkey", fn.secret_kind(F.col("value")).alias("shape"))


def _packages(spark, sf_dir) -> dict[str, DataFrame]:
    """Parts as packages of two ecosystems, line items as imports."""
    name = lambda key: F.concat(F.lit("pkg-"), key.cast("string"))
    eco = lambda key: F.when(key % 2 == 0, "npm").otherwise("pypi")
    part, key = _t(spark, sf_dir, "part"), F.col("p_partkey")
    declared = part.where("p_size % 4 > 0").select(eco(key).alias("ecosystem"), name(key).alias("name"), F.concat("p_brand", F.lit("/manifest")).alias("manifest"), (F.col("p_size") < 25).alias("is_direct"))
    used = F.col("l_partkey")
    imports = _t(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("src/f"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_orderkey").cast("int").alias("line"), eco(used).alias("ecosystem"), name(used).alias("name"), name(used).alias("spec"), F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )
    none = spark.createDataFrame([], "ecosystem string, name string")
    known = (declared, none, datasets.builtins(spark), datasets.import_aliases(spark))
    cache = part.where("p_size > 5").select(eco(key).alias("ecosystem"), name(key).alias("name"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(1).alias("exists_flag"), (F.lit(NOW) - F.col("p_size") * 20_000).alias("fetched_at"))
    metadata = part.where("p_partkey % 2 = 0").select(F.lit("npm").alias("ecosystem"), name(key).alias("name"), (F.col("p_size") * 40).cast("long").alias("downloads"), (F.lit(NOW) - F.col("p_size") * 1_000_000).cast("long").alias("created_at"), F.lit(NOW).cast("long").alias("fetched_at"))
    popular = part.where("p_partkey <= 9").select(eco(key).alias("ecosystem"), F.concat(F.lit("pkg-"), (key * 11).cast("string"), F.lit("x")).alias("name"), key.alias("pos"))
    return {"declared": declared, "imports": imports, "known": known, "cache": cache, "metadata": metadata, "popular": popular}


def _verdicts(spark, sf_dir):
    p = _packages(spark, sf_dir)
    return detect.package_verdicts(p["declared"], detect.import_sites(p["imports"], *p["known"]), p["cache"], p["metadata"], p["popular"], NOW)


def package_findings(spark, sf_dir):
    """Packages that the registry lacks."""
    return detect.nonexistent_packages(_verdicts(spark, sf_dir)).select("id", "file", "line", "severity", "suggestion", "seed_text")


def typosquat_findings(spark, sf_dir):
    return _verdicts(spark, sf_dir).where("size(reasons) > 0").select("ecosystem", "name", "nearest", "distance", F.array_join("reasons", ",").alias("reasons"), "file", "line")


def phantom_import_findings(spark, sf_dir):
    p = _packages(spark, sf_dir)
    return detect.phantom_imports(detect.resolve_imports(p["imports"], *p["known"])).select("id", "file", "line", "seed_text")


def builtin_modules(spark, sf_dir):
    """Imports of standard and aliased modules, by customer key."""
    names = ("fs", "node:path", "left-pad", "os", "yaml", "PIL", "asyncore")
    eco = ("npm", "npm", "npm", "pypi", "pypi", "pypi", "pypi")
    k = F.col("c_custkey") % len(names)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    imports = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.lit(1).alias("line"), pick(eco).alias("ecosystem"), pick(names).alias("name"), pick(names).alias("spec"))
    declared = spark.createDataFrame([("pypi", "PyYAML"), ("npm", "express")], "ecosystem string, name string")
    found = detect.resolve_imports(imports, declared, declared.limit(0), datasets.builtins(spark), datasets.import_aliases(spark))
    return found.select(F.col("path").alias("c_custkey"), "name", "resolution")


def api_findings(spark, sf_dir):
    """Line items as uses of a supplier's members; suppliers have surfaces of each tier, and some are not declared."""
    item = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    usages = item.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("package"), F.lit(None).cast("string").alias("subpath"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("member"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("line"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    supplier = _t(spark, sf_dir, "supplier").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), "s_suppkey")
    tier = F.when(F.col("s_suppkey") % 4 == 0, "resolved").when(F.col("s_suppkey") % 4 == 1, "dynamic").otherwise("unreadable")
    tiers = supplier.where("s_suppkey % 4 < 3").select("ecosystem", F.col("name").alias("package"), F.lit(None).cast("string").alias("subpath"), tier.alias("tier"))
    surface = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'N' and l_suppkey % 4 < 2").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("package"), F.lit(None).cast("string").alias("subpath"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("member"))
    found = detect.nonexistent_apis(usages, supplier.where("s_suppkey % 3 > 0"), tiers, surface)
    return found.select("file", "line", "severity", "confidence", "seed_text")


def model_findings(spark, sf_dir):
    """Orders as assignments of model names."""
    k = F.col("o_orderkey") % 6
    value = F.when(k == 0, "gpt-5-mini").when(k == 1, "gtp-5").when(k == 2, "production").when(k == 3, "o1").when(k == 4, "anthropic.claude-3-5-sonnet-20241022-v2:0").otherwise("Big-Model-1")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").cast("int").alias("line"), F.when(F.col("o_orderstatus") == "F", "MODEL").otherwise("title").alias("name"), value.alias("value"))
    return detect.unknown_models(rows).select("file", "line", "id", "seed_text")


def dead_code_findings(spark, sf_dir):
    """Words of the benchmark as identifiers: each is declared once and used as often as it stands there; turns of conversations are string literals."""
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    texts = _t(spark, sf_dir, "conversations").select("text")
    none, one = F.lit(None).cast("string"), F.lit(1)
    shape = lambda df, kind, name, value: df.select(F.lit("src/a.js").alias("path"), F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), F.lit("function_declaration").alias("detail"), one.alias("line"), one.alias("col"), one.alias("end_line"))
    rows = shape(words, "declaration", F.col("name"), none).unionByName(shape(words, "ident", F.col("name"), F.col("n").cast("string"))).unionByName(shape(texts, "string", none, F.lower("text")))
    ranges = spark.createDataFrame([("src/a.js", 1, 1)], "path string, start int, end int")
    return detect.dead_code(rows, ranges).select("id", "file", F.regexp_extract("message", "'(.*)'", 1).alias("name"))


def names_in_strings(spark, sf_dir):
    """Words of conversations, and what is left of them without their first letter, that stand within words of documents."""
    words = _t(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    names = words.select(F.explode(F.array("word", F.substring("word", 2, 40))).alias("name"))
    return detect.named_in_strings(names, _t(spark, sf_dir, "documents").select(F.lower("text").alias("value")))


def duplicate_helper_findings(spark, sf_dir):
    """Documents as functions whose tokens are their words; every other source is a test, and half of the documents are added."""
    tokens = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), " ")
    path = F.concat(F.when(F.col("doc_id") % 10 == 3, "a/tests/").otherwise("src/"), F.col("doc_id").cast("string"), F.lit(".py"))
    functions = spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select(path.alias("path"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(2).alias("end_line"), tokens.alias("value"), "doc_id")
    ranges = functions.where("doc_id % 2 = 0").select("path", F.lit(1).alias("start"), F.lit(5).alias("end"))
    return detect.duplicate_helpers(functions.drop("doc_id"), ranges).select("file", "id", F.regexp_extract("detail", r"(\S+):\d+\z", 1).alias("partner"), "seed_text")


def orphan_file_findings(spark, sf_dir):
    """Parts as added files, line items as relative imports from a folder beside them."""
    key = F.col("p_partkey")
    added = _t(spark, sf_dir, "part").select(F.when(key % 7 == 0, F.concat(F.lit("lib/x/index"), key.cast("string"), F.lit(".test.ts"))).when(key % 7 == 1, F.concat(F.lit("lib/p"), key.cast("string"), F.lit("/index.ts"))).otherwise(F.concat(F.lit("lib/p"), key.cast("string"), F.lit(".ts"))).alias("path"))
    used = _t(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("app/"), F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("path"), F.lit("").alias("name"), F.concat(F.lit("../lib/p"), F.col("l_partkey").cast("string")).alias("value"))
    return detect.orphan_files(added, used).select("file", "id")


def env_findings(spark, sf_dir):
    """Customers as environment keys that are read, of which nations with a small key are declared; and tracked files."""
    rows = _t(spark, sf_dir, "customer").select(F.lit("env").alias("kind"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.lit(1).alias("line"), F.lit(2).alias("col"))
    keys = _t(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("key"))
    tracked = _t(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, ".env").otherwise(".env.example").alias("path"))
    return detect.undeclared_env(rows, keys).unionByName(detect.committed_env_files(tracked)).select("id", "file", "line", "suggestion")


def blocking_findings(spark, sf_dir):
    own = findings(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("command", "confidence", "detail", "suggestion")})
    return detect.blocking(own).select("id", "file", "line", "severity", "message")


def report_gate(spark, sf_dir):
    return report.gate_row(findings(spark, sf_dir).where("id <> 'error'"), "high", 10)


def _reported(spark, sf_dir) -> DataFrame:
    own = findings(spark, sf_dir).withColumns({"confidence": F.when(F.col("line") % 100 == 0, "high").otherwise("medium"), "suggestion": F.when(F.col("id") == "click", "look").otherwise(F.lit(None)), "remediation": F.concat(F.lit("fix "), "id")})
    return identity.assign_tokens(own)


def agent_report(spark, sf_dir):
    return report.agent_report(_reported(spark, sf_dir), "high", 50).select("part", F.col("no").cast("long").alias("no"), "line")


def terminal_report(spark, sf_dir):
    return report.terminal_report(_reported(spark, sf_dir), scored=True).select("part", F.col("no").cast("long").alias("no"), "line")


def whole_report(spark, sf_dir):
    """The report for people with every finding under its file, worst file first."""
    return report.terminal_report(_reported(spark, sf_dir), scored=True, verbose=True).select("part", F.col("no").cast("long").alias("no"), "line")


def suppressed_tokens(spark, sf_dir):
    """The first reason that suppresses a finding: rule, path or token."""
    own = identity.assign_tokens(findings(spark, sf_dir))
    tokens = own.where("line % 4 = 0").select("fingerprint", F.lit("token").alias("reason"))
    return baseline.with_reasons(own, {"view": "rule"}, {"1": "path"}, tokens).select("id", "file", "line", "reason")


def plan_without_suppressed(spark, sf_dir):
    own = identity.assign_tokens(findings(spark, sf_dir))
    return baseline.without_suppressed(own, own.where("line % 4 = 0")).select("id", "file", "line")


def since_snapshot(spark, sf_dir):
    """What findings of the even events add to those of every third one."""
    now = identity.assign_tokens(findings(spark, sf_dir).where("line % 2 = 0"))
    before = identity.assign_tokens(findings(spark, sf_dir).where("line % 3 = 0"))
    return baseline.split(now, "since", before)["kept"].select("id", "file", "line")


def name_status_records(spark, sf_dir):
    """Orders as name-status records: one change each, and a rename for every third."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("M\0a"), k.cast("string"), F.lit("\0"), F.when(k % 3 == 0, F.concat(F.lit("R100\0old\0new"), k.cast("string"), F.lit("\0"))).otherwise(""), F.when(k % 2 == 0, F.lit("D\0gone\0")).otherwise(""))
    return snapshots.name_status(_t(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")))


def _tree(spark, sf_dir, left_out: int, changed: int):
    orders = _t(spark, sf_dir, "orders").where(F.col("o_orderkey") % 10 != left_out)
    return orders.select(F.col("o_orderkey").cast("string").alias("path"), F.concat_ws("|", "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, changed).otherwise(0).cast("string")).alias("hash"))


def restore_actions(spark, sf_dir):
    return snapshots.restored(_tree(spark, sf_dir, 0, 0), _tree(spark, sf_dir, 1, 1))


def unchanged_trees(spark, sf_dir):
    """Days of events as trees: which have the same tree as an earlier one, after the months are laid over each other."""
    own = _t(spark, sf_dir, "events").select((F.dayofmonth("ts") % 4).alias("id"), "event_type")
    trees = own.distinct().select("id", F.col("event_type").alias("path"), F.lit("h").alias("hash"))
    hashed = snapshots.tree_hash(trees)
    return hashed.groupBy("hash").agg(F.count("*").alias("n_trees"), F.min("id").alias("first"), F.max("n").alias("n_files")).select("first", "n_trees", "n_files")


def corpus_metrics(spark, sf_dir):
    """Events as findings of apps, labels of the even ones as what is expected."""
    own = findings(spark, sf_dir).withColumn("app", F.col("line") % 3)
    expected = own.where("line % 2 = 0").select("app", "id", "file")
    return report.corpus_metrics(own.where("line % 3 <> 1"), expected, _t(spark, sf_dir, "customer").select(F.lit(1).alias("app"), F.col("c_name").alias("path")))


def free_env_key_plan(spark, sf_dir):
    """Rewriting plan: parts' secrets get free keys, in order of severity, file and line."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", fn.env_key(F.concat_ws("_", "p_name", F.lit("k"))).alias("base"), F.when(F.col("p_size") > 25, "critical").otherwise("high").alias("severity"))
    return rewrites.free_keys(rows, "base", ["p_partkey"]).select("p_partkey", "key", "severity")


def registry_answers(spark, sf_dir):
    """Events as attempts to ask a registry: the last one counts, and only clear answers are kept."""
    status = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 404).otherwise(503)
    responses = _t(spark, sf_dir, "events").select(F.lit("npm").alias("ecosystem"), F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("attempt"), status.alias("status"))
    return registry.existence_rows(responses, NOW)


def registry_metadata(spark, sf_dir):
    """Orders as bodies of a registry."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    bodies = _t(spark, sf_dir, "orders").select(
        F.when(k % 5 == 0, "pypi").otherwise("npm").alias("ecosystem"), k.cast("string").alias("name"), F.when(k % 3 == 0, "<html>").otherwise(F.concat(F.lit('{"downloads": '), (k - 50).cast("string"), F.lit("}"))).alias("downloads_body"),
        F.concat(F.lit('{"time": {"created": "'), F.when(k % 4 == 0, "2024-02-30").otherwise(day), F.lit('T00:00:10.5Z"}}')).alias("time_body"),
    )
    return registry.metadata_rows(bodies, 900_000_000).select("ecosystem", "name", "downloads", "created_at")


def _diffs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    old, new = F.when(k % 4 == 0, "/dev/null").otherwise(F.concat(F.lit("a/f"), k.cast("string"))), F.when(k % 4 == 1, "/dev/null").otherwise(F.concat(F.lit("b/g"), k.cast("string")))
    text = F.concat(F.lit("diff --git a/x b/y\nindex 1..2\n--- "), old, F.lit("\n+++ "), new, F.lit("\n@@ -1,2 +"), (k % 90 + 1).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(","), (k % 3 - 1).cast("string"))), F.lit(" @@ f()\n--- a/not a header\n+++ b/neither\n@@ -9 +200,3 @@\n+x\ndiff --git a/z b/z\nsimilarity index 100%\nrename from z\nrename to w\n"))
    return diff.changes(spread(_t(spark, sf_dir, "orders").select("o_orderkey")).select(k.alias("id"), text.alias("text")), "id")


def diff_files(spark, sf_dir):
    """Orders as diffs: added, deleted and modified files."""
    return _diffs(spark, sf_dir)[0]


def diff_added_ranges(spark, sf_dir):
    return _diffs(spark, sf_dir)[1]


QUERIES = {
    f.__name__: f
    for f in (
        registry_answers, registry_metadata, diff_files, diff_added_ranges, secret_shapes, package_findings, typosquat_findings, phantom_import_findings, builtin_modules, api_findings, model_findings, dead_code_findings, names_in_strings, duplicate_helper_findings, orphan_file_findings, env_findings, blocking_findings,
        report_gate, agent_report, terminal_report, whole_report, suppressed_tokens, plan_without_suppressed, since_snapshot, name_status_records, restore_actions, unchanged_trees, corpus_metrics, free_env_key_plan,
    )
}
_P = f"""d AS (SELECT p_partkey AS k, p_brand || '/manifest' AS manifest FROM part WHERE p_size % 4 > 0),
 i AS (SELECT l_partkey AS k, 'src/f' || l_suppkey AS path, CAST(l_orderkey AS INTEGER) AS line, l_orderkey * 100 + l_linenumber AS seq FROM lineitem),
 ph AS (SELECT * FROM i WHERE k NOT IN (SELECT k FROM d)),
 names AS (SELECT k FROM d UNION SELECT k FROM ph),
 site AS (SELECT k, min_by(path, seq) AS path, min_by(line, seq) AS line FROM i GROUP BY k),
 popular AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, 'pkg-' || p_partkey * 11 || 'x' AS name, p_partkey AS pos FROM part WHERE p_partkey <= 9),
 v AS (SELECT n.k, 'pkg-' || n.k AS name, CASE WHEN n.k % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, p_size,
   CASE WHEN p_size > 5 AND p_size * 20000 <= 7 * 86400 THEN CASE WHEN p_size % 5 = 0 THEN 'missing' ELSE 'exists' END ELSE 'inconclusive' END AS existence FROM names n JOIN part ON p_partkey = n.k),
 near AS (SELECT v.k, p.name AS nearest, CAST(damerau_levenshtein(v.name, p.name) AS INTEGER) AS distance FROM v JOIN popular p ON v.ecosystem = p.ecosystem AND abs(length(v.name) - length(p.name)) <= 2
   WHERE levenshtein(v.name, p.name) <= 4 AND v.name NOT IN (SELECT name FROM popular) QUALIFY row_number() OVER (PARTITION BY v.k ORDER BY damerau_levenshtein(v.name, p.name), pos) = 1),
 w AS (SELECT v.*, nearest, distance, coalesce(site.path, manifest, CASE ecosystem WHEN 'npm' THEN 'package.json' ELSE 'pyproject.toml' END) AS file, site.line,
   list_filter([CASE WHEN distance BETWEEN 1 AND 2 THEN 'near-name' END, CASE WHEN ecosystem = 'npm' AND existence = 'exists' AND p_size * 40 < 1000 THEN 'low-downloads' END,
     CASE WHEN ecosystem = 'npm' AND existence = 'exists' AND p_size * 1000000 < 90 * 86400 THEN 'new-package' END], lambda x: x IS NOT NULL) AS reasons
   FROM v LEFT JOIN near USING (k) LEFT JOIN site USING (k) LEFT JOIN d USING (k))"""
_REP = f"""{_F}, {_TOKENS}, r AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place, CASE WHEN line % 100 = 0 THEN '' ELSE ' (confidence: medium)' END AS doubt,
 CASE WHEN id = 'click' THEN 'look' ELSE 'fix ' || id END AS action FROM t), s AS (SELECT {', '.join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ('critical', 'high', 'medium', 'low', 'info'))}, count(*) FILTER (fixable) AS fixable, count(*) AS n, {_SCORE} AS score FROM r)"""
_COUNTED = "critical || ' critical · ' || high || ' high · ' || medium || ' medium · ' || low || ' low · ' || info || ' info'"
_TERMINAL = f"""WITH {_REP}, g AS (SELECT file, min(place) AS fp, count(*) AS c, {', '.join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ('critical', 'high', 'medium', 'low', 'info'))} FROM r GROUP BY file), shown AS (SELECT n <= BEYOND AS all_of_them FROM s)
      SELECT CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS no, '┌─ check ' || repeat('─', 38) || '┐' AS line UNION ALL SELECT 0, 1, '│' || rpad('  Score: ' || score || '/100', 46, ' ') || '│' FROM s
      UNION ALL SELECT 0, 2, '│' || rpad('  ' || critical || ' critical · ' || high || ' high · ' || medium || ' medium · ' || low || ' low', 46, ' ') || '│' FROM s UNION ALL SELECT 0, 3, '└' || repeat('─', 46) || '┘'
      UNION ALL SELECT 1, 0, file || ' — ' || c || CASE WHEN c = 1 THEN ' finding' ELSE ' findings' END || ' · ' || array_to_string(list_filter([{', '.join(f"CASE WHEN {x} > 0 THEN {x} || ' {x}' END" for x in ('critical', 'high', 'medium', 'low', 'info'))}], lambda x: x IS NOT NULL), ' · ') FROM g, shown WHERE all_of_them
      UNION ALL SELECT 1, place * 2, '  ' || lpad(CAST(line AS VARCHAR), 8, ' ') || ' ' || CASE severity WHEN 'critical' THEN '✖' WHEN 'high' THEN '▲' WHEN 'medium' THEN '●' WHEN 'low' THEN '○' ELSE '·' END || ' ' || rpad(severity, 8, ' ') || ' ' || message || doubt || '  ' || id FROM r, shown WHERE all_of_them
      UNION ALL SELECT 1, place * 2 + 1, '  ' || repeat(' ', 8) || ' → ' || action FROM r, shown WHERE all_of_them
      UNION ALL SELECT 2, place, '  ' || place || '. ' || id || ' ' || file || ':' || line || ' — ' || message FROM r WHERE place <= 3
      UNION ALL SELECT 3, 0, n || ' findings: ' || {_COUNTED} || ' (' || fixable || ' fixable)' FROM s"""
_HASH = "substr(sha256(array_to_string(w[i:i+4], ' ')), 1, 16)"
_LE = "array_to_string(list_transform(range(15, 0, -2), lambda p: substr(x, p, 2)), '')"
_G = "CASE o_orderkey % 4 WHEN 1 THEN 'f' ELSE 'g' END || o_orderkey"
ORACLE_SQL = {
    "registry_answers": f"WITH l AS (SELECT user_id, max_by(event_type, event_id) AS t FROM events GROUP BY user_id) SELECT 'npm' AS ecosystem, CAST(user_id AS VARCHAR) AS name, CAST(CASE t WHEN 'view' THEN 1 ELSE 0 END AS INTEGER) AS exists_flag, CAST({NOW} AS BIGINT) AS fetched_at FROM l WHERE t IN ('view', 'click')",
    "registry_metadata": "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 AND o_orderkey >= 50 THEN o_orderkey - 50 END AS downloads, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 4 > 0 AND epoch(date_trunc('day', o_orderdate)) + 10 <= 900000000 THEN CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 10 END AS created_at FROM orders",
    "diff_files": f"SELECT o_orderkey AS id, {_G} AS path, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'D' ELSE 'M' END AS status FROM orders",
    "diff_added_ranges": f"SELECT o_orderkey AS id, {_G} AS path, CAST(o_orderkey % 90 + 1 AS INTEGER) AS start, CAST(o_orderkey % 90 + 1 AS INTEGER) AS \"end\" FROM orders WHERE o_orderkey % 3 <> 1 UNION ALL SELECT o_orderkey, {_G}, 200, 202 FROM orders",
    "secret_shapes": "SELECT p_partkey, CASE WHEN (p_partkey // 15) % 2 = 0 THEN CASE p_partkey % 15 " + " ".join(f"WHEN {i} THEN '{s[0]}'" for i, s in enumerate(SHAPES)) + " END END AS shape FROM part",
    "package_findings": f"WITH {_P} SELECT 'real/nonexistent-package' AS id, file, line, 'critical' AS severity, CASE WHEN distance BETWEEN 1 AND 2 THEN 'perhaps ''' || nearest || ''' is meant' END AS suggestion, name AS seed_text FROM w WHERE existence = 'missing'",
    "typosquat_findings": f"WITH {_P} SELECT ecosystem, name, nearest, distance, array_to_string(reasons, ',') AS reasons, file, line FROM w WHERE len(reasons) > 0",
    "phantom_import_findings": f"WITH {_P} SELECT 'real/phantom-import' AS id, path AS file, line, 'pkg-' || k AS seed_text FROM ph",
    "builtin_modules": "SELECT c_custkey, name, resolution FROM customer JOIN (VALUES (0, 'fs', 'builtin'), (1, 'node:path', 'builtin'), (2, 'left-pad', 'phantom'), (3, 'os', 'builtin'), (4, 'yaml', 'declared'), (5, 'PIL', 'phantom'), (6, 'asyncore', 'builtin')) m(k, name, resolution) ON c_custkey % 7 = k",
    "api_findings": """WITH u AS (SELECT l_suppkey AS s, l_partkey AS p, l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 > 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier)),
      m AS (SELECT * FROM u WHERE NOT (s % 4 < 2 AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'N' AND x.l_suppkey = s AND x.l_partkey = p)))
      SELECT 'f' || o AS file, n AS line, CASE WHEN s % 4 = 0 THEN 'high' ELSE 'info' END AS severity, CASE WHEN s % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence, 's' || s || '.m' || p AS seed_text FROM m WHERE s % 4 < 2
      UNION ALL SELECT 'f' || o, n, 'info', 'low', 's' || s FROM m WHERE s % 4 >= 2 QUALIFY row_number() OVER (PARTITION BY s ORDER BY o, n) = 1""",
    "model_findings": "SELECT CAST(o_orderkey AS VARCHAR) AS file, CAST(o_custkey AS INTEGER) AS line, 'real/unknown-model-string' AS id, 'gtp-5' AS seed_text FROM orders WHERE o_orderkey % 6 = 1 AND o_orderstatus = 'F'",
    "dead_code_findings": "WITH w AS (SELECT name FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark) GROUP BY name HAVING count(*) = 1) SELECT 'review/dead-code-introduced' AS id, 'src/a.js' AS file, name FROM w WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE contains(lower(text), name))",
    "names_in_strings": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), n AS (SELECT word AS name FROM w UNION SELECT substr(word, 2, 40) FROM w WHERE length(word) > 1),
      r AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_$]+')) AS run FROM documents) SELECT name FROM n WHERE EXISTS (SELECT 1 FROM r WHERE contains(run, name))""",
    "duplicate_helper_findings": f"""WITH f AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'a/tests/' ELSE 'src/' END || doc_id || '.py' AS path, doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
      h AS (SELECT path, doc_id, list_distinct(list_transform(list_transform(range(1, len(w) - 3), lambda i: {_HASH}), lambda x: {_LE})) AS h FROM f WHERE len(w) >= 25 AND NOT contains(path, '/tests/')),
      k AS (SELECT *, list_slice(list_sort(h), 1, 4) AS k FROM h), m AS (SELECT path, unnest(k) AS x FROM k), b AS (SELECT x FROM m GROUP BY x HAVING count(*) BETWEEN 2 AND 64),
      p AS (SELECT DISTINCT y.path AS a, z.path AS b FROM m y JOIN b USING (x) JOIN m z USING (x) WHERE y.path <> z.path),
      j AS (SELECT p.a, p.b, y.doc_id, y.k, len(list_intersect(y.h, z.h)) AS n, len(y.h) + len(z.h) AS t FROM p JOIN k y ON y.path = p.a JOIN k z ON z.path = p.b)
      SELECT a AS file, 'review/duplicate-helper' AS id, min(b) AS partner, array_to_string(list_transform(any_value(k), lambda x: regexp_replace(x, '^0+(.)', '\\1')), ',') AS seed_text FROM j WHERE n / (t - n) >= 0.85 AND doc_id % 2 = 0 GROUP BY a""",
    "orphan_file_findings": "SELECT CASE WHEN p_partkey % 7 = 1 THEN NULL ELSE 'lib/p' || p_partkey || '.ts' END AS file, 'review/orphan-file' AS id FROM part WHERE p_partkey % 7 > 1 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)",
    "env_findings": "SELECT 'ship/missing-env-declaration' AS id, 'c' || c_custkey AS file, CAST(1 AS INTEGER) AS line, 'NATION_' || c_nationkey || '=' AS suggestion FROM customer WHERE c_nationkey >= 10 UNION ALL SELECT 'env/env-file-committed', '.env', NULL, NULL",
    "blocking_findings": f"WITH {_F} SELECT 'ship/blocking-findings' AS id, file, line, severity, 'critical (' || id || '): ' || message AS message FROM f WHERE severity = 'critical'",
    "report_gate": f"""WITH {_F}, s AS (SELECT {', '.join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ('critical', 'high', 'medium', 'low', 'info'))}, count(*) FILTER (fixable) AS fixable, {_SCORE} AS score FROM f WHERE id <> 'error')
      SELECT *, high > 0 AS failed_severity, score < 10 AS failed_score, high > 0 OR score < 10 AS failed, CAST(CASE WHEN high > 0 OR score < 10 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM s""",
    "agent_report": f"""WITH {_REP}, a AS (SELECT action, min(place) AS p FROM r GROUP BY action), o AS (SELECT *, row_number() OVER (ORDER BY p) AS no FROM a)
      SELECT CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS no, 'GATE: fail · score ' || score || '/100 < min 50 · high+ findings ≥ high' AS line FROM s
      UNION ALL SELECT 0, 1, 'SUMMARY: ' || n || ' findings · ' || {_COUNTED} || ' · ' || fixable || ' fixable · score ' || score || '/100' FROM s UNION ALL SELECT 0, 2, 'FINDINGS:'
      UNION ALL SELECT 1, place, severity || ' ' || id || ' ' || file || ':' || line || ' — ' || message || doubt || CASE WHEN fixable THEN ' [fixable]' ELSE '' END || ' ' || fingerprint FROM r
      UNION ALL SELECT 2, 0, 'NEXT ACTIONS:' UNION ALL SELECT 3, no, '- ' || action FROM o WHERE no <= 10 UNION ALL SELECT 4, 0, '… (' || (count(*) - 10) || ' more)' FROM o HAVING count(*) > 10""",
    "terminal_report": _TERMINAL.replace("BEYOND", "25"),
    "whole_report": _TERMINAL.replace("BEYOND", "n"),
    "suppressed_tokens": f"WITH {_F}, {_TOKENS} SELECT id, file, line, CASE WHEN id = 'view' THEN 'rule' WHEN starts_with(file, '1') THEN 'path' WHEN line % 4 = 0 THEN 'token' END AS reason FROM t",
    "plan_without_suppressed": f"WITH {_F} SELECT id, file, line FROM f WHERE line % 4 <> 0",
    "since_snapshot": f"""WITH {_F}, e AS (SELECT *, 2 AS m FROM f WHERE line % 2 = 0 UNION ALL SELECT *, 3 FROM f WHERE line % 3 = 0),
      t AS (SELECT *, digest || CASE WHEN count(*) OVER (PARTITION BY m, digest) > 1 THEN '#' || (row_number() OVER (PARTITION BY m, digest ORDER BY line) - 1) ELSE '' END AS token FROM (SELECT *, id || file || message AS digest FROM e))
      SELECT id, file, line FROM t WHERE m = 2 AND token NOT IN (SELECT token FROM t WHERE m = 3)""",
    "name_status_records": "SELECT o_orderkey AS id, 'a' || o_orderkey AS path, 'M' AS status FROM orders UNION ALL SELECT o_orderkey, 'new' || o_orderkey, 'R' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'gone', 'D' FROM orders WHERE o_orderkey % 2 = 0",
    "restore_actions": "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 10 = 1 THEN 'delete' ELSE 'write' END AS action FROM orders WHERE o_orderkey % 10 IN (0, 1) OR o_orderkey % 7 = 0",
    "unchanged_trees": "WITH t AS (SELECT DISTINCT CAST(day(ts) % 4 AS INTEGER) AS id, event_type FROM events), g AS (SELECT id, string_agg(event_type, ',' ORDER BY event_type) AS h, count(*) AS n FROM t GROUP BY id) SELECT min(id) AS first, count(*) AS n_trees, CAST(max(n) AS BIGINT) AS n_files FROM g GROUP BY h",
    "corpus_metrics": f"""WITH {_F}, o AS (SELECT line % 3 AS app, id, file, max({_RANK}) AS worst, count(*) AS n FROM f WHERE line % 3 <> 1 GROUP BY ALL), x AS (SELECT DISTINCT line % 3 AS app, id, file, true AS wanted FROM f WHERE line % 2 = 0),
      b AS (SELECT coalesce(o.id, x.id) AS id, wanted, n, worst FROM o FULL OUTER JOIN x ON o.app = x.app AND o.id = x.id AND o.file = x.file),
      g AS (SELECT id, count(*) FILTER (wanted) AS expected, count(*) FILTER (wanted AND n > 0) AS found, CAST(coalesce(sum(n) FILTER (wanted), 0) AS BIGINT) AS t, CAST(coalesce(sum(n) FILTER (wanted IS NULL), 0) AS BIGINT) AS w, coalesce(sum(n) FILTER (wanted IS NULL AND worst >= 2), 0) AS loud FROM b GROUP BY id)
      SELECT id, expected, found, CASE WHEN expected > 0 THEN round(found / expected, 6) END AS recall, t AS "true", w AS "false", CASE WHEN t + w > 0 THEN round(t / (t + w), 6) END AS precision, round(loud / (SELECT count(*) FROM customer), 6) AS false_rate FROM g""",
    "free_env_key_plan": "WITH b AS (SELECT p_partkey, upper(replace(p_name, ' ', '_')) || '_K' AS base, CASE WHEN p_size > 25 THEN 'critical' ELSE 'high' END AS severity FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b) SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS key, severity FROM n",
}
