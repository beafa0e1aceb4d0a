"""Queries over names and references, with parts, orders and line items as packages and their uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import paths
from sieveline.functions import text as fn
from sieveline.operators import packages, references, rewrites, rules, snapshots


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pep503_names(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", fn.normalize_name(F.concat_ws("_.", "p_name", "p_type")).alias("name"), fn.first_segment(F.concat_ws(".", "p_brand", "p_type")).alias("first"))


def _names(spark, sf_dir):
    """Names with one edit that depends on the key; popular are the plain ones of even length."""
    part = _t(spark, sf_dir, "part")
    name, k = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey")
    edited = F.when(k % 3 == 0, F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substring(name, F.lit(3), F.length(name)))).when(k % 3 == 1, F.concat(name, F.lit("s"))).otherwise(name)
    popular = part.select(name.alias("name"), "p_partkey").groupBy("name").agg(F.min("p_partkey").alias("pos")).where(F.length("name") % 2 == 0)
    return part.select(edited.alias("name")).distinct(), popular


def typosquat_near_names(spark, sf_dir):
    return packages.near_names(*_names(spark, sf_dir))


def typosquat_reasons(spark, sf_dir):
    names, popular = _names(spark, sf_dir)
    facts = names.select("name", (F.length("name") * 200).cast("long").alias("downloads"), (F.lit(1_000_000_000) - F.length("name") * 1_000_000).cast("long").alias("created_at"))
    found = packages.suspicion(facts, packages.near_names(names, popular), 1_000_000_000)
    return found.select("name", "nearest", "distance", F.array_join("reasons", ",").alias("reasons"))


def resolution_cascade(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_linenumber").cast("string").alias("raw_spec"), (F.col("l_linenumber") == 1).alias("is_relative"), "l_orderkey", "l_linenumber")
    part = _t(spark, sf_dir, "part").withColumnRenamed("p_partkey", "name")
    found = packages.resolve(items, part.where("p_size < 5"), part.where("p_type = 'ECONOMY'"), part.where("p_retailprice > 1000"))
    return found.select("l_orderkey", "l_linenumber", "name", "resolution")


def phantom_refs(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return references.undeclared(items, _t(spark, sf_dir, "part").where("p_size <= 40"), "p_partkey")


def undeclared_refs(spark, sf_dir):
    """Customers without a finished order above a price."""
    customers = _t(spark, sf_dir, "customer").select("c_custkey")
    return references.undeclared(customers, _t(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def candidate_names(spark, sf_dir):
    declared = _t(spark, sf_dir, "orders").select(F.lit("npm").alias("ecosystem"), F.col("o_custkey").alias("name"), (F.col("o_orderstatus") == "F").alias("is_direct"))
    return packages.candidates(declared, _t(spark, sf_dir, "customer").select(F.lit("npm").alias("ecosystem"), F.col("c_custkey").alias("name")))


def first_import_site(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    imports = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("name"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"))
    declared = _t(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("manifest"))
    return packages.first_site(parts, imports, declared, "manifest")


def orphan_keys(spark, sf_dir):
    files = _t(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"))
    imports = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("src/p"), F.col("l_partkey").cast("string")).alias("base"))
    return references.orphan_files(files, imports)


def dead_names(spark, sf_dir):
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("name")).where("name <> ''")
    return references.dead_names(words.distinct(), words.groupBy("name").agg(F.count("*").alias("n"))).select("name")


def _usage(spark, sf_dir):
    usages = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("member"), "l_orderkey", "l_linenumber")
    tiers = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("package"), F.when(F.col("s_acctbal") > 0, "trusted").otherwise("dynamic").alias("tier"))
    surface = _t(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("member"))
    return references.surface_misses(usages, tiers.where("package % 3 <> 0"), tiers, surface)


def usage_surface_miss(spark, sf_dir):
    return _usage(spark, sf_dir).select("package", "member", "tier", "l_orderkey", "l_linenumber")


def miss_rollup(spark, sf_dir):
    return references.roll_up(_usage(spark, sf_dir).withColumn("seq", F.struct("l_orderkey", "l_linenumber")), ["package", "tier"], "seq", "l_orderkey", "l_linenumber")


def introduced_lines(spark, sf_dir):
    """Line items as places in a supplier's file, against price ranges of parts as added ranges."""
    hits = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("path"), (F.col("l_extendedprice") / 100).cast("int").alias("line"), "l_orderkey", "l_linenumber")
    ranges = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("path"), F.col("p_partkey").cast("int").alias("start"), (F.col("p_partkey") + 30).cast("int").alias("end"))
    return references.in_ranges(hits, ranges)


def rule_gating_matrix(spark, sf_dir):
    pack = rules.pack_frame(spark, rules.EXAMPLE_PACK)
    files = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return rules.gate(files, pack, ["express"]).select("doc_id", F.col("rule_id").alias("rule"))


def text_rule_hits(spark, sf_dir):
    pack = rules.pack_frame(spark, rules.EXAMPLE_PACK)
    files = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return rules.text_hits(files, pack, ["express"]).select("doc_id", F.col("rule_id").alias("rule"), "severity")


def glob_filter(spark, sf_dir):
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    match = [path.rlike(fn.glob_regex(g)).alias(n) for n, g in (("any", "**/*.txt"), ("english", "*/en/*"), ("some", "src{1,2}/**"), ("one", "src?/*/*"))]
    return _t(spark, sf_dir, "documents").select("doc_id", *match)


def relative_imports(spark, sf_dir):
    """Line items as imports: a file two folders deep, and a specifier that goes up by quantity."""
    file = F.concat(F.lit("a/b"), F.col("l_suppkey").cast("string"), F.lit("/f.ts"))
    spec = F.concat(F.lit("./"), F.repeat(F.lit("../"), (F.col("l_linenumber") % 4)), F.lit("x/./p"), F.col("l_partkey").cast("string"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", paths.resolve_relative(file, spec).alias("path"))


def free_env_keys(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", fn.env_key(F.concat_ws("_", "p_name", (F.col("p_size") % 3).cast("string"))).alias("base"))
    return rewrites.free_keys(rows, "base", ["p_partkey"], ["RED_BOLT_1"]).select("p_partkey", "key")


def span_rewrites(spark, sf_dir):
    """Each benchmark text with its first word and its sixth to tenth characters replaced."""
    texts = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), "text")
    first = F.length(F.regexp_extract("text", r"\A([A-Za-z]{0,4})", 1))
    spans = texts.select("path", F.lit(0).alias("start"), first.alias("end"), F.substring("text", F.lit(1), first).alias("old"), F.lit("WORD").alias("new"))
    later = texts.select("path", F.lit(5).alias("start"), F.lit(10).alias("end"), F.substring("text", 6, 5).alias("old"), F.lit("<>").alias("new"))
    return rewrites.apply_spans(texts, spans.unionByName(later)).select("path", "text", "stale")


def resolve_snapshot_ids(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    rows = orders.select((F.col("o_orderkey") % 5000).alias("id"), F.when(F.col("o_orderstatus") == "F", "manual").otherwise("auto").alias("namespace"))
    return snapshots.resolve_ids(_t(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("id")), rows)


def declared_stack(spark, sf_dir):
    kinds = F.when(F.col("p_name").endswith("bolt"), "flask").when(F.col("p_name").endswith("ring"), "django").otherwise("other")
    declared = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), kinds.alias("name"), F.when(F.col("p_size") > 10, "pypi").otherwise("npm").alias("ecosystem"))
    return rewrites.stack_of(declared)


def many_pattern_hits(spark, sf_dir):
    """Neighbouring words of the benchmark as text rules, hundreds of them, over documents: how many each one matches, and the first."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("w"))
    pairs = words.select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], '[ ]', w[i]))")).alias("p")).distinct()
    pack = tuple(rules.Rule(f"pair/{r.p.replace('[ ]', '-')}", "low", text_pattern=r.p) for r in pairs.orderBy("p").collect())  # a pack is held by the driver
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.lit("a").alias("path"), "text")
    hits = rules.text_hits(files, rules.pack_frame(spark, pack), [])
    return hits.groupBy(F.col("rule_id").alias("rule")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        pep503_names, typosquat_near_names, typosquat_reasons, resolution_cascade, phantom_refs, undeclared_refs, candidate_names, first_import_site, orphan_keys, dead_names,
        usage_surface_miss, miss_rollup, introduced_lines, rule_gating_matrix, text_rule_hits, many_pattern_hits, glob_filter,
        relative_imports, free_env_keys, span_rewrites, resolve_snapshot_ids, declared_stack,
    )
}
_N = """part_n AS (SELECT replace(p_name, ' ', '-') AS name, p_partkey AS k FROM part),
 names AS (SELECT DISTINCT CASE WHEN k % 3 = 0 THEN name[2:2] || name[1:1] || name[3:] WHEN k % 3 = 1 THEN name || 's' ELSE name END AS name FROM part_n),
 popular AS (SELECT name, min(k) AS pos FROM part_n GROUP BY name HAVING length(name) % 2 = 0),
 near AS (SELECT n.name, p.name AS nearest, CAST(damerau_levenshtein(n.name, p.name) AS INTEGER) AS distance FROM names n JOIN popular p ON abs(length(n.name) - length(p.name)) <= 2
   WHERE n.name NOT IN (SELECT name FROM popular) AND levenshtein(n.name, p.name) <= 4
   QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY damerau_levenshtein(n.name, p.name), pos) = 1)"""
_U = """u AS (SELECT l_suppkey AS package, l_partkey AS member, CASE WHEN s_acctbal > 0 THEN 'trusted' ELSE 'dynamic' END AS tier, l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 WHERE l_suppkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_returnflag <> 'R' AND o.l_suppkey = lineitem.l_suppkey AND o.l_partkey = lineitem.l_partkey))"""
_GATES = rules.sql_gates(rules.EXAMPLE_PACK, ["express"])
_PATH = "source || '/' || doc_id || '.txt'"
ORACLE_SQL = {
    "free_env_keys": "WITH b AS (SELECT p_partkey, upper(replace(p_name, ' ', '_')) || '_' || p_size % 3 AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) + CASE WHEN base = 'RED_BOLT_1' THEN 1 ELSE 0 END AS n FROM b) SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS key FROM n",
    "pep503_names": "SELECT p_partkey, lower(regexp_replace(p_name || '_.' || p_type, '[-_.]+', '-', 'g')) AS name, split_part(p_brand || '.' || p_type, '.', 1) AS first FROM part",
    "typosquat_near_names": f"WITH {_N} SELECT name, nearest, distance FROM near",
    "typosquat_reasons": f"WITH {_N}, r AS (SELECT names.name, nearest, distance, list_filter([CASE WHEN distance BETWEEN 1 AND 2 THEN 'near-name' END, CASE WHEN length(names.name) * 200 < 1000 THEN 'low-downloads' END, CASE WHEN length(names.name) * 1000000 < 90 * 86400 THEN 'new-package' END], lambda x: x IS NOT NULL) AS r FROM names LEFT JOIN near ON names.name = near.name) SELECT name, nearest, distance, array_to_string(r, ',') AS reasons FROM r WHERE len(r) > 0",
    "resolution_cascade": "SELECT l_orderkey, l_linenumber, l_partkey AS name, CASE WHEN l_linenumber = 1 THEN 'local' WHEN p_size < 5 THEN 'builtin' WHEN p_type = 'ECONOMY' THEN 'declared' WHEN p_retailprice > 1000 THEN 'local' ELSE 'phantom' END AS resolution FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "phantom_refs": "SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40)",
    "undeclared_refs": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 250000)",
    "candidate_names": "SELECT 'npm' AS ecosystem, name, bool_or(d) AS is_direct FROM (SELECT o_custkey AS name, o_orderstatus = 'F' AS d FROM orders UNION ALL SELECT c_custkey, false FROM customer) GROUP BY name",
    "first_import_site": "WITH i AS (SELECT l_partkey AS name, CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1) SELECT p_partkey AS name, coalesce(file, CASE WHEN p_size < 25 THEN p_brand END, 'manifest') AS file, line FROM part LEFT JOIN i ON name = p_partkey",
    "orphan_keys": "SELECT 'src/p' || p_partkey || '.ts' AS path FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "dead_names": "SELECT name FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS name FROM benchmark) WHERE name <> '' GROUP BY name HAVING count(*) <= 1",
    "usage_surface_miss": f"WITH {_U} SELECT package, member, tier, l_orderkey, l_linenumber FROM u",
    "miss_rollup": f"WITH {_U}, r AS (SELECT *, count(*) OVER (PARTITION BY package, tier) AS n, row_number() OVER (PARTITION BY package, tier ORDER BY l_orderkey, l_linenumber) AS p FROM u) SELECT package, tier, n, l_orderkey AS first_l_orderkey, l_linenumber AS first_l_linenumber FROM r WHERE p = 1",
    "introduced_lines": "WITH h AS (SELECT l_suppkey % 20 AS path, CAST(trunc(l_extendedprice / 100) AS INTEGER) AS line, l_orderkey, l_linenumber FROM lineitem) SELECT path, line, l_orderkey, l_linenumber FROM h WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 20 = path AND line BETWEEN p_partkey AND p_partkey + 30)",
    "rule_gating_matrix": f"WITH d AS (SELECT doc_id, lang, {_PATH} AS path FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule FROM d WHERE {g}" for r, _, g, _ in _GATES),
    "many_pattern_hits": """WITH w AS (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), p AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM w)
      SELECT 'pair/' || replace(p, ' ', '-') AS rule, count(*) AS n, min(doc_id) AS first FROM p JOIN documents ON contains(text, p) GROUP BY p""",
    "text_rule_hits": f"WITH d AS (SELECT doc_id, lang, {_PATH} AS path, text FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, '{s}' AS severity FROM d WHERE {g} AND regexp_matches(text, '{t}')" for r, s, g, t in _GATES),
    "relative_imports": "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'a/b' || l_suppkey || '/x/p' || l_partkey WHEN 1 THEN 'a/x/p' || l_partkey WHEN 2 THEN 'x/p' || l_partkey END AS path FROM lineitem",
    "span_rewrites": "WITH s AS (SELECT item_id, text, length(regexp_extract(text, '^([A-Za-z]{0,4})', 1)) AS n FROM benchmark) SELECT item_id AS path, 'WORD' || substr(text, n + 1, 5 - n) || '<>' || substr(text, 11) AS text, false AS stale FROM s",
    "resolve_snapshot_ids": "WITH r AS (SELECT o_orderkey % 5000 AS id, CASE WHEN o_orderstatus = 'F' THEN 'manual' ELSE 'auto' END AS namespace FROM orders) SELECT c_custkey * 7 AS id, (SELECT max(namespace) FROM r WHERE r.id = c_custkey * 7) AS namespace FROM customer",
    "declared_stack": "WITH d AS (SELECT p_brand AS project, p_name, CASE WHEN p_size > 10 THEN 'pypi' ELSE 'npm' END AS e FROM part) SELECT project, CASE WHEN bool_or(ends_with(p_name, 'bolt')) THEN 'flask' WHEN bool_or(ends_with(p_name, 'ring')) THEN 'django' WHEN bool_or(e = 'npm') THEN 'node' ELSE 'unknown' END AS stack FROM d GROUP BY project",
    "glob_filter": "WITH p AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents) SELECT doc_id, regexp_matches(path, '\\.txt$') AS \"any\", regexp_matches(path, '^[^/]*/en/[^/]*$') AS english, regexp_matches(path, '^src(1|2)/') AS \"some\", regexp_matches(path, '^src[^/]/[^/]*/[^/]*$') AS one FROM p",
}
