"""Queries over single functions of names, values, sizes and times, with parts and orders as their inputs, and over relations that no other query reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import text as fn
from sieveline.operators import detect, places, references, report
from sieveline.plans.findings_plans import _F, findings


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(k: Column, *values) -> Column:
    """The value that k names, from 0; texts with {k} hold the part's key and {n} its name."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        text = F.replace(F.replace(F.lit(v), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{n}"), F.col("p_name"))
        out = F.when(k % len(values) == i, text).otherwise(out)
    return out


_SPECS = ("@s/p{k}/sub/x", "p{k}/lib", "p{k}", "@s/p{k}", "./p{k}")
_LITERALS = ('"{n}"', "'{n}'", 'f"{n}"', '"""{n}"""', "r'{n}'", "`{n}`", "{n}")
_COMMENTS = ("// {n}", "# {n}", "/* {n} */", "  * {n}", "-- {n}", "{n}")
_TOKENS = ("gdv1:{k}", "gdv1:{k}#2", "gdv1:", "gdv2:{k}", "gdv1:x{k}", "gdv1:ab{k}#")
_VALUES = ("p{k}", "{n}", '{n} "{k}"', "a\\b{k}", "x\n{k}", "")
_CODES = ("exists", "missing", "near-name", "pypi", "other{k}")


def name_functions(spark, sf_dir):
    """Parts as specifiers, literals, comments, tokens and values."""
    k = F.col("p_partkey")
    module = fn.split_module(_pick(k, *_SPECS))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", module["package"].alias("package"), module["subpath"].alias("subpath"), fn.unquote(_pick(k, *_LITERALS)).alias("literal"), fn.strip_comment(_pick(k, *_COMMENTS)).alias("comment"), fn.valid_token(_pick(k, *_TOKENS)).alias("is_token"),
        fn.dotenv_quote(_pick(k, *_VALUES)).alias("value"), fn.label(_pick(k, *_CODES)).alias("label"), fn.slash_path(F.concat(F.lit("a\\"), "p_brand", F.lit("\\b"))).alias("path"), fn.percent_scoped(F.concat(F.lit("@s/"), "p_name")).alias("encoded"),
    )


def time_functions(spark, sf_dir):
    """Orders as sizes, ages, times and versions."""
    k, date = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    wide = k.cast("decimal(38,0)")  # keys of some million make sizes beyond a long
    size = (wide * wide * 2 + 1) * F.when(k % 3 == 0, 1).when(k % 3 == 1, 333).otherwise(77_777)
    version = lambda a, b, c, pre: F.concat(a.cast("string"), F.lit("."), b.cast("string"), F.lit("."), c.cast("string"), pre)
    one = version(k % 2, k % 3, k % 4, F.when(k % 5 == 0, F.concat(F.lit("-rc."), (k % 7).cast("string"))).otherwise(F.lit("")))
    two = version(F.col("o_custkey") % 2, F.col("o_custkey") % 3, F.lit(1), F.when(F.col("o_custkey") % 3 == 0, F.lit("-rc.3")).otherwise(F.lit("")))
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", fn.human_size(size).alias("size"), fn.friendly_age(k * k).alias("age"), F.unix_timestamp(fn.iso_utc(F.when(k % 5 == 0, F.lit("2024-02-30T00:00:00Z")).otherwise(date))).alias("at"),
        fn.semver_compare(F.when(k % 11 == 0, F.lit("1.x")).otherwise(F.concat(F.when(k % 2 == 0, "v").otherwise(""), one)), two).alias("order"),
    )


def reexported_members(spark, sf_dir):
    """Suppliers' parts as members; each supplier re-exports what its nation's first supplier has."""
    supplier = _t(spark, sf_dir, "supplier")
    surface = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("member")).distinct()
    first = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("target"))
    reexports = supplier.join(first, "s_nationkey").where("target <> s_suppkey").select(F.col("s_suppkey").alias("package"), "target")
    return references.expand_reexports(surface, reexports)


def deployment_places(spark, sf_dir):
    """Findings in the order of places, numbered."""
    return places.numbered(findings(spark, sf_dir), report.place_order()).select("place", "file", "line", "id")


def plan_places(spark, sf_dir):
    """Critical and high findings in the order of a rewriting plan, numbered; lines are whole, so each place is one finding's."""
    return places.numbered(report.at_least(findings(spark, sf_dir), "high"), report.plan_order()).select("place", "severity", "file", "line")


def test_paths(spark, sf_dir):
    """Customers as files: which paths are tests."""
    k = F.col("c_custkey")
    path = F.when(k % 5 == 0, "src/a.test.ts").when(k % 5 == 1, "pkg/tests/x.py").when(k % 5 == 2, "test_x.py").when(k % 5 == 3, "src/contest.py").otherwise("lib/x_test.py")
    own = _t(spark, sf_dir, "customer").select(k, F.concat(F.when(k % 2 == 0, "deep/").otherwise(""), path).alias("path"))
    return own.select("c_custkey", "path", detect.is_test_path(F.col("path")).alias("is_test"))


QUERIES = {f.__name__: f for f in (name_functions, time_functions, reexported_members, deployment_places, plan_places, test_paths)}


def _case(values: tuple, found: dict | None = None) -> str:
    """SQL of _pick(), or of what is found in place of a value; None there is null."""
    quoted = lambda v: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    texts = [(found or {}).get(v, v) for v in values]
    parts = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"replace(replace({quoted(v)}, '{{k}}', CAST(p_partkey AS VARCHAR)), '{{n}}', p_name)") for i, v in enumerate(texts))
    return f"CASE p_partkey % {len(values)} {parts} END"


_SPLIT = {"@s/p{k}/sub/x": ("@s/p{k}", "sub/x"), "p{k}/lib": ("p{k}", "lib"), "./p{k}": (".", "p{k}")}
_VALUE = _case(_VALUES)
_PRE = "CASE WHEN {0} THEN {1} ELSE 1000 END"
_RANK = "CASE severity WHEN 'critical' THEN 4 ELSE 3 END"
ORACLE_SQL = {
    "name_functions": f"""SELECT p_partkey, {_case(_SPECS, {k: v[0] for k, v in _SPLIT.items()})} AS package, {_case(_SPECS, {s: _SPLIT.get(s, (0, None))[1] for s in _SPECS})} AS subpath,
      {_case(_LITERALS, {v: None if v in ('f"{n}"', '{n}') else '{n}' for v in _LITERALS})} AS literal, {_case(_COMMENTS, {v: '{n}' for v in _COMMENTS})} AS comment, p_partkey % 6 IN (0, 1) AS is_token,
      CASE WHEN regexp_full_match({_VALUE}, '[A-Za-z0-9_./:@%+-]*') THEN {_VALUE} ELSE '"' || replace(replace(replace({_VALUE}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"' END AS value,
      {_case(_CODES, {'missing': 'does not exist', 'near-name': 'name close to a popular package', 'pypi': 'PyPI'})} AS label, 'a/' || p_brand || '/b' AS path, '@s%2f' || replace(p_name, ' ', '%20') AS encoded FROM part""",
    "time_functions": f"""WITH o AS (SELECT *, (o_orderkey * o_orderkey * 2 + 1) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 333 ELSE 77777 END AS z, o_orderkey * o_orderkey AS s,
       [o_orderkey % 2, o_orderkey % 3, o_orderkey % 4, {_PRE.format('o_orderkey % 5 = 0', 'o_orderkey % 7')}] AS a, [o_custkey % 2, o_custkey % 3, 1, {_PRE.format('o_custkey % 3 = 0', '3')}] AS b FROM orders)
      SELECT o_orderkey, CASE WHEN z < 1024 THEN z || ' B' WHEN z < 1048576 THEN printf('%.1f KiB', z / 1024) WHEN z < 1073741824 THEN printf('%.1f MiB', z / 1048576) ELSE printf('%.1f GiB', z / 1073741824) END AS size,
      CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age,
      CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS at, CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS INTEGER) AS "order" FROM o""",
    "reexported_members": "WITH s AS (SELECT DISTINCT l_suppkey AS package, l_partkey AS member FROM lineitem), f AS (SELECT s_nationkey, min(s_suppkey) AS target FROM supplier GROUP BY s_nationkey) SELECT package, member FROM s UNION SELECT s_suppkey, member FROM supplier JOIN f USING (s_nationkey) JOIN s ON s.package = target WHERE target <> s_suppkey",
    "deployment_places": f"WITH {_F} SELECT row_number() OVER (ORDER BY file, line NULLS FIRST, id, message) AS place, file, line, id FROM f",
    "plan_places": f"WITH {_F} SELECT row_number() OVER (ORDER BY {_RANK} DESC, file, line NULLS FIRST) AS place, severity, file, line FROM f WHERE severity IN ('critical', 'high')",
    "test_paths": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'deep/' ELSE '' END || ['src/a.test.ts', 'pkg/tests/x.py', 'test_x.py', 'src/contest.py', 'lib/x_test.py'][CAST(c_custkey % 5 + 1 AS INTEGER)] AS path, c_custkey % 5 <> 3 AS is_test FROM customer",
}
