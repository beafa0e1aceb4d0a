"""Queries over source code, with parts as files: each part holds one of the samples below, by its key.

What is expected of each sample is written down by hand, so the SQL shares nothing with the parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as fn
from sieveline.operators import code, detect, rules
from sieveline.operators.staging import spread

#: (suffix, text, expected findings (rule, severity, line, column), expected rows (kind, name, value, line))
SAMPLES: tuple[tuple[str, str, tuple, tuple], ...] = (
    ("js", "import x from 'lib/sub';\nx.go(1);\neval(x.arg);\n", (("audit/eval-user-input", "high", 3, 6),), (("import", "lib", "lib/sub", 1), ("usage", "lib", "go", 2), ("usage", "lib", "arg", 3))),
    ("py", "import os\nkey = os.environ['API_KEY']\nos.system('ls ' + key)\n", (("audit/exec-user-input", "high", 3, 11),), (("import", "os", "os", 1), ("env", "API_KEY", None, 2), ("usage", "os", "environ", 2), ("usage", "os", "system", 3), ("export", "os", None, 1), ("export", "key", None, 2))),
    ("ts", "const VITE_TOKEN: string = 'sk_live_0123456789abcdef';\nexport function f(a: number) { return a; }\n", (("audit/api-key-in-client-bundle", "high", 1, 28),), (("assignment", "VITE_TOKEN", "sk_live_0123456789abcdef", 1), ("export", "f", None, 2))),
    ("js", "app.use(cors({ origin: '*' }));\napp.listen(3000);\n", (("audit/cors-wildcard", "high", 1, 24), ("ship/hardcoded-port", "low", 2, 12)), (("assignment", "origin", "*", 1),)),
    ("py", "from flask import Flask\napp = Flask('x')\napp.run(debug=True, port=80)\n", (("audit/debug-mode-enabled", "medium", 3, 15), ("ship/hardcoded-port", "low", 3, 26)), (("import", "flask", "flask", 1), ("usage", "flask", "Flask", 1), ("export", "Flask", None, 1), ("export", "app", None, 2))),
    ("tsx", "const v = () => <form onSubmit={e => e.target.checkValidity()} />;\nres.cookie('a', v);\n", (("audit/client-only-validation", "medium", 1, 38), ("audit/cookie-insecure", "medium", 2, 17)), ()),
    ("js", "db.query(`select ${id}`);\nchild_process.exec(`ls ${dir}`);\n", (("audit/sql-string-concat", "medium", 1, 18), ("audit/shell-interpolation", "high", 2, 24)), ()),
    ("js", "// TODO later\nconsole.log(1);\nmodule.exports = { createClient };\ncreateClient(url, SERVICE_ROLE);\n", (("review/todo-introduced", "info", 1, 1), ("review/debug-leftover", "medium", 2, 1), ("audit/supabase-permissive-rls", "high", 4, 19)), ()),
    ("js", "router.get('/a', handler);\nrouter.get('/b', guard, handler);\nconst { A, B: c = 1 } = process.env;\n", (("audit/missing-auth-middleware", "info", 1, 18),), (("env", "A", None, 3), ("env", "B", None, 3))),
    ("py", "# a = f(1)\n# if a:\n#     g(a)\nx = 1\n", (), (("export", "x", None, 4),)),
    ("py", "def f(:\n", (), (("error", "ERROR", None, 1),)),
    ("js", "const words = ['eval(x)', 'cors({origin: 1})'];\n", (), ()),
)
FRAMEWORKS = ["express"]
#: Kinds of rows that a query shows.
SHOWN = ("import", "usage", "env", "assignment", "export", "error")


def files(spark, sf_dir) -> DataFrame:
    """Parts as files (path, lang, text)."""
    k = F.col("p_partkey") % len(SAMPLES)
    suffix, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (s, t, _, _) in enumerate(SAMPLES):
        suffix, text = F.when(k == i, s).otherwise(suffix), F.when(k == i, t).otherwise(text)
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit("."), suffix).alias("path"), text.alias("text"))
    return spread(own.withColumn("lang", fn.language_of(F.col("path"))))


def _rows(spark, sf_dir, *kinds):
    return code.extract(files(spark, sf_dir), rules.syntax_rules(rules.shipped(), FRAMEWORKS), kinds)


def code_rule_findings(spark, sf_dir):
    found = code.rule_findings(_rows(spark, sf_dir, "rule"), rules.pack_frame(spark, rules.shipped()))
    return found.select("file", "id", "severity", "line", "column")


def code_relations(spark, sf_dir):
    return _rows(spark, sf_dir).where(F.col("kind").isin(*SHOWN)).select("path", "kind", "name", "value", "line")


def function_counts(spark, sf_dir):
    return code.function_counts(_rows(spark, sf_dir)).select("path", "functions", "has_syntax_errors")


def commented_block_findings(spark, sf_dir):
    blocks = code.commented_code(_rows(spark, sf_dir, "comment"))
    every = files(spark, sf_dir).select("path", F.lit(1).alias("start"), F.lit(9).alias("end"))
    return detect.commented_blocks(blocks, every).select("file", "id", "line", "seed_text")


def whole_file_findings(spark, sf_dir):
    """Orders as rules files of a database, of which every third is open."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, "firestore.rules").otherwise("database.rules.json")
    text = F.when(k % 3 > 0, "allow read: if request.auth != null;").when(k % 2 == 0, "allow read, write : if  true ;").otherwise('{".read" : "true"}')
    own = orders.select(F.concat(F.lit("d"), k.cast("string"), F.lit("/"), name).alias("path"), text.alias("text"))
    return rules.text_findings(rules.whole_file_hits(own, rules.pack_frame(spark, rules.shipped()), [])).select("file", "id", "severity")


def _values(rows: list[tuple]) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_FILES = "f AS (SELECT 'src/p' || p_partkey || '.' || s AS path, k FROM part JOIN (VALUES " + _values([(i, s[0]) for i, s in enumerate(SAMPLES)]) + f") e(k, s) ON p_partkey % {len(SAMPLES)} = k)"
_FOUND = _values([(i, *f) for i, s in enumerate(SAMPLES) for f in s[2]])
_ROWS = _values([(i, *r) for i, s in enumerate(SAMPLES) for r in s[3]])
#: Functions of each sample, by hand.
_COUNTS = _values([(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 2), (6, 0), (7, 0), (8, 0), (9, 0), (11, 0)])
QUERIES = {f.__name__: f for f in (code_rule_findings, code_relations, function_counts, commented_block_findings, whole_file_findings)}
ORACLE_SQL = {
    "code_rule_findings": f"WITH {_FILES} SELECT path AS file, id, severity, CAST(line AS INTEGER) AS line, CAST(c AS INTEGER) AS \"column\" FROM f JOIN (VALUES {_FOUND}) w(k, id, severity, line, c) USING (k)",
    "code_relations": f"WITH {_FILES} SELECT path, kind, name, value, CAST(line AS INTEGER) AS line FROM f JOIN (VALUES {_ROWS}) w(k, kind, name, value, line) USING (k)",
    "function_counts": f"WITH {_FILES} SELECT path, CAST(n AS BIGINT) AS functions, false AS has_syntax_errors FROM f JOIN (VALUES {_COUNTS}) w(k, n) USING (k) UNION ALL SELECT path, 0, true FROM f WHERE k = 10",
    "commented_block_findings": f"WITH {_FILES} SELECT path AS file, 'review/commented-code-block' AS id, CAST(1 AS INTEGER) AS line, ' a = f(1)' || chr(10) || ' if a:' || chr(10) || '     g(a)' AS seed_text FROM f WHERE k = 9",
    "whole_file_findings": "SELECT 'd' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '/firestore.rules' ELSE '/database.rules.json' END AS file, 'audit/firebase-open-rules' AS id, 'critical' AS severity FROM orders WHERE o_orderkey % 3 = 0",
}
