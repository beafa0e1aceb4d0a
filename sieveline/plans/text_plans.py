"""Queries over the lines and words of documents, pages, conversations and the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import text as fn
from sieveline.operators import lines, similarity
from sieveline.operators.staging import dealt, small_or_shuffled, spread


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def secret_assignments(spark, sf_dir):
    found = lines.assignments(_docs(spark, sf_dir), "doc_id")
    return found.select("doc_id", "line", "name", "value", fn.env_key(F.col("name")).alias("env_key"), F.col("name").rlike(fn.SECRET_NAME).alias("secret_name"))


def secret_masked(spark, sf_dir):
    found = lines.assignments(_docs(spark, sf_dir), "doc_id").where(F.col("name").rlike(fn.SECRET_NAME))
    return found.select("doc_id", "line", fn.mask_secret(F.col("value")).alias("masked"))


def entropy_tokens(spark, sf_dir):
    found = lines.assignments(_docs(spark, sf_dir), "doc_id")
    return found.select("doc_id", "line", F.round(fn.entropy(F.col("value")), 6).alias("bits"), fn.opaque_value(F.col("name"), F.col("value")).alias("opaque"))


def env_key_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fn.env_key(F.col("c_name")).alias("env_key"), fn.env_key(F.col("c_mktsegment")).alias("segment_key"))


def var_name_dedupe(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_custkey")
    return lines.numbered_keys(rows, F.concat(fn.env_key(F.col("o_orderpriority")), F.lit("_C"), F.col("o_custkey").cast("string")), ["o_orderkey"]).select("o_orderkey", "key")


def todo_or_license_lines(spark, sf_dir):
    found = lines.lines(_docs(spark, sf_dir), "doc_id").where(fn.is_license(F.col("value")) | F.col("value").rlike(r"(?i)\b(TODO|FIXME|HACK|XXX)\b"))
    return found.select("doc_id", "line", F.trim("value").alias("value"))


def comment_runs(spark, sf_dir):
    """Runs of neighbouring lines that are short, as comments would be."""
    rows = lines.lines(_docs(spark, sf_dir), "doc_id").select("doc_id", "line", F.when(F.length("value") < 60, "short").otherwise("long").alias("kind"))
    return lines.runs(rows, "doc_id", "line", "kind").where("n >= 3 and kind = 'short'")


def turn_runs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    return lines.runs(rows, "conv_id", "turn", "role")


def diff_hunk_ranges(spark, sf_dir):
    """Line items as a unified diff by order: a header of a part's file, then hunks. Orders are dealt out once, for the items and for their diff."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = dealt(rows, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").cast("int").alias("q"))
    no = F.col("l_linenumber") * 2
    header = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("+++ b/p"), F.col("l_partkey").cast("string"), F.lit(".py")))
    count = F.when(F.col("q") % 3 == 0, "").otherwise(F.concat(F.lit(","), (F.col("q") % 5).cast("string")))
    hunk = F.concat(F.lit("@@ -1 +"), F.col("l_suppkey").cast("string"), count, F.lit(" @@"))
    diff = items.select("l_orderkey", F.inline(F.array(F.struct(no.alias("no"), header.alias("value")), F.struct((no + 1).alias("no"), hunk.alias("value")))))
    return lines.diff_ranges(diff.where("value is not null"), "l_orderkey").where("path is not null")


def token_shingles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", F.explode(similarity.shingles(similarity.word_array(F.col("text")))).alias("shingle"))


def _sketches(spark, sf_dir):
    words = spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.array_join(similarity.word_array(F.col("text")), " ").alias("words"))
    return similarity.sketched(words, "words").where(F.size("hashes") > 0)


def minhash_sketch(spark, sf_dir):
    return _sketches(spark, sf_dir).select("doc_id", F.size("hashes").cast("long").alias("n"), F.array_join("sketch", ",").alias("sketch"))


def lsh_candidates(spark, sf_dir):
    return similarity.bucket_sizes(_sketches(spark, sf_dir), "doc_id").where("n > 1").select("hash", "n", (F.col("n") <= similarity.BUCKET).alias("proposes"))


def near_duplicate_docs(spark, sf_dir):
    pairs = similarity.duplicate_pairs(_sketches(spark, sf_dir), "doc_id")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def benchmark_contamination(spark, sf_dir):
    """By document and benchmark item: shared shingles, and the share of the item that the document holds."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", similarity.shingles(similarity.word_array(F.col("text"))).alias("h"))
    asked = small_or_shuffled(items.select("item_id", F.size("h").alias("of"), F.explode("h").alias("shingle")))
    held = spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.explode(similarity.shingles(similarity.word_array(F.col("text")))).alias("shingle"))
    both = held.join(asked, "shingle").groupBy("doc_id", "item_id", "of").agg(F.count("*").alias("n"))
    return both.select("doc_id", "item_id", "n", F.round(F.col("n") / F.col("of"), 6).alias("share"))


def html_text_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = {"inline-script": r"(?i)<script\b", "inline-style": r"(?i)<style\b", "comment": r"<!--", "relative-link": r'href="/'}
    hits = F.filter(F.array(*(F.when(F.col("html").rlike(r), name) for name, r in rules.items())), lambda x: x.isNotNull())
    return pages.select("page_id", F.explode(hits).alias("rule"))


def url_dsn_classify(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", fn.url_kind(F.col("url")).alias("kind"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.contains("url", F.lit("?")).alias("has_query"))


def model_string_check(spark, sf_dir):
    """Order priorities as model ids: their shape, and whether a known family starts them."""
    families = ["1-urg", "2-", "gpt"]
    value = F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("-")))
    known = F.exists(F.array(*map(F.lit, families)), lambda f: F.startswith(value, f))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", value.alias("value"), (fn.model_shape(value) & ~known).alias("unknown"))


def line_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fn.line_count(F.col("text")).alias("lines"))


QUERIES = {
    f.__name__: f
    for f in (
        secret_assignments, secret_masked, entropy_tokens, env_key_names, var_name_dedupe, todo_or_license_lines, comment_runs, turn_runs, diff_hunk_ranges, token_shingles,
        minhash_sketch, lsh_candidates, near_duplicate_docs, benchmark_contamination, html_text_rules, url_dsn_classify, model_string_check, line_counts,
    )
}
_L = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), lines AS (SELECT doc_id, CAST(n AS INTEGER) AS line, value FROM l)"
_RE = """([A-Za-z_][A-Za-z0-9_]*)\\s*[=:]\\s*"([^"]+)\""""
_A = f"a AS (SELECT doc_id, line, unnest(regexp_extract_all(value, '{_RE}', 1)) AS name, unnest(regexp_extract_all(value, '{_RE}', 2)) AS value FROM lines WHERE contains(value, '\"'))"


def _env(x: str) -> str:
    return f"(SELECT CASE WHEN k = '' THEN 'SECRET' WHEN regexp_matches(k, '^[0-9]') THEN '_' || k ELSE k END FROM (SELECT upper(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS k))"


def _sh(table: str, key: str) -> str:
    words = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"SELECT {key}, list_distinct(list_transform(range(1, len(w) - 3), lambda i: substr(sha256(array_to_string(w[i:i+4], ' ')), 1, 16))) AS h FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) >= 5"


_ENTROPY = "round(list_aggregate(list_transform(list_distinct(c), lambda x: -(len(list_filter(c, lambda y: y = x)) / len(c)) * log2(len(list_filter(c, lambda y: y = x)) / len(c))), 'sum'), 6)"
_SECRET = "regexp_matches(name, '(?i)(secret|token|passw|api_?key|auth|credential|private)')"
_S = f"s AS (SELECT doc_id, h, list_slice(list_sort(h), 1, 4) AS k FROM ({_sh('documents', 'doc_id')}))"
ORACLE_SQL = {
    "secret_assignments": f"WITH {_L}, {_A} SELECT doc_id, line, name, value, {_env('name')} AS env_key, {_SECRET} AS secret_name FROM a",
    "secret_masked": f"WITH {_L}, {_A} SELECT doc_id, line, CASE WHEN regexp_matches(value, '^[a-z][a-z0-9+.\\-]*://[^/:@]*:[^@]*@') THEN regexp_replace(value, '(://[^:/@]*:)[^@]*@', '\\1…@', 'g') WHEN length(value) < 12 THEN '…' ELSE regexp_extract(value, '^((?:[A-Za-z]+[_\\-]){{0,3}})', 1) || '…' || right(value, 4) END AS masked FROM a WHERE {_SECRET}",
    "entropy_tokens": f"WITH {_L}, {_A}, e AS (SELECT *, x.b AS bits FROM a, LATERAL (SELECT {_ENTROPY} AS b FROM (SELECT regexp_extract_all(value, '(?s).') AS c)) x) SELECT doc_id, line, bits, {_SECRET} AND length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '://|[\\s/\\\\]|\\.[A-Za-z]{{2,4}}$|^[a-z]+(-[a-z]+)+$') AND bits >= 3.5 AS opaque FROM e",
    "env_key_names": f"SELECT c_custkey, {_env('c_name')} AS env_key, {_env('c_mktsegment')} AS segment_key FROM customer",
    "var_name_dedupe": f"WITH b AS (SELECT o_orderkey, {_env('o_orderpriority')} || '_C' || o_custkey AS base FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS n FROM b) SELECT o_orderkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS key FROM n",
    "todo_or_license_lines": f"WITH {_L} SELECT doc_id, line, trim(value) AS value FROM lines WHERE regexp_matches(value, '(?i)copyright|licen[sc]e|spdx') OR regexp_matches(value, '(?i)\\b(TODO|FIXME|HACK|XXX)\\b')",
    "comment_runs": f"WITH {_L}, k AS (SELECT doc_id, line, CASE WHEN length(value) < 60 THEN 'short' ELSE 'long' END AS kind FROM lines), g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, kind ORDER BY line) AS island FROM k) SELECT doc_id, kind, min(line) AS first, max(line) AS last, count(*) AS n FROM g GROUP BY doc_id, kind, island HAVING count(*) >= 3 AND kind = 'short'",
    "turn_runs": "WITH g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations) SELECT conv_id, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM g GROUP BY conv_id, role, island",
    "diff_hunk_ranges": """WITH i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, CAST(trunc(min(l_quantity)) AS INTEGER) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
      d AS (SELECT DISTINCT l_orderkey, l_linenumber * 2 AS no, '+++ b/p' || l_partkey || '.py' AS value FROM i WHERE l_linenumber % 2 = 1
            UNION SELECT l_orderkey, l_linenumber * 2 + 1, '@@ -1 +' || l_suppkey || CASE WHEN q % 3 = 0 THEN '' ELSE ',' || (q % 5) END || ' @@' FROM i),
      p AS (SELECT *, last_value(CASE WHEN starts_with(value, '+++ b/') THEN substr(value, 7) END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY no RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM d),
      h AS (SELECT l_orderkey, path, CAST(regexp_extract(value, '\\+(\\d+)', 1) AS INTEGER) AS start, CASE WHEN regexp_matches(value, '\\+\\d+,\\d+') THEN CAST(regexp_extract(value, '\\+\\d+,(\\d+)', 1) AS INTEGER) ELSE 1 END AS n FROM p WHERE starts_with(value, '@@'))
      SELECT l_orderkey, path, start, start + n - 1 AS "end" FROM h WHERE n > 0 AND path IS NOT NULL""",
    "token_shingles": f"SELECT item_id, unnest(h) AS shingle FROM ({_sh('benchmark', 'item_id')})",
    "minhash_sketch": f"WITH {_S} SELECT doc_id, len(h) AS n, array_to_string(k, ',') AS sketch FROM s",
    "lsh_candidates": f"WITH {_S} SELECT hash, count(*) AS n, count(*) <= 64 AS proposes FROM (SELECT unnest(k) AS hash FROM s) GROUP BY hash HAVING count(*) > 1",
    "near_duplicate_docs": f"WITH {_S}, m AS (SELECT doc_id, unnest(k) AS hash FROM s), b AS (SELECT hash FROM m GROUP BY hash HAVING count(*) BETWEEN 2 AND 64), p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM m x JOIN b USING (hash) JOIN m y USING (hash) WHERE x.doc_id < y.doc_id), j AS (SELECT p.a, p.b, len(list_intersect(x.h, y.h)) AS n, len(x.h) + len(y.h) AS t FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b) SELECT a, b, round(n / (t - n), 6) AS similarity FROM j WHERE n / (t - n) >= 0.85",
    "benchmark_contamination": f"WITH d AS (SELECT doc_id, unnest(h) AS x FROM ({_sh('documents', 'doc_id')})), i AS (SELECT item_id, len(h) AS o, unnest(h) AS x FROM ({_sh('benchmark', 'item_id')})) SELECT doc_id, item_id, count(*) AS n, round(count(*) / o, 6) AS share FROM d JOIN i USING (x) GROUP BY doc_id, item_id, o",
    "html_text_rules": "SELECT page_id, unnest(list_filter([CASE WHEN regexp_matches(html, '(?i)<script\\b') THEN 'inline-script' END, CASE WHEN regexp_matches(html, '(?i)<style\\b') THEN 'inline-style' END, CASE WHEN contains(html, '<!--') THEN 'comment' END, CASE WHEN contains(html, 'href=\"/') THEN 'relative-link' END], lambda x: x IS NOT NULL)) AS rule FROM pages",
    "url_dsn_classify": "SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) IN ('http', 'https') THEN 'http' WHEN regexp_matches(url, '^(postgres|postgresql|mysql|mongodb|redis|rediss|amqp|amqps)://') THEN 'dsn' WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN 'url' END AS kind, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, contains(url, '?') AS has_query FROM pages",
    "model_string_check": "WITH v AS (SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '-')) AS value FROM orders) SELECT o_orderkey, value, regexp_matches(value, '^[a-z0-9.:\\-]+$') AND regexp_matches(value, '[-0-9]') AND NOT (starts_with(value, '1-urg') OR starts_with(value, '2-') OR starts_with(value, 'gpt')) AS \"unknown\" FROM v",
    "line_counts": "SELECT doc_id, CAST(greatest(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))), 1) AS INTEGER) AS lines FROM documents",
}
