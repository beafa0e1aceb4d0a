"""Queries over versions of trees and caches, with orders and events as their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import extraction, snapshots
from sieveline.operators.staging import shared_folder
from sieveline.operators.store import SnapshotStore


def _tree(spark, sf_dir, left_out: int, changed: int):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") % 10 != left_out)
    version = F.when(F.col("o_orderkey") % 7 == 0, changed).otherwise(0)
    return orders.select(F.col("o_orderkey").cast("string").alias("path"), F.md5(F.concat_ws("|", "o_orderstatus", version.cast("string"))).alias("hash"))


def snapshot_diff(spark, sf_dir):
    return snapshots.tree_diff(_tree(spark, sf_dir, 0, 0), _tree(spark, sf_dir, 1, 1))


def _days(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.dayofmonth("ts").alias("id"), F.col("user_id").cast("string").alias("path")).agg(F.max("event_type").alias("hash"))


def snapshot_list_prev_diff(spark, sf_dir):
    return snapshots.list_with_changes(_days(spark, sf_dir))


def retention_prune(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("namespace"), F.col("o_orderkey").alias("id"))
    return snapshots.prune(rows, 20)


def next_snapshot_id(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").agg((F.max("o_orderkey") + 1).alias("next_id"))


def _cache(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("ecosystem"), F.col("user_id").cast("string").alias("name"), (F.col("event_id") % 2).cast("int").alias("exists_flag"), F.col("event_id").alias("fetched_at"))


def cache_newest_wins(spark, sf_dir):
    return snapshots.newest(_cache(spark, sf_dir), ["ecosystem", "name"], "fetched_at")


def cache_upsert(spark, sf_dir):
    fresh = _cache(spark, sf_dir).select("ecosystem", "name", F.when(F.col("fetched_at") % 4 > 0, 1 - F.col("exists_flag")).alias("exists_flag"), (F.col("fetched_at") + 100).alias("fetched_at"))
    return snapshots.upsert(_cache(spark, sf_dir), fresh, 9000)


def cache_ttl_lookup(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("click").alias("ecosystem"), F.col("c_custkey").cast("string").alias("name"))
    newest = snapshots.newest(_cache(spark, sf_dir), ["ecosystem", "name"], "fetched_at")
    return snapshots.lookup(names, newest, 10_000, 4000).select("name", "existence")


def _folders(spark, sf_dir, left_out: int, changed: int):
    """Orders as files below folders of customers; some customers' orders change or go."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where((key % 10 != left_out) | (customer % 9 > 0))
    path = F.concat_ws("/", (customer % 13).cast("string"), customer.cast("string"), key.cast("string"))
    return orders.select(path.alias("path"), F.md5(F.concat_ws("|", "o_orderstatus", F.when((key % 7 == 0) & (customer % 11 == 0), changed).otherwise(0).cast("string"))).alias("hash"))


def _stored(spark, sf_dir) -> SnapshotStore:
    store = SnapshotStore(spark, shared_folder(spark, "store"))
    for ts, tree in enumerate((_folders(spark, sf_dir, 0, 0), _folders(spark, sf_dir, 1, 1), _folders(spark, sf_dir, 1, 1))):
        store.save(tree, ts=ts)
    return store


def store_diff(spark, sf_dir):
    """Two stored snapshots compared from their tops down."""
    return _stored(spark, sf_dir).diff(1, 2)


def store_list(spark, sf_dir):
    """Stored snapshots with their changes; the third tree is the second one again."""
    return _stored(spark, sf_dir).listed().select("id", "ts", "n_files", "added", "deleted", "modified")


def store_tree(spark, sf_dir):
    return _stored(spark, sf_dir).tree(2)


def incremental_lines(spark, sf_dir):
    """License and token lines of documents, after a run over an earlier version of them, of which one in a hundred was otherwise; fresh: worked on now."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    before = docs.withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.lit(" before"))).otherwise(F.col("text")))
    lines = lambda files: files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value")).where(F.col("value").rlike('License|token = "[0-9a-f]{40}"'))
    cache = extraction.ExtractionCache(spark, shared_folder(spark, "extracted"), extraction.version_of("lines", 1))
    key = extraction.digest_of(F.col("lang"), F.col("text"))
    cache.extract(before, key, lines, "doc_id")
    now = cache.extract(docs, key, lines, "doc_id")
    fresh = docs.select("doc_id", key.alias("key")).join(now.fresh.withColumn("fresh", F.lit(True)), "key", "left").select("doc_id", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    return now.rows.join(fresh, "doc_id").select("doc_id", "line", "value", "fresh")


QUERIES = {f.__name__: f for f in (store_diff, store_list, store_tree, incremental_lines, snapshot_diff, snapshot_list_prev_diff, retention_prune, next_snapshot_id, cache_newest_wins, cache_upsert, cache_ttl_lookup)}
_C = "c AS (SELECT event_type AS ecosystem, CAST(user_id AS VARCHAR) AS name, CAST(event_id % 2 AS INTEGER) AS exists_flag, event_id AS fetched_at FROM events)"
_NEW = "SELECT ecosystem, name, fetched_at, exists_flag FROM {0} QUALIFY row_number() OVER (PARTITION BY ecosystem, name ORDER BY fetched_at DESC, exists_flag DESC) = 1"
_SIDE = "SELECT CAST(o_orderkey AS VARCHAR) AS path, md5(o_orderstatus || '|' || CASE WHEN o_orderkey % 7 = 0 THEN {1} ELSE 0 END) AS hash FROM orders WHERE o_orderkey % 10 <> {0}"
_STATUS = "CASE WHEN a.hash IS NULL THEN 'A' WHEN b.hash IS NULL THEN 'D' WHEN a.hash <> b.hash THEN 'M' END"
_PATH = "o_custkey % 13 || '/' || o_custkey || '/' || o_orderkey"
_FILES = "SELECT " + _PATH + " AS path, md5(o_orderstatus || '|' || CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 11 = 0 THEN {1} ELSE 0 END) AS hash FROM orders WHERE o_orderkey % 10 <> {0} OR o_custkey % 9 > 0"
_STORED = f"SELECT coalesce(a.path, b.path) AS path, {_STATUS} AS status FROM ({_FILES.format(0, 0)}) a FULL OUTER JOIN ({_FILES.format(1, 1)}) b ON a.path = b.path WHERE status IS NOT NULL"
ORACLE_SQL = {
    "store_diff": _STORED,
    "store_list": f"""WITH d AS ({_STORED}), n AS (SELECT (SELECT count(*) FROM ({_FILES.format(0, 0)})) AS a, (SELECT count(*) FROM ({_FILES.format(1, 1)})) AS b)
      SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS ts, a AS n_files, a AS added, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS modified FROM n
      UNION ALL SELECT 2, 1, b, (SELECT count(*) FROM d WHERE status = 'A'), (SELECT count(*) FROM d WHERE status = 'D'), (SELECT count(*) FROM d WHERE status = 'M') FROM n""",
    "store_tree": _FILES.format(1, 1),
    "incremental_lines": """WITH b AS (SELECT lang, CASE WHEN doc_id % 100 = 0 THEN text || ' before' ELSE text END AS text FROM documents),
      f AS (SELECT doc_id, text, NOT EXISTS (SELECT 1 FROM b WHERE b.lang = d.lang AND b.text = d.text) AS fresh FROM documents d),
      l AS (SELECT doc_id, fresh, string_split(text, chr(10)) AS v FROM f), u AS (SELECT doc_id, fresh, v, unnest(range(1, len(v) + 1)) AS i FROM l)
      SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, v[i] AS value, fresh FROM u WHERE regexp_matches(v[i], 'License|token = "[0-9a-f]{40}"')""",
    "snapshot_diff": f"SELECT coalesce(a.path, b.path) AS path, {_STATUS} AS status FROM ({_SIDE.format(0, 0)}) a FULL OUTER JOIN ({_SIDE.format(1, 1)}) b ON a.path = b.path WHERE status IS NOT NULL",
    "snapshot_list_prev_diff": f"""WITH d AS (SELECT CAST(day(ts) AS INTEGER) AS id, CAST(user_id AS VARCHAR) AS path, max(event_type) AS hash FROM events GROUP BY ALL),
      i AS (SELECT id, lag(id) OVER (ORDER BY id) AS previous FROM (SELECT DISTINCT id FROM d)),
      o AS (SELECT i.id, d.path, d.hash FROM i JOIN d ON d.id = i.previous), n AS (SELECT i.id, d.path, d.hash FROM i JOIN d ON d.id = i.id),
      s AS (SELECT coalesce(a.id, b.id) AS id, {_STATUS} AS status FROM o a FULL OUTER JOIN n b ON a.id = b.id AND a.path = b.path)
      SELECT id, count(*) FILTER (status = 'A') AS added, count(*) FILTER (status = 'D') AS deleted, count(*) FILTER (status = 'M') AS modified FROM s GROUP BY id""",
    "retention_prune": "SELECT o_orderpriority AS namespace, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) <= 20 AS kept FROM orders",
    "next_snapshot_id": "SELECT max(o_orderkey) + 1 AS next_id FROM orders",
    "cache_newest_wins": f"WITH {_C} {_NEW.format('c')}",
    "cache_upsert": f"WITH {_C}, u AS (SELECT * FROM c UNION ALL SELECT ecosystem, name, CASE WHEN fetched_at % 4 > 0 THEN 1 - exists_flag END, fetched_at + 100 FROM c WHERE fetched_at % 4 > 0 AND fetched_at + 100 <= 9000) {_NEW.format('u')}",
    "cache_ttl_lookup": f"WITH {_C}, n AS ({_NEW.format('c')}) SELECT CAST(c_custkey AS VARCHAR) AS name, CASE WHEN 10000 - fetched_at <= 4000 AND exists_flag = 1 THEN 'exists' WHEN 10000 - fetched_at <= 4000 AND exists_flag = 0 THEN 'missing' ELSE 'inconclusive' END AS existence FROM customer LEFT JOIN n ON n.ecosystem = 'click' AND n.name = CAST(c_custkey AS VARCHAR)",
}
