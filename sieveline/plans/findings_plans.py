"""Queries over a findings log: the events table, its type as rule, its user as file, its id as line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import baseline, identity, places, report
from sieveline.schema import severity_rank

SEVERITY_OF = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low"}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("info")
    for event, severity in SEVERITY_OF.items():
        kind = F.when(F.col("event_type") == event, severity).otherwise(kind)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("id"),
        kind.alias("severity"),
        F.col("user_id").cast("string").alias("file"),
        F.col("event_id").alias("line"),
        F.lit(None).cast("int").alias("column"),
        F.col("props").alias("message"),
        (F.col("event_id") % 3 == 0).alias("fixable"),
        F.lit("event").alias("seed_kind"),
        F.col("props").alias("seed_text"),
    )


_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in SEVERITY_OF.items()) + " ELSE 'info' END"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_WEIGHT = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 10 WHEN 'medium' THEN 4 WHEN 'low' THEN 1 ELSE 0 END"
_SCORE = f"CAST(greatest(0, least(100, 100 - sum({_WEIGHT}))) AS INTEGER)"
_F = f"f AS (SELECT event_type AS id, {_CASE} AS severity, CAST(user_id AS VARCHAR) AS file, event_id AS line, props AS message, event_id % 3 = 0 AS fixable FROM events)"
_ORDER = f"{_RANK} DESC, file, line NULLS FIRST, id, message"
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
_TOKENS = f"""t AS (SELECT *, 'gdv1:' || digest || CASE WHEN count(*) OVER (PARTITION BY digest) > 1 THEN '#' || (row_number() OVER (PARTITION BY digest ORDER BY line NULLS FIRST) - 1) ELSE '' END AS fingerprint
  FROM (SELECT *, substr(sha256('gdv1' || chr(0) || id || chr(0) || file || chr(0) || 'event' || chr(0) || rtrim(message)), 1, 32) AS digest FROM f))"""
#: Every fifth event's token, and one that nothing has.
_BASELINE = "b AS (SELECT fingerprint FROM t WHERE line % 5 = 0 UNION ALL SELECT 'gdv1:00')"


def severity_summary(spark, sf_dir):
    return report.summary(findings(spark, sf_dir))


def severity_summary_by_file(spark, sf_dir):
    return report.summary(findings(spark, sf_dir), "file")


def at_or_above(spark, sf_dir):
    return report.at_or_above(findings(spark, sf_dir))


def ship_score_by_file(spark, sf_dir):
    return report.score(findings(spark, sf_dir), "file")


def gate_eval(spark, sf_dir):
    return report.gate(findings(spark, sf_dir), "file")


def per_file_tally(spark, sf_dir):
    return report.tally(findings(spark, sf_dir))


def severity_floor(spark, sf_dir):
    return report.at_least(findings(spark, sf_dir), "high").select("id", "severity", "file", "line")


def findings_total_order_topk(spark, sf_dir):
    return report.top(findings(spark, sf_dir), 50).select("place", "severity", "file", "line", "id", "message")


def findings_places(spark, sf_dir):
    """Every finding with its place in the total order, and in that of its rule."""
    whole = places.numbered(findings(spark, sf_dir), report.order_key())
    return places.numbered(whole, [F.asc("place")], "rule_place", ["id"], first=0).select("line", "place", "id", "rule_place")


def top3_per_file(spark, sf_dir):
    return report.top_by_file(findings(spark, sf_dir), 3).select("file", "place", "severity", "line", "id")


def file_group_order(spark, sf_dir):
    return report.file_order(findings(spark, sf_dir))


def next_actions_top10(spark, sf_dir):
    return report.next_actions(findings(spark, sf_dir), F.concat("id", F.lit(" in "), "file"))


def agent_lines(spark, sf_dir):
    return report.at_least(findings(spark, sf_dir), "medium").select("file", "line", report.agent_line().alias("text"))


def fingerprint_occurrence(spark, sf_dir):
    return identity.assign_tokens(findings(spark, sf_dir)).select("id", "file", "line", "fingerprint")


def _tokens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    tokens = identity.assign_tokens(findings(spark, sf_dir)).select("id", "file", "line", "fingerprint")
    return tokens, tokens.where("line % 5 = 0").select("fingerprint").unionByName(spark.createDataFrame([("gdv1:00",)], "fingerprint string"))


def baseline_kept(spark, sf_dir):
    return baseline.kept(*_tokens(spark, sf_dir)).select("id", "file", "line", "fingerprint")


def baseline_suppressed(spark, sf_dir):
    return baseline.suppressed(*_tokens(spark, sf_dir)).select("id", "file", "line", "fingerprint")


def baseline_stale(spark, sf_dir):
    return baseline.stale(*_tokens(spark, sf_dir))


def cross_command_dedupe(spark, sf_dir):
    own = findings(spark, sf_dir).withColumn("line", F.when(F.col("line") % 7 > 0, F.col("line") % 50))
    return baseline.without_twins(own.where("id <> 'click'"), own.where("id = 'click'")).select("id", "file", "line", "message")


def suppress_reason(spark, sf_dir):
    reason = baseline.suppression_reason({"view": "rule"}, {"1": "prefix", "22": "other"})
    return findings(spark, sf_dir).select("id", "file", "line", reason.alias("reason"))


def rule_fp_rate(spark, sf_dir):
    """By rule: findings of medium or worse, and their rate by files."""
    own = findings(spark, sf_dir)
    files = own.agg(F.countDistinct("file").alias("files"))
    worse = own.groupBy("id").agg(F.count_if(severity_rank() >= 2).alias("n"))
    return worse.crossJoin(F.broadcast(files)).select("id", "n", F.round(F.col("n") / F.col("files"), 6).alias("rate"))  # files is one row


def recall_by_label(spark, sf_dir):
    """By source: documents labelled bad, those of them that a simple rule finds, and the recall."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.col("text").rlike("[#*$%&|<>]{3}").alias("hit"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = docs.join(labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if((F.col("quality") == 0) & F.col("hit")).alias("found"), F.count_if(F.col("hit")).alias("hits"))
    return found.select("source", "bad", "found", "hits", F.when(F.col("bad") > 0, F.round(F.col("found") / F.col("bad"), 6)).alias("recall"))


QUERIES = {
    f.__name__: f
    for f in (
        severity_summary, severity_summary_by_file, at_or_above, ship_score_by_file, gate_eval, per_file_tally, severity_floor, findings_total_order_topk, findings_places, top3_per_file,
        file_group_order, next_actions_top10, agent_lines, fingerprint_occurrence, baseline_kept, baseline_suppressed, baseline_stale, cross_command_dedupe, suppress_reason, rule_fp_rate, recall_by_label,
    )
}
ORACLE_SQL = {
    "severity_summary": f"WITH {_F} SELECT {_COUNTS}, count(*) FILTER (fixable) AS fixable FROM f",
    "severity_summary_by_file": f"WITH {_F} SELECT file, {_COUNTS}, count(*) FILTER (fixable) AS fixable FROM f GROUP BY file",
    "at_or_above": f"WITH {_F} SELECT severity, {_RANK} AS rank, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY {_RANK} DESC) AS BIGINT) AS at_or_above FROM f GROUP BY severity",
    "ship_score_by_file": f"WITH {_F} SELECT file, {_SCORE} AS score FROM f GROUP BY file",
    "gate_eval": f"WITH {_F} SELECT file, max({_RANK}) AS worst_rank, {_SCORE} AS score, max({_RANK}) < 3 AND {_SCORE} >= 50 AS passes FROM f GROUP BY file",
    "per_file_tally": f"WITH {_F} SELECT file, {_COUNTS} FROM f GROUP BY file",
    "severity_floor": f"WITH {_F} SELECT id, severity, file, line FROM f WHERE {_RANK} >= 3",
    "findings_total_order_topk": f"WITH {_F} SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS place, severity, file, line, id, message FROM f QUALIFY place <= 50",
    "findings_places": f"WITH {_F}, p AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place FROM f) SELECT line, place, id, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS rule_place FROM p",
    "top3_per_file": f"WITH {_F} SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY {_ORDER}) AS INTEGER) AS place, severity, line, id FROM f QUALIFY place <= 3",
    "file_group_order": f"WITH {_F}, r AS (SELECT *, {_RANK} AS rank, row_number() OVER (PARTITION BY file ORDER BY {_ORDER}) AS p, count(*) OVER (PARTITION BY file) AS n FROM f) SELECT file, rank AS worst_rank, line AS first_line, id AS first_id, n FROM r WHERE p = 1",
    "next_actions_top10": f"WITH {_F}, r AS (SELECT id || ' in ' || file AS action, row_number() OVER (ORDER BY {_ORDER}) AS p FROM f), a AS (SELECT action, min(p) AS p FROM r GROUP BY action) SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS place, action, greatest(count(*) OVER () - 10, 0) AS more FROM a QUALIFY place <= 10",
    "agent_lines": f"WITH {_F} SELECT file, line, '[' || upper(severity) || '] ' || file || ':' || line || ' ' || id || ' - ' || message AS text FROM f WHERE {_RANK} >= 2",
    "fingerprint_occurrence": f"WITH {_F}, {_TOKENS} SELECT id, file, line, fingerprint FROM t",
    "baseline_kept": f"WITH {_F}, {_TOKENS}, {_BASELINE} SELECT id, file, line, fingerprint FROM t WHERE fingerprint NOT IN (SELECT fingerprint FROM b)",
    "baseline_suppressed": f"WITH {_F}, {_TOKENS}, {_BASELINE} SELECT id, file, line, fingerprint FROM t WHERE fingerprint IN (SELECT fingerprint FROM b)",
    "baseline_stale": f"WITH {_F}, {_TOKENS}, {_BASELINE} SELECT DISTINCT fingerprint FROM b WHERE fingerprint NOT IN (SELECT fingerprint FROM t)",
    "cross_command_dedupe": f"WITH {_F}, g AS (SELECT id, file, CASE WHEN line % 7 > 0 THEN line % 50 END AS line, message FROM f) SELECT id, file, line, message FROM g WHERE id <> 'click' AND NOT EXISTS (SELECT 1 FROM g o WHERE o.id = 'click' AND o.file = g.file AND o.line IS NOT DISTINCT FROM g.line)",
    "suppress_reason": f"WITH {_F} SELECT id, file, line, CASE WHEN id = 'view' THEN 'rule' WHEN starts_with(file, '1') THEN 'prefix' WHEN starts_with(file, '22') THEN 'other' END AS reason FROM f",
    "rule_fp_rate": f"WITH {_F} SELECT id, count(*) FILTER ({_RANK} >= 2) AS n, round(count(*) FILTER ({_RANK} >= 2) / (SELECT count(DISTINCT file) FROM f), 6) AS rate FROM f GROUP BY id",
    "recall_by_label": "WITH h AS (SELECT source, quality, regexp_matches(text, '[#*$%&|<>]{3}') AS hit FROM documents JOIN labels USING (doc_id)) SELECT source, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 0 AND hit) AS found, count(*) FILTER (hit) AS hits, CASE WHEN count(*) FILTER (quality = 0) > 0 THEN round(count(*) FILTER (quality = 0 AND hit) / count(*) FILTER (quality = 0), 6) END AS recall FROM h GROUP BY source",
}
