"""The catalogue of registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as fn
from sieveline.operators import identity, report
from sieveline.plans import code_plans, detect_plans, findings_plans, package_plans, scalar_plans, text_plans, version_plans
from sieveline.schema import SEVERITIES, as_findings

_PARTS = (findings_plans, version_plans, text_plans, package_plans, code_plans, detect_plans, scalar_plans)


def _document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents with their source: written-out tokens and license lines, from one pass over the lines of texts that may hold some."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    may = docs.where(F.col("text").rlike('(?i)token = "|licen[sc]e|copyright|spdx'))
    rows = may.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("p", "value"))
    secret = F.when(F.col("value").rlike('token = "[0-9a-f]{40}"'), F.struct(F.lit("text/token-literal").alias("id"), F.lit("high").alias("severity"), F.lit(True).alias("fixable")))
    license_ = F.when(fn.is_license(F.col("value")), F.struct(F.lit("text/license-line").alias("id"), F.lit("info").alias("severity"), F.lit(False).alias("fixable")))
    return rows.select("doc_id", "source", (F.col("p") + 1).alias("line"), "value", F.explode(F.array_compact(F.array(secret, license_))).alias("hit"))


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents, each with its token."""
    rows = _document_rows(spark, sf_dir)
    secret = F.col("hit.id") == "text/token-literal"
    return identity.assign_tokens(
        as_findings(
            rows, id=F.col("hit.id"), command=F.when(secret, "audit").otherwise("review"), severity=F.col("hit.severity"), confidence=F.when(secret, "high").otherwise("medium"), file=F.concat_ws("/", "source", F.col("doc_id").cast("string")),
            line=F.col("line"), message=F.when(secret, "a token is written out").otherwise("a license is named"), fixable=F.col("hit.fixable"), seed_kind="line", seed_text=F.col("value"),
        )
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: counts of findings by severity, and the score, in one aggregation."""
    found = _document_rows(spark, sf_dir).select("source", F.col("hit.severity").alias("severity"), F.col("hit.fixable").alias("fixable"))
    return found.groupBy("source").agg(*(F.count_if(F.col("severity") == s).alias(s) for s, _, _ in SEVERITIES), F.count_if("fixable").alias("fixable"), report.score_value().alias("score"))


def document_finding_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_findings(spark, sf_dir).select("id", "file", "line", "severity", "fingerprint")


QUERIES = {"document_summary": flagship, "document_finding_tokens": document_finding_tokens} | {k: v for p in _PARTS for k, v in p.QUERIES.items()}
_FOUND = f"""{text_plans._L}, g AS (SELECT 'text/token-literal' AS id, 'high' AS severity, 10 AS weight, true AS fixable, doc_id, line, value FROM lines WHERE regexp_matches(value, 'token = "[0-9a-f]{{40}}"')
 UNION ALL SELECT 'text/license-line', 'info', 0, false, doc_id, line, value FROM lines WHERE regexp_matches(value, '(?i)copyright|licen[sc]e|spdx')),
 d AS (SELECT g.*, source, source || '/' || g.doc_id AS file FROM g JOIN documents USING (doc_id)),
 h AS (SELECT *, substr(sha256('gdv1' || chr(0) || id || chr(0) || file || chr(0) || 'line' || chr(0) || rtrim(value)), 1, 32) AS digest FROM d)"""
ORACLE_SQL = {
    "document_summary": f"WITH {_FOUND} SELECT source, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (fixable) AS fixable, CAST(greatest(0, 100 - sum(weight)) AS INTEGER) AS score FROM d GROUP BY source",
    "document_finding_tokens": f"WITH {_FOUND} SELECT id, file, line, severity, 'gdv1:' || digest || CASE WHEN count(*) OVER (PARTITION BY digest) > 1 THEN '#' || (row_number() OVER (PARTITION BY digest ORDER BY line) - 1) ELSE '' END AS fingerprint FROM h",
} | {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
