"""Findings against a baseline, against another command's findings, and against suppressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import valid_token
from sieveline.operators.blooms import anti_join, semi_join


def kept(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return anti_join(findings, baseline, ["fingerprint"])


def suppressed(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return semi_join(findings, baseline, ["fingerprint"])


def stale(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline tokens that no finding has any more."""
    return anti_join(baseline.select("fingerprint").distinct(), findings, ["fingerprint"])


def without_twins(findings: DataFrame, other: DataFrame) -> DataFrame:
    """findings without those at a place of the other's; a missing line equals a missing line."""
    places = other.select(F.col("file").alias("f"), F.col("line").alias("l")).distinct()
    return findings.join(places, (F.col("file") == F.col("f")) & F.col("line").eqNullSafe(F.col("l")), "left_anti")


def suppression_reason(rules: dict[str, str], prefixes: dict[str, str]):
    """A column with the first reason that suppresses a finding: its rule, its path's prefix; null if it stays."""
    found = F.lit(None).cast("string")
    for prefix, reason in reversed(prefixes.items()):
        found = F.when(F.col("file").startswith(prefix), F.lit(reason)).otherwise(found)
    for rule, reason in reversed(rules.items()):
        found = F.when(F.col("id") == rule, F.lit(reason)).otherwise(found)
    return found


def with_reasons(findings: DataFrame, rules: dict[str, str], prefixes: dict[str, str], tokens: DataFrame) -> DataFrame:
    """findings with `reason`: of the rule, the path's prefix, or its token in tokens (fingerprint, reason), the first that holds; null if it stays."""
    own = tokens.groupBy("fingerprint").agg(F.min("reason").alias("token_reason"))
    return findings.join(own, "fingerprint", "left").withColumn("reason", F.coalesce(suppression_reason(rules, prefixes), "token_reason")).drop("token_reason")


def split(findings: DataFrame, mode: str = "none", baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """kept, suppressed and stale of findings under a baseline mode: none, persisted (a file's tokens) or since (tokens of an earlier snapshot, which are never stale)."""
    if mode not in ("none", "persisted", "since"):
        raise ValueError(f"unknown baseline mode {mode}")
    if mode == "none" or baseline is None:
        return {"kept": findings, "suppressed": findings.limit(0), "stale": findings.select("fingerprint").limit(0)}
    return {"kept": kept(findings, baseline), "suppressed": suppressed(findings, baseline), "stale": stale(findings, baseline) if mode == "persisted" else findings.select("fingerprint").limit(0)}


def without_suppressed(plan: DataFrame, tokens: DataFrame) -> DataFrame:
    """Planned rows (fingerprint, ..) but those whose token is suppressed."""
    return plan.join(tokens.select("fingerprint").distinct(), "fingerprint", "left_anti")


#: How a baseline file begins.
HEADER = ("# Tokens of findings that are known, one a line, in order.", "# Lines that begin with # are comments.")


def baseline_lines(findings: DataFrame) -> DataFrame:
    """(no, line) of a baseline file: its header, then the distinct tokens in order."""
    spark = findings.sparkSession
    head = spark.createDataFrame(list(enumerate(HEADER)), "no int, line string").select("no", F.lit("").alias("token"), "line")
    own = findings.select("fingerprint").distinct().select(F.lit(len(HEADER)).alias("no"), F.col("fingerprint").alias("token"), F.col("fingerprint").alias("line"))
    return head.unionByName(own).orderBy("no", "token").select("no", "line")


def read_baseline(spark, path: str) -> DataFrame:
    """Tokens of a baseline file; blank lines and # comments are skipped, any other line that is no token is an error with its number."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("p", "raw"))
    lines = whole.select((F.col("p") + 1).alias("no"), F.trim("raw").alias("line")).where("line <> '' and not startswith(line, '#')")
    wrong = F.raise_error(F.concat(F.lit("line "), F.col("no").cast("string"), F.lit(" is no token: "), F.col("line")))
    return lines.select(F.when(valid_token(F.col("line")), F.col("line")).otherwise(wrong).alias("fingerprint"))


def write_baseline(findings: DataFrame, path: str) -> None:
    """The lines of a baseline as one text file, which is read by people."""
    baseline_lines(findings).select("line").coalesce(1).write.text(path)
