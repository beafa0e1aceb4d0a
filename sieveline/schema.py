"""The findings schema that every detector returns, and the severity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Severities from the worst, with rank and weight in the score.
SEVERITIES = (("critical", 4, 25), ("high", 3, 10), ("medium", 2, 4), ("low", 1, 1), ("info", 0, 0))
#: Confidences with their rank.
CONFIDENCES = (("high", 2), ("medium", 1), ("low", 0))

_TEXT, _INT = T.StringType(), T.IntegerType()
FINDING = T.StructType(
    [T.StructField(n, _TEXT) for n in ("id", "command", "severity", "confidence", "file")]
    + [T.StructField(n, _INT) for n in ("line", "column", "end_line")]
    + [T.StructField(n, _TEXT) for n in ("message", "detail", "suggestion", "remediation")]
    + [T.StructField("fixable", T.BooleanType()), T.StructField("refs", T.ArrayType(_TEXT))]
    + [T.StructField(n, _TEXT) for n in ("seed_kind", "seed_text")]
)


def _lookup(value: Column, pairs: list[tuple[str, int]]) -> Column:
    found = F.lit(None).cast("int")
    for name, n in pairs:
        found = F.when(value == name, n).otherwise(found)
    return found


def severity_rank(severity: str | Column = "severity") -> Column:
    return _lookup(F.col(severity) if isinstance(severity, str) else severity, [(s, r) for s, r, _ in SEVERITIES])


def severity_weight(severity: str | Column = "severity") -> Column:
    return _lookup(F.col(severity) if isinstance(severity, str) else severity, [(s, w) for s, _, w in SEVERITIES])


def confidence_rank(confidence: str = "confidence") -> Column:
    return _lookup(F.col(confidence), list(CONFIDENCES))


def as_findings(df: DataFrame, **columns: Column | str | bool | int | None) -> DataFrame:
    """df as findings: named columns are given, the others null."""

    def value(field: T.StructField) -> Column:
        given = columns.get(field.name)
        column = given if isinstance(given, Column) else F.lit(given)
        return column.cast(field.dataType).alias(field.name)

    return df.select(*(value(f) for f in FINDING.fields))
