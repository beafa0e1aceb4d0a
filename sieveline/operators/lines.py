"""Operators on the lines of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGNMENT = r'([A-Za-z_][A-Za-z0-9_]*)\s*[=:]\s*"([^"]+)"'


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, value) of every line, from 1."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("p", "value")).select(key, (F.col("p") + 1).alias("line"), "value")


def assignments(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, name, value) of every string assignment of each line."""
    found = lines(files.where(F.contains(F.col(text), F.lit('"'))), key, text)
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(ASSIGNMENT), 1).alias("name"), F.regexp_extract_all("value", F.lit(ASSIGNMENT), 2).alias("text"))
    return found.select(key, "line", F.explode(pairs).alias("p")).select(key, "line", F.col("p.name").alias("name"), F.col("p.text").alias("value"))


def runs(rows: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """Gaps and islands: (by, kind, first, last, n) of neighbouring rows of one kind."""
    w = Window.partitionBy(by).orderBy(order)
    opens = F.when((F.lag(kind).over(w) == F.col(kind)) & (F.lag(order).over(w) == F.col(order) - 1), 0).otherwise(1)
    marked = rows.withColumn("opens", opens).withColumn("island", F.sum("opens").over(w))
    return marked.groupBy(by, kind, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island")


def diff_ranges(diff: DataFrame, by: str) -> DataFrame:
    """(by, path, start, end) of added ranges of a unified diff with lines (by, no, value); headers carry on to their hunks."""
    w = Window.partitionBy(by).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.when(F.col("value").startswith("+++ b/"), F.substring("value", F.lit(7), F.length("value"))), ignorenulls=True).over(w)
    hunk = r"\A@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start, count = F.regexp_extract("value", hunk, 1), F.regexp_extract("value", hunk, 2)
    held = diff.withColumn("path", path).where(F.col("value").rlike(hunk))
    sized = held.select(by, "path", start.cast("int").alias("start"), F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(value, '" + hunk.replace("\\", "\\\\") + "', 2) as int)")).alias("count"))
    return sized.where("count > 0").select(by, "path", "start", (F.col("start") + F.col("count") - 1).alias("end"))


def numbered_keys(rows: DataFrame, base: Column, order: list[str]) -> DataFrame:
    """rows with `key`: the base name, and _2, _3, .. for later ones of the same base in order."""
    w = Window.partitionBy("base").orderBy(*order)
    n = F.row_number().over(w)
    named = rows.withColumn("base", base).withColumn("n", n)
    return named.withColumn("key", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string")))).drop("n")
