"""Tokens that name findings across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import TOKEN, content_digest


def assign_tokens(df: DataFrame) -> DataFrame:
    """df with `fingerprint`: a digest of the content, with its place among equals by line and column if there are several.

    Equal seeds have equal digests, so the window needs the digest alone as its key.
    """
    hashed = df.withColumn("digest", content_digest(F.col("id"), F.col("file"), F.col("seed_kind"), F.col("seed_text")))
    same = Window.partitionBy("digest")
    place = F.row_number().over(same.orderBy(F.asc_nulls_first("line"), F.asc_nulls_first("column"))) - 1
    several = F.count("*").over(same) > 1
    token = F.concat(F.lit(f"{TOKEN}:"), F.col("digest"), F.when(several, F.concat(F.lit("#"), place.cast("string"))).otherwise(F.lit("")))
    return hashed.withColumn("fingerprint", token).drop("digest")

