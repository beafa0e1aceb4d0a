"""Answers of package registries as rows of the caches. Asking is not the engine's work: responses come as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import iso_utc, normalize_name, percent_scoped

#: Seconds that an answer about existence and one about popularity stay good; attempts, pauses in milliseconds, seconds and bytes of a request.
TTL, META_TTL = 7 * 86400, 86400
ATTEMPTS, PAUSES, TIMEOUT, LARGEST = 3, (200, 400, 800), 5, 2 * 1024 * 1024


def registry_path(ecosystem: Column, name: Column) -> Column:
    """What a registry is asked for: a scoped npm name is encoded, a PyPI name is in its normal form."""
    return F.when(ecosystem == "npm", percent_scoped(name)).otherwise(F.concat(F.lit("pypi/"), normalize_name(name), F.lit("/json")))


def asks_again(status: Column, attempt: Column) -> Column:
    """Whether a response is asked for once more: server errors and missing responses, up to ATTEMPTS."""
    return (status.isNull() | (status >= 500)) & (attempt < ATTEMPTS)


def existence(status: Column) -> Column:
    """exists, missing, or inconclusive: only 404 says that a package is missing."""
    return F.when(status == 200, "exists").when(status == 404, "missing").otherwise("inconclusive")


def existence_rows(responses: DataFrame, now: int) -> DataFrame:
    """(ecosystem, name, exists_flag, fetched_at) of the last attempt of each (ecosystem, name, attempt, status); inconclusive ones give no row."""
    last = responses.groupBy("ecosystem", "name").agg(F.max_by("status", "attempt").alias("status"))
    flag = F.when(F.col("status") == 200, 1).when(F.col("status") == 404, 0)
    return last.select("ecosystem", "name", flag.alias("exists_flag"), F.lit(now).cast("long").alias("fetched_at")).where("exists_flag is not null")


def metadata_rows(bodies: DataFrame, now: int) -> DataFrame:
    """(ecosystem, name, downloads, created_at, fetched_at) of npm bodies (ecosystem, name, downloads_body, time_body) of packages that exist.

    PyPI has neither, so its rows hold nulls; bodies that are too large or no JSON, impossible dates and such from the future give nulls.
    """
    small = lambda c: F.when(F.octet_length(c) <= LARGEST, F.col(c))
    npm = F.col("ecosystem") == "npm"
    downloads = F.get_json_object(small("downloads_body"), "$.downloads").try_cast("long")
    created = F.unix_timestamp(iso_utc(F.get_json_object(small("time_body"), "$.time.created")))
    return bodies.select(
        "ecosystem", "name", F.when(npm & (downloads >= 0), downloads).alias("downloads"), F.when(npm & created.between(0, now), created).alias("created_at"), F.lit(now).cast("long").alias("fetched_at")
    )
