"""Extraction that is done once for each content: rows are kept by the digest of what they depend on, and only unseen contents are worked on."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.operators.staging import exists, small_or_shuffled, staged


def digest_of(*parts: Column) -> Column:
    """SHA-256 of columns, told apart by their lengths, so that no two lists of values run together; a null is unlike any text."""
    text = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*text), 256)


def version_of(*parts) -> str:
    """The digest of whatever besides a file's content decides about its rows: a rule pack, options, a format number."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


@dataclass
class Extracted:
    """rows of all files; fresh: (key) of the contents that this run worked on."""

    rows: DataFrame
    fresh: DataFrame


class ExtractionCache:
    """Extracted rows in a folder, by version and content key.

    `keys/version=V/batch=B` lists the contents that batch B has rows of, contents without any rows as well; `rows/version=V/batch=B` holds the
    rows. Rows are written first, and only rows of a batch that lists their key count, so a run that breaks off leaves nothing half known, and
    two runs that add the same content at once both stay right: its first batch counts. Nothing is rewritten; another version starts empty.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    def _at(self, table: str, batch: str = "") -> str:
        return f"{self.folder}/{table}/version={self.version}" + (f"/batch={batch}" if batch else "")

    def known(self) -> DataFrame:
        """(key, batch): contents that have been worked on, with the first batch that lists each."""
        if not exists(self.spark, self._at("keys")):
            return self.spark.createDataFrame([], "key string, batch string")
        own = self.spark.read.schema("key string, batch string").parquet(self._at("keys"))
        return own.groupBy("key").agg(F.min("batch").alias("batch"))

    def extract(self, files: DataFrame, key: Column, run: Callable[[DataFrame], DataFrame], path: str = "path") -> Extracted:
        """The rows that run(files) gives, where contents that were seen in an earlier run, or twice in this one, are worked on once.

        key: a digest of all that the rows of a file depend on but the version; run must give rows with the file's `path` column, of which
        nothing else may depend on what the key leaves out. Paths name files, so each stands once; null paths have no rows. Texts of known
        files are read for their digest but move nowhere.
        """
        kind = files.schema[path].dataType
        slim = staged(files.where(F.col(path).isNotNull()).select(F.col(path).alias("of file"), key.alias("key")))
        new = slim.select("key").distinct().join(small_or_shuffled(self.known().select("key")), "key", "left_anti")
        chosen = staged(slim.join(small_or_shuffled(new), "key", "left_semi").groupBy("key").agg(F.min("of file").alias("of file")))
        few = small_or_shuffled(chosen)
        found = run(files.join(few.select(F.col("of file").alias(path)), path, "left_semi"))
        fields = [f for f in found.schema.fields if f.name != path]
        if not chosen.isEmpty():
            batch = uuid.uuid4().hex
            keyed = found.join(few, F.col(path) == F.col("of file")).select("key", *(F.col(f"`{f.name}`") for f in fields))
            keyed.write.parquet(self._at("rows", batch))
            chosen.select("key").write.parquet(self._at("keys", batch))
        schema = T.StructType([T.StructField("key", T.StringType()), *fields, T.StructField("batch", T.StringType())])
        stored = self.spark.read.schema(schema).parquet(self._at("rows")) if exists(self.spark, self._at("rows")) else self.spark.createDataFrame([], schema)
        rows = stored.join(slim.join(self.known(), "key"), ["key", "batch"])
        order = [F.col("of file").cast(kind).alias(path) if c == path else F.col(f"`{c}`") for c in found.columns]
        return Extracted(rows.select(*order), chosen.select("key"))
