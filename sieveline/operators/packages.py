"""Package names against declarations, registries and popular names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.distance import damerau
from sieveline.operators.staging import small_or_shuffled

#: Longest name that is compared, downloads and days below which a package looks suspicious.
LONGEST, FEW_DOWNLOADS, NEW_DAYS = 128, 1000, 90


def resolve(imports: DataFrame, builtins: DataFrame, declared: DataFrame, local: DataFrame) -> DataFrame:
    """imports (name, raw_spec, is_relative) with `resolution`: local, builtin, declared or phantom, the first that holds."""

    def known(df: DataFrame, flag: str) -> DataFrame:
        return df.select("name").distinct().withColumn(flag, F.lit(True))

    joined = imports.join(known(builtins, "b"), "name", "left").join(known(declared, "d"), "name", "left").join(known(local, "l"), "name", "left")
    resolution = (
        F.when(F.col("is_relative"), "local")
        .when(F.col("raw_spec").startswith("node:") | F.col("b"), "builtin")
        .when(F.col("d"), "declared")
        .when(F.col("l"), "local")
        .otherwise("phantom")
    )
    return joined.withColumn("resolution", resolution).drop("b", "d", "l")


def candidates(declared: DataFrame, phantoms: DataFrame) -> DataFrame:
    """(ecosystem, name, is_direct): declared names and phantom imports, each once."""
    both = declared.select("ecosystem", "name", "is_direct").unionByName(phantoms.select("ecosystem", "name", F.lit(False).alias("is_direct")))
    return both.groupBy("ecosystem", "name").agg(F.max("is_direct").alias("is_direct"))


def near_names(names: DataFrame, popular: DataFrame, distance: int = 2) -> DataFrame:
    """(name, nearest, distance): the nearest popular name within the length band, the earliest of equals; see near_names_by."""
    one = lambda df: df.withColumn("ecosystem", F.lit(""))
    return near_names_by(one(names), one(popular), distance).drop("ecosystem")


def near_names_by(names: DataFrame, popular: DataFrame, distance: int = 2) -> DataFrame:
    """(ecosystem, name, nearest, distance): the nearest popular name within the length band, the earliest of equals.

    names: (ecosystem, name); popular: (ecosystem, name, pos). A popular name is not compared. A swap costs plain edit distance two, so
    with distance d all within 2 d plain edits are measured exactly; beyond that the report has nothing to say. Such pairs share one of the
    2 d + 1 segments of the popular name unchanged and at most 2 d places apart (pigeonhole), so names meet by length and segment.
    """
    most = 2 * distance
    parts = most + 1
    asked = names.select("ecosystem", "name").distinct().join(popular.select("ecosystem", "name"), ["ecosystem", "name"], "left_anti").where(F.length("name") <= LONGEST)

    def segment(df: DataFrame) -> DataFrame:
        """df (l) with the parts i of a text of l characters: from `start` on, `size` characters."""
        base, longer = F.floor(F.col("l") / parts).cast("int"), F.col("l") % parts
        cut = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return cut.withColumn("start", F.col("i") * base + F.greatest(F.col("i") - (parts - longer), F.lit(0))).withColumn("size", base + (F.col("i") >= parts - longer).cast("int"))

    known = segment(popular.select("ecosystem", F.col("name").alias("other"), "pos").withColumn("l", F.length("other")))
    theirs = known.select("ecosystem", "other", "pos", "l", "i", F.substring("other", F.col("start") + 1, F.col("size")).alias("piece"))
    n = F.length("name")
    # no more lengths than LONGEST + distance: names of no popular name's length band go before they are cut
    lengths = popular.select("ecosystem", F.length("name").alias("l")).where(F.col("l").between(1, LONGEST + distance)).distinct()
    mine = asked.withColumn("l", F.explode(F.sequence(F.greatest(n - distance, F.lit(1)), n + distance))).join(F.broadcast(lengths), ["ecosystem", "l"])
    mine = segment(mine)
    mine = mine.withColumn("at", F.explode(F.sequence(F.greatest(F.col("start") - most, F.lit(0)), F.greatest(F.col("start") - most, F.lit(0)) + 2 * most)))
    mine = mine.where((F.col("at") <= F.col("start") + most) & (F.col("at") + F.col("size") <= n))
    pieces = mine.select("ecosystem", "name", "l", "i", F.substring("name", F.col("at") + 1, F.col("size")).alias("piece"))
    pairs = pieces.join(small_or_shuffled(theirs), ["ecosystem", "l", "i", "piece"]).select("ecosystem", "name", "other", "pos").distinct()
    close = pairs.where(F.levenshtein("name", "other", most) >= 0).withColumn("distance", damerau("name", "other"))
    return close.groupBy("ecosystem", "name").agg(F.min(F.struct("distance", "pos", "other")).alias("m")).select("ecosystem", "name", F.col("m.other").alias("nearest"), F.col("m.distance").alias("distance"))


def reasons(now: int, distance: int = 2) -> Column:
    """Reasons to suspect a package (downloads, created_at, distance to a popular name): near-name (up to the distance; 0 switches it off), low-downloads, new-package."""
    return F.array_compact(
        F.array(
            F.when(F.col("distance").between(1, distance), "near-name"),
            F.when(F.col("downloads") < FEW_DOWNLOADS, "low-downloads"),
            F.when(F.lit(now) - F.col("created_at") < NEW_DAYS * 86400, "new-package"),
        )
    )


def suspicion(names: DataFrame, near: DataFrame, now: int, distance: int = 2) -> DataFrame:
    """names (name, downloads, created_at) with the reasons to suspect each, if any: near-name, low-downloads, new-package."""
    return names.join(near, "name", "left").withColumn("reasons", reasons(now, distance)).where(F.size("reasons") > 0)


def first_site(verdicts: DataFrame, imports: DataFrame, declared: DataFrame, default: str) -> DataFrame:
    """verdicts (name) with a place: the first import, else the declaring manifest, else the default."""
    site = imports.groupBy("name").agg(F.min(F.struct("seq", "file", "line")).alias("s")).select("name", F.col("s.file").alias("file"), F.col("s.line").alias("line"))
    manifest = declared.groupBy("name").agg(F.min("manifest").alias("manifest"))
    return verdicts.join(site, "name", "left").join(manifest, "name", "left").select(*verdicts.columns, F.coalesce("file", "manifest", F.lit(default)).alias("file"), "line")
