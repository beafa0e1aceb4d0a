"""Free numbered names for many rows at once: what a loop over all rows would give, without one task for the names that can collide.

A base B asks for B, B_2, B_3, .. in turn, and only another base C = B_n can take one of these away. Which of the two has it is a question of
time: C takes its own name with its first row, unless B has come as far as n before. How far B has come follows from how many of its rows are
before and how many smaller numbers it had to pass over. So bases are worked on from the shortest to those that lengthen them; for each
base the numbers that lengthening bases keep are found in rounds, as equi-joins of (base, row number), each of which settles at least the smallest open number of every base,
and in practice all of them at once; then the n-th row gets the n-th number that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.places import numbered
from sieveline.operators.staging import staged

#: Numbers of a base that a window adds up at once.
BLOCK = 4096
_SHAPE = r"\A(.+)_([1-9][0-9]{0,14})\z"


def _parent(name: Column) -> Column:
    """(base, n) of a name that another base could ask for as its n-th, else nulls."""
    n = F.regexp_extract(name, _SHAPE, 2)
    return F.when((n != "") & (n != "1"), F.struct(F.regexp_extract(name, _SHAPE, 1).alias("base"), F.when(n != "", n).cast("long").alias("n")))


def _before(df: DataFrame, value: str, name: str, *ties: str) -> DataFrame:
    """df (base, at, ..) with the sum of value over the rows of the base that come before; blocks of numbers are added up apart."""
    own = df.withColumn("block", F.floor(F.col("at") / BLOCK))
    sums = own.groupBy("base", "block").agg(F.sum(value).alias("in block"))
    past = Window.partitionBy("base").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("base", "block", F.coalesce(F.sum("in block").over(past), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("base", "block").orderBy("at", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return own.join(begins, ["base", "block"]).withColumn(name, F.col("begin") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("block", "begin")


def _kept(children: DataFrame, taken: DataFrame, times: DataFrame) -> DataFrame:
    """children (base, n, first, name) with `keeps`: whether the lengthening base has its own name.

    taken: (base, n) of numbers that are taken from the start; times: (base, index, time) of rows.
    """
    marks = children.select("base", F.col("n").alias("at"), F.lit(0).alias("t"), "first", "name").unionByName(taken.select("base", F.col("n").alias("at"), F.lit(1).alias("t"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("name")))
    ranked = _before(marks, "t", "passed").where("t = 0").select("base", "at", "first", "name", (F.col("at") - F.col("passed")).alias("free"), F.lit(0).alias("kept"))
    ranked = staged(ranked)
    while True:
        asked = _before(ranked, "kept", "lost").withColumn("index", F.col("free") - F.col("lost"))
        judged = asked.join(times, ["base", "index"], "left")
        fresh = staged(judged.select("base", "at", "first", "name", "free", F.when(F.col("time") < F.col("first"), 0).otherwise(1).alias("kept"), F.col("kept").alias("before")))
        ranked = fresh.drop("before")
        if fresh.where("kept <> before").isEmpty():
            return ranked.select("base", F.col("at").alias("n"), "name", (F.col("kept") == 1).alias("keeps"))


def numbers(rows: DataFrame, base: str, order: list[str], taken: list[str] = ()) -> DataFrame:
    """rows with `number`: 1 for the base itself, n for base_n, as if each row in order took the first one after its base's last that is free."""
    spark = rows.sparkSession
    timed = numbered(rows.withColumn("base", F.col(f"`{base}`")), [F.asc(f"`{o}`") for o in order], "time")
    own = staged(numbered(timed, [F.asc("time")], "index", ["base"]))
    bases = staged(own.groupBy("base").agg(F.min("time").alias("first")).withColumn("of", _parent(F.col("base"))))
    names = spark.createDataFrame([(t,) for t in taken], "name string").distinct()
    from_start = staged(names.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("n")).unionByName(names.select(_parent(F.col("name")).alias("of")).where("of is not null").select("of.base", "of.n")))
    parents = bases.select(F.col("base").alias("parent"))
    level = staged(bases.join(parents, F.col("of.base") == F.col("parent"), "left").select("base", F.col("parent").isNull().alias("top"))).where("top").select("base", F.lit(False).alias("lost"))
    out = None
    while not level.isEmpty():
        level = staged(level)
        used = from_start.unionByName(level.where("lost").select("base", F.lit(1).cast("long").alias("n"))).join(level.select("base"), "base", "left_semi").distinct()
        below = bases.where("of is not null").select(F.col("of.base").alias("base"), F.col("of.n").alias("n"), "first", F.col("base").alias("name")).join(level.select("base"), "base", "left_semi")
        open_ = below.join(names, "name", "left_anti")
        here = own.join(level.select("base"), "base", "left_semi")
        kept = _kept(open_, used, here.select("base", "index", "time"))
        gone = used.unionByName(kept.where("keeps").select("base", "n"))
        skips = _before(gone.select("base", F.col("n").alias("at"), F.lit(1).alias("one")), "one", "rank").select("base", (F.col("at") - F.col("rank") - 1).alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("index"))
        both = skips.unionByName(here.select("base", F.col("index").alias("at"), F.lit(0).alias("one"), "index"))
        found = _before(both, "one", "skipped", "one").where("index is not null").select("base", "index", (F.col("index") + F.col("skipped")).alias("number"))
        out = found if out is None else out.unionByName(found)
        lost = kept.where("not keeps").select("name", F.lit(True).alias("lost"))
        level = below.select("name").join(lost, "name", "left").select(F.col("name").alias("base"), F.coalesce("lost", F.lit(False)).alias("lost"))
    if out is None:
        return rows.withColumn("number", F.lit(1).cast("long")).limit(0)
    return own.join(out, ["base", "index"]).select(*(F.col(f"`{c}`") for c in rows.columns), "number")
