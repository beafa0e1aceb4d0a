"""Joins behind a Bloom filter against plain joins, and what they shuffle."""

import pytest
from pyspark.sql import functions as F

from sieveline.operators import blooms


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(6000).select((F.col("id") % 3000).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 4).cast("string").alias("s"), F.col("id").alias("x"))
    right = spark.range(900).select((F.col("id") * 7).alias("k"), (F.col("id") % 5).cast("string").alias("s"), F.lit(1).alias("y"))
    return left, right.unionByName(right.limit(20)).unionByName(spark.createDataFrame([(None, "1", 2)], "k long, s string, y int"))


@pytest.mark.parametrize("limit", [0, 10_000])
@pytest.mark.parametrize("on", [["k"], ["k", "s"]])
def test_joins_equal_plain_ones(spark, sides, limit, on):
    left, right = sides
    assert rows(blooms.anti_join(left, right, on, limit)) == rows(left.join(right, on, "left_anti"))
    assert rows(blooms.semi_join(left, right, on, limit)) == rows(left.join(right, on, "left_semi"))
    other = right.withColumnRenamed("s", "t") if on == ["k"] else right
    got = blooms.left_join(left, other, on, limit)
    assert rows(got) == rows(left.join(other, on, "left").select(got.columns))


def test_keys_beyond_the_bound_are_joined_as_they_are(spark, sides, monkeypatch):
    left, right = sides
    monkeypatch.setattr(blooms, "LARGEST", 64)
    plan = blooms.anti_join(left, right, ["k"], 0)
    assert rows(plan) == rows(left.join(right, ["k"], "left_anti")) and "words" not in plan._jdf.queryExecution().toString()


def test_empty_sides(spark, sides):
    left, right = sides
    for limit in (0, 100):
        assert blooms.anti_join(left, right.limit(0), ["k"], limit).count() == left.count()
        assert blooms.semi_join(left, right.limit(0), ["k"], limit).count() == 0
        assert blooms.anti_join(left.limit(0), right, ["k"], limit).count() == 0


def test_rows_without_a_partner_are_not_shuffled(spark):
    """Of 200,000 rows 1 in 100 has a partner; what may match is these and less than 1 in 50 of the others."""
    left = spark.range(200_000).withColumnRenamed("id", "k")
    keys = left.where("k % 100 = 0")
    marked = blooms.probed(left, ["k"], blooms.bloom_filter(keys, 2000), 2000)
    may = marked.where("`may match`").agg(F.count("*").alias("n"), F.count_if(F.col("k") % 100 == 0).alias("right")).head()
    assert may["right"] == 2000 and may["n"] < 2000 + 198_000 / 50
