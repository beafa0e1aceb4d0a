"""Places counted over ranges against sorted lists."""

import random

from pyspark.sql import functions as F

from sieveline.operators import places, report
from sieveline.plans import findings_plans


def test_places_equal_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 1, 1, 2, rng.randint(0, 99)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, i long").repartition(7)
    got = {r["i"]: r["place"] for r in places.numbered(df, [F.asc_nulls_first("k"), F.desc("i")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[2]))
    assert [got[r[2]] for r in want] == list(range(1, len(rows) + 1))
    by = places.numbered(df, [F.asc("i")], "n", ["g"], first=0).collect()
    for g in (None, "a", "b", "c"):
        assert [r["n"] for r in sorted((r for r in by if r["g"] == g), key=lambda r: r["i"])] == list(range(sum(r[0] == g for r in rows)))


def test_equal_rows_and_empty_tables(spark):
    same = spark.range(500).select(F.lit("x").alias("g"), F.lit(1).alias("k"))
    assert sorted(r["place"] for r in places.numbered(same, [F.asc("k")]).collect()) == list(range(1, 501))
    assert sorted(r["place"] for r in places.numbered(same, [F.asc("k")], group=["g"]).collect()) == list(range(1, 501))
    assert places.numbered(same.limit(0), [F.asc("k")]).collect() == []
    assert places.numbered(same.limit(0), [F.asc("k")], group=["g"]).collect() == []


def test_a_hot_value_is_dealt_over_ranges(spark):
    rows = spark.range(4000).select((F.col("id") % 3 * F.col("id")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    try:
        out = places.numbered(rows, [F.asc("k")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    spread = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 2500


def test_reports_sort_in_no_single_task(spark):
    df = findings_plans.findings(spark, "/root/testdata/sf0.001").withColumns({"confidence": F.lit("high"), "suggestion": F.lit(None).cast("string"), "remediation": F.lit("x"), "fingerprint": F.lit("t")})
    for out in (report.agent_report(df), report.terminal_report(df, verbose=True)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "Window" in x and "row_number" in x and "line" in x.split("row_number")[0] and "first" not in x]
    few = df.limit(3)
    assert {r["part"] for r in report.terminal_report(few).collect()} == {0, 1, 2, 3}
