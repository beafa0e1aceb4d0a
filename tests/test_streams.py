"""Streams with state: restarts, expired tokens, late rows and a baseline."""

from sieveline.streaming import findings as streams

SCHEMA = "fingerprint string, id string, line int, ts timestamp"


class Runs:
    """A folder that a query reads once for each run, with one checkpoint over all of them."""

    def __init__(self, spark, at, **options):
        self.spark, self.at, self.options, self.n = spark, at, options, 0

    def __call__(self, rows):
        self.spark.sql("select 1")
        cast = self.spark.createDataFrame(rows, "fingerprint string, id string, line int, ts string").selectExpr("fingerprint", "id", "line", "cast(ts as timestamp) as ts")
        cast.coalesce(1).write.mode("append").parquet(str(self.at / "in"))
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.at / "in"))
        query = streams.first_seen(stream, **self.options).writeStream.format("parquet").option("path", str(self.at / "out")).option("checkpointLocation", str(self.at / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive
        out = self.spark.read.parquet(str(self.at / "out")).collect()
        fresh, self.n = len(out) - self.n, len(out)
        return sorted((tuple(r) for r in out), key=lambda r: tuple((x is not None, str(x)) for x in r)), fresh


def test_a_restarted_query_reports_nothing_twice(spark, tmp_path):
    run = Runs(spark, tmp_path, ttl="2 hours", late="10 minutes")
    first, n = run([("a", "x", 1, "2024-01-01 10:00:00"), ("a", "x", 2, "2024-01-01 10:05:00"), ("b", "y", 3, "2024-01-01 10:01:00"), (None, "z", 9, "2024-01-01 10:00:00"), ("t", "z", 9, None)])
    assert [(r[0], r[2] if isinstance(r[2], int) else r[1]) for r in first] and n == 2
    _, n = run([("a", "x", 5, "2024-01-01 11:00:00"), ("c", "x", 6, "2024-01-01 11:00:00")])
    assert n == 1
    out, n = run([("c", "x", 7, "2024-01-01 09:00:00"), ("d", "x", 8, "2024-01-01 10:00:00")])
    assert n == 0  # later than the watermark
    _, n = run([("a", "x", 9, "2024-01-01 12:59:00"), ("b", "y", 9, "2024-01-01 12:58:00")])
    assert n == 1  # b was last seen at 10:01, a at 11:00
    out, _ = run([("a", "x", 10, "2024-01-01 16:00:00"), ("a", "x", 11, "2024-01-01 16:00:00")])
    by = {}
    for r in out:
        d = dict(zip([f.split()[0] for f in SCHEMA.split(", ")], r))
        by.setdefault(d["fingerprint"], []).append(d["line"])
    assert {k: sorted(v) for k, v in by.items()} == {"a": [1, 10], "b": [3, 9], "c": [6]}


def test_expired_tokens_leave_the_state(spark, tmp_path):
    run = Runs(spark, tmp_path, ttl="1 hour", late="1 minute", events=True)
    run([("a", "x", 1, "2024-01-01 10:00:00")])
    run([("z", "x", 1, "2024-01-01 14:00:00")])
    out, _ = run([("z", "x", 2, "2024-01-01 14:01:00")])
    assert [(r[0], r[-1]) for r in out if r[0] == "a"] == [("a", "expired"), ("a", "new")] or [(r[0], r[-1]) for r in out if r[0] == "a"] == [("a", "new"), ("a", "expired")]
    _, n = run([("a", "x", 3, "2024-01-01 14:02:00")])
    assert n == 1


def test_tokens_of_a_baseline_are_not_new(spark, tmp_path):
    known = spark.createDataFrame([("a",)], "fingerprint string")
    out, n = Runs(spark, tmp_path, baseline=known)([("a", "x", 1, "2024-01-01 10:00:00"), ("b", "x", 2, "2024-01-01 10:00:00")])
    assert n == 1 and out[0][0] == "b"
