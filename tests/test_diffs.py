"""Unified diffs as texts and as lines: each value by hand or by a plain reading, and what is shuffled."""

import random
import re

from sieveline.operators import staging
from sieveline.plans import detect_plans, text_plans
from sieveline.sources import diff


def _read(text: str) -> tuple[list, list]:
    """Changed files and added ranges of a diff, line by line."""
    files, hunk = [], False
    for line in re.split("\r?\n", text):
        if line.startswith("diff --git "):
            files.append(([], [], []))
            hunk = False
        elif files and line.startswith("@@ "):
            hunk = True
            if m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line):
                files[-1][2].append((int(m[1]), int(m[1]) + int(m[2] or 1) - 1))
        elif files and not hunk and line[:4] in ("+++ ", "--- "):
            files[-1][line[0] == "-"].append(re.sub(r'\A"?b/|"?\t?\Z' if line[0] == "+" else r'\A"?a/|"?\t?\Z', "", line[4:]))
    heads = [(max(g), max(s, default=None), r) for g, s, r in files if g]
    changed = [(s if g == "/dev/null" else g, "D" if g == "/dev/null" else "A" if s == "/dev/null" else "M", r) for g, s, r in heads]
    return [(p, s) for p, s, _ in changed], [(p, a, b) for p, _, ranges in changed for a, b in ranges if b >= a]


def test_diffs_are_those_of_a_plain_reading(spark):
    some = random.Random(4)
    lines = ["diff --git a/x b/x", "diff --git a/y b/y", "--- a/x", "--- /dev/null", '--- "a/é x"\t', "+++ b/x", "+++ /dev/null", '+++ "b/é x"\t', "+++ b/b/", "@@ -1 +2 @@", "@@ -1,2 +3,4 @@ f()", "@@ -1 +9,0 @@", "@@ no", "+x", "-- a/x", "", " @@ -1 +2 @@", "a\r@@ -1 +7 @@", "Binary files a/x and b/x differ"]
    texts = ["", "diff --git a/x b/x", "\n@@ -1 +1 @@", None] + [some.choice(["\n", "\r\n"]).join(some.choices(lines, k=some.randint(1, 24))) for _ in range(400)]
    texts += ["\n".join(["diff --git a/x b/x", "--- a/x", "+++ b/x", *(f"@@ -1 +{i} @@\n+diff --git a/z b/z" for i in range(3000))])]
    changed, ranges = diff.changes(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id")
    want = [_read(t or "") for t in texts]
    assert sorted(map(tuple, changed.collect()), key=repr) == sorted(((i, *f) for i, (files, _) in enumerate(want) for f in files), key=repr)
    assert sorted(map(tuple, ranges.collect()), key=repr) == sorted(((i, *r) for i, (_, found) in enumerate(want) for r in found), key=repr)
    assert all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in (changed, ranges))


def test_diffs_of_the_same_key_stay_apart(spark, tmp_path):
    spark.createDataFrame([(8,), (8,), (9,), (9,), (9,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, detect_plans.diff_files(spark, str(tmp_path)).collect())) == [(8, "g8", "A")] * 2 + [(9, "f9", "D")] * 3
    assert sorted(map(tuple, detect_plans.diff_added_ranges(spark, str(tmp_path)).collect())) == sorted([(8, "g8", 200, 202)] * 2 + [(8, "g8", 9, 9)] * 2 + [(9, "f9", 10, 10), (9, "f9", 200, 202)] * 3)


def test_items_are_dealt_out_by_order_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "PART_ROWS", 100)
    some = random.Random(5)
    rows = [(some.randint(1, 300), some.randint(1, 6), some.choice([None, 1, 22]), some.choice([None, 3, 44, 55]), some.choice([None, 1.5, 3.0, 5.9, 7.0])) for _ in range(2000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    items, want = {}, []
    for o, n, *values in rows:
        items.setdefault(o, {}).setdefault(n, []).append(values)
    for o, lines in items.items():
        path = None
        for n in sorted(lines):
            part, start, q = (min((v for v in found if v is not None), default=None) for found in zip(*lines[n]))
            path = f"p{part}.py" if n % 2 and part is not None else path
            added = None if q is None else 1 if int(q) % 3 == 0 else int(q) % 5
            if path and start is not None and added:
                want.append((o, path, start, start + added - 1))
    got = text_plans.diff_hunk_ranges(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(l_orderkey" in plan and got.rdd.getNumPartitions() == 20
    monkeypatch.setattr(staging, "PART_ROWS", 5)
    assert staging.dealt(spark.range(2000), "id").rdd.getNumPartitions() == 200 and staging.dealt(spark.range(3), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
