"""Incremental extraction against full runs, and the snapshot store against full outer joins."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import code, extraction, snapshots, store


def lines_of(files):
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("no", "line")).where("line like '%x%'")


def rows(df):
    return sorted(map(tuple, df.collect()))


def content_key():
    return extraction.digest_of(F.col("lang"), F.col("text"))


def test_only_changed_contents_are_worked_on(spark, tmp_path):
    files = [(f"src/f{i}.py", "python", f"a\nx = {i % 150}\n" + "y\n" * (i % 3)) for i in range(400)] + [("none.py", "python", "nothing")]
    df = spark.createDataFrame(files, "path string, lang string, text string")
    cache = extraction.ExtractionCache(spark, str(tmp_path / "c"), "v1")
    first = cache.extract(df, content_key(), lines_of)
    assert rows(first.rows) == rows(lines_of(df)) and first.fresh.count() == len({f[1:] for f in files})
    changed = [(p, lang, t + "x more\n") if i % 100 == 0 else (p.replace("src", "moved") if i % 7 == 0 else p, lang, t) for i, (p, lang, t) in enumerate(files)]
    after = spark.createDataFrame(changed, "path string, lang string, text string")
    worked = []

    def counted(files):
        worked.append(files.count())
        return lines_of(files)

    second = cache.extract(after, content_key(), counted)
    assert rows(second.rows) == rows(lines_of(after)) and worked == [second.fresh.count()] == [len({f[1:] for f in changed} - {f[1:] for f in files})] and worked[0] <= 5
    third = cache.extract(after, content_key(), counted)
    assert rows(third.rows) == rows(lines_of(after)) and worked[-1] == 0 and third.fresh.count() == 0
    other = extraction.ExtractionCache(spark, str(tmp_path / "c"), "v2").extract(df, content_key(), lines_of)
    assert other.fresh.count() == first.fresh.count() and rows(other.rows) == rows(first.rows)


def test_a_run_that_broke_off_and_one_beside_it_do_no_harm(spark, tmp_path):
    df = spark.createDataFrame([("a", "l", "x\nx"), ("b", "l", "x"), (None, "l", "x"), ("c", "l", None)], "path string, lang string, text string")
    cache = extraction.ExtractionCache(spark, str(tmp_path / "c"), "v")
    cache.extract(df.where("path = 'b'"), content_key(), lines_of)
    lost = lines_of(df).join(df.select("path", content_key().alias("key")), "path").drop("path")
    lost.write.parquet(str(tmp_path / "c/rows/version=v/batch=0lost"))  # rows without their keys
    twin = df.where("path = 'b'")
    lines_of(twin).join(twin.select("path", content_key().alias("key")), "path").drop("path").write.parquet(str(tmp_path / "c/rows/version=v/batch=1twin"))
    twin.select(content_key().alias("key")).write.parquet(str(tmp_path / "c/keys/version=v/batch=1twin"))
    assert rows(cache.extract(df, content_key(), lines_of).rows) == rows(lines_of(df.where("path is not null")))
    assert extraction.ExtractionCache(spark, str(tmp_path / "e"), "v").extract(df.limit(0), content_key(), lines_of).rows.count() == 0


def test_digests_tell_lists_of_values_apart(spark):
    pairs = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("-", "ab"), ("1:a", "b"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string").select(extraction.digest_of(F.col("a"), F.col("b")).alias("d"))
    assert df.distinct().count() == len(pairs)
    assert extraction.version_of(1, "a") != extraction.version_of("1", "a")


def test_check_rows_come_from_the_cache(spark, tmp_path):
    from sieveline.check import scan

    root = tmp_path / "tree"
    for i in range(6):
        (root / f"p{i}").mkdir(parents=True)
        (root / f"p{i}/m.py").write_text(f"import os\napi_key = 'sk_live_{'a' * 20}'\ndef f{i}():\n    return eval(input())\n")
        (root / f"p{i}/s.test.js").write_text("console.log(1)\n")
    full = rows(scan(spark, str(root)).rows)
    assert rows(scan(spark, str(root), extracted=str(tmp_path / "cache")).rows) == full
    (root / "p3/m.py").write_text("import sys\n")
    seen = []
    real = code.extract
    code.extract = lambda files, *a: (seen.append(files.count()), real(files, *a))[1]
    try:
        again = scan(spark, str(root), extracted=str(tmp_path / "cache"))
    finally:
        code.extract = real
    assert seen == [1] and rows(again.rows) == rows(scan(spark, str(root)).rows) != full


def trees():
    rng = random.Random(3)
    paths = [f"{a}/{b}/f{c}" for a in "abcdef" for b in "xyz" for c in range(12)] + ["top", "a/deep/er/and/deeper/file"]
    one = {p: f"h{rng.randrange(9)}" for p in paths}
    two = dict(one)
    two["a/x/f1"], two["new/q"] = "other", "h1"
    del two["b/y/f3"]
    del two["a/deep/er/and/deeper/file"]
    two["top"] = "h-top"
    return one, two


def frame(spark, tree):
    return spark.createDataFrame(list(tree.items()) or [], "path string, hash string")


def test_store_equals_full_outer_joins(spark, tmp_path):
    one, two = trees()
    own = store.SnapshotStore(spark, str(tmp_path / "s"))
    content = lambda t: spark.createDataFrame([(h, h.encode()) for h in sorted(set(t.values()))] * 2, "hash string, content binary")
    assert own.save(frame(spark, one), contents=content(one)) == (1, True)
    nodes = own.nodes().count()
    assert own.save(frame(spark, one).repartition(5)) == (1, False)
    assert own.save(frame(spark, two), contents=content(two)) == (2, True)
    assert own.nodes().count() - nodes < 45 and own.blobs().count() == len(set(one.values()) | set(two.values()))
    for a, b in ((1, 2), (2, 1), (1, 1), (None, 1), (2, None)):
        left, right = (frame(spark, {None: {}, 1: one, 2: two}[x]) for x in (a, b))
        found, seen = own.diff_and_seen(a, b)
        assert rows(found) == rows(snapshots.tree_diff(left, right))
        assert seen <= 70 or None in (a, b)
    assert dict(rows(own.tree(2))) == two
    assert {p: bytes(c).decode() for p, c in rows(own.restore(1))} == one
    assert rows(own.listed().select("id", "n_files", "added", "deleted", "modified")) == [(1, len(one), len(one), 0, 0), (2, len(two), 1, 2, 2)]
    with pytest.raises(KeyError):
        own.diff(1, 9)


def test_pruning_keeps_what_is_reached(spark, tmp_path):
    one, two = trees()
    own = store.SnapshotStore(spark, str(tmp_path / "s"))
    for t, space in ((one, "manual"), (two, "manual"), ({}, "auto"), ({"a/x/f1": "q"}, "auto")):
        own.save(frame(spark, t), space, contents=spark.createDataFrame([(h, b"1") for h in set(t.values())], "hash string, content binary"))
    less = own.prune(1, str(tmp_path / "less"))
    assert [r["id"] for r in less.snapshots().orderBy("id").collect()] == [2, 4]
    assert dict(rows(less.tree(2))) == two and dict(rows(less.tree(4))) == {"a/x/f1": "q"}
    assert less.nodes().count() < own.nodes().count() and less.blobs().count() == len(set(two.values()) | {"q"})


def test_digests_of_folders(spark):
    one, two = trees()
    top, nodes = store.merkle(frame(spark, one))
    assert top == store.merkle(frame(spark, dict(reversed(one.items()))).repartition(4))[0] != store.merkle(frame(spark, two))[0]
    assert store.merkle(frame(spark, {}))[0] == store.EMPTY
    same = {"a/x": "1", "b/x": "1", "c/y": "1"}
    digests = {r["name"]: r["digest"] for r in store.merkle(frame(spark, same))[1].where("depth = 0").collect()}
    assert digests["a"] == digests["b"] != digests["c"]
    assert store.merkle(frame(spark, same))[1].where("depth = 1").count() == 2  # equal folders are stored once
