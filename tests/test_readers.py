"""The walk over a frontier and the data sources, against the file system and the version control program."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from sieveline.sources import diff, files, readers


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for a in range(5):
        for b in range(4):
            folder = root / f"only/a{a}/b{b}/c/d"
            folder.mkdir(parents=True)
            (folder / "m.py").write_text(f"x = {a}{b}\n")
            (folder.parent / "s.ts").write_text("let a = 1\n")
            (folder / "note.txt").write_text("n")
    (root / "only/.env").write_text("# c\nexport A=1\nB = 2\nnot a key\n")
    (root / "only/a0/.env.local").write_text("C=3\n")
    (root / "only/a0/node_modules/p").mkdir(parents=True)
    (root / "only/a0/node_modules/p/x.js").write_text("1")
    (root / "only/a1/venv").mkdir()
    (root / "only/a1/venv/pyvenv.cfg").write_text("")
    (root / "only/a1/venv/v.py").write_text("")
    (root / "only/bad.py").write_bytes(b"\xff\xfe")
    (root / ".gitignore").write_text("note.txt\n")
    return root


def on_disk(root):
    found = set()
    for at, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in ("node_modules", "venv")]
        found |= {os.path.relpath(os.path.join(at, n), root) for n in names}
    return found


def test_one_top_folder_is_shared_by_all_tasks(spark, tree):
    want = {p for p in on_disk(tree) if not p.endswith(("note.txt", ".gitignore"))}
    small = files.listing(spark, str(tree))
    assert {r.path for r in small.collect()} == want
    rounds = []
    real = files.staged
    files.staged = lambda df: (rounds.append(df), real(df))[1]
    try:
        large = files.listing(spark, str(tree), driver_entries=1, task_entries=4)
    finally:
        files.staged = real
    assert {r.path for r in large.collect()} == want and len(rounds) > 2
    busy = [df.where("is_folder or path is not null").select(F.spark_partition_id()).distinct().count() for df in rounds]
    assert max(busy) == spark.sparkContext.defaultParallelism


def test_tree_source(spark, tree):
    readers.register(spark)
    source = spark.read.format("source_tree").option("path", str(tree)).option("partitions", 5)
    df = source.load()
    rows = {r.path: r for r in df.collect()}
    assert set(rows) == on_disk(tree) and df.rdd.getNumPartitions() == 5
    assert rows["only/a1/b2/c/d/m.py"].text == "x = 12\n" and rows["only/a1/b2/c/d/m.py"].lang == "python" and rows["only/bad.py"].text is None and rows["only/.env"].lang is None
    mine = source.load().where("lang = 'typescript' and path like 'only/a2/%'")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", ""), plan
    assert sorted(r.path for r in mine.collect()) == [f"only/a2/b{b}/c/s.ts" for b in range(4)]
    assert {r.path for r in source.load().where("lang in ('python', 'tsx') and n_bytes > 6").collect()} == {p for p in rows if p.endswith("m.py")}
    slim = source.schema("path string, lang string").load()
    assert slim.columns == ["path", "lang"] and slim.count() == len(rows)


def test_shares_follow_filters_and_leave_folders_to_tasks(tree):
    from pyspark.sql.datasource import StringStartsWith

    few = readers.shares(str(tree), [StringStartsWith(("path",), "only/a3/b1/")], 3)
    assert sorted(f for s in few for f, _ in s.files) == sorted(p for p in on_disk(tree) if p.startswith("only/a3/b1/"))
    left = readers.shares(str(tree), [], 2, planned=1)
    assert any(s.folders for s in left)
    reader = readers.TreeReader({"path": str(tree)}, None)
    assert {p for s in left for p, _ in reader.paths(s)} == on_disk(tree)


def test_env_source(spark, tree):
    readers.register(spark)
    rows = sorted(map(tuple, spark.read.format("source_env").load(str(tree)).collect()))
    assert rows == [("only/.env", 2, "A"), ("only/.env", 3, "B"), ("only/a0/.env.local", 1, "C")]
    assert spark.read.format("source_env").load(str(tree)).where("path = 'only/a0/.env.local'").count() == 1


def git(root, *arguments):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@example.com", *arguments], check=True, capture_output=True)


def test_change_source_equals_the_parsed_diff(spark, tmp_path):
    readers.register(spark)
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init", "-q")
    for i in range(9):
        (root / f"f{i}.py").write_text("".join(f"{i} line {k}\n" for k in range(30)))
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    (root / "f1.py").write_text("".join(f"1 line {k}\n" if k not in (3, 9) else "new\nnew too\n" for k in range(30)))
    (root / "f2.py").unlink()
    os.rename(root / "f3.py", root / "g3.py")
    (root / "g3.py").write_text((root / "g3.py").read_text() + "tail\n")
    git(root, "add", "-A")
    (root / "fresh é.txt").write_text("a\nb")
    df = spark.read.format("source_changes").option("path", str(root)).load()
    changed, ranges = diff.change_of(spark, str(root))
    got = df.collect()
    assert {(r.path, r.status) for r in got} == {tuple(r) for r in changed.collect()}
    assert sorted((r.path, r.start, r.end) for r in got if r.start) == sorted(tuple(r) for r in ranges.collect())
    assert {r.path for r in df.where("status = 'D'").collect()} == {"f2.py"}
    git(root, "commit", "-qm", "two")
    both = spark.read.format("source_changes").option("path", str(root)).option("scope", "HEAD~1..HEAD").load()
    assert {(r.path, r.status) for r in both.collect()} == {("f1.py", "M"), ("f2.py", "D"), ("g3.py", "M")}
    assert spark.read.format("source_changes").option("path", str(root)).option("scope", "staged").load().count() == 0


def test_name_status_records():
    assert readers.name_status("M\0a\0R100\0b\0c\0D\0d\0") == [("M", "a", "a"), ("R", "c", "b"), ("D", "d", "d")]
    assert readers.name_status("") == []
