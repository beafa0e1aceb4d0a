"""Changed files and added lines from version control."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import line_count
from sieveline.sources.files import LARGEST

#: What a change is measured against, as arguments of the version control program.
SCOPES = {"worktree": ["HEAD"], "staged": ["--cached"]}


def diff_text(root: str, scope: str = "worktree") -> str:
    """The unified diff without context of a folder: the working tree or what is staged against HEAD, or the working tree against a revision. On the driver."""
    if scope.startswith("-"):
        raise ValueError(f"not a revision: {scope}")
    command = ["git", "-C", root, "-c", "core.quotePath=false", "diff", "-U0", "--no-color", "--no-ext-diff", "--find-renames", *SCOPES.get(scope, [scope]), "--"]
    return subprocess.run(command, check=True, capture_output=True, timeout=120).stdout.decode("utf-8", "replace")


def untracked(root: str) -> list[str]:
    """Paths that version control does not know and does not ignore. On the driver."""
    found = subprocess.run(["git", "-C", root, "ls-files", "--others", "--exclude-standard", "-z"], check=True, capture_output=True, timeout=120).stdout
    return [p for p in found.decode("utf-8", "replace").split("\0") if p]


def tracked(root: str) -> list[str]:
    found = subprocess.run(["git", "-C", root, "ls-files", "-z"], check=True, capture_output=True, timeout=120).stdout
    return [p for p in found.decode("utf-8", "replace").split("\0") if p]


def _head(part: Column, mark: str, side: str) -> Column:
    """The path after a mark in the header of a file's part: the lines before its first hunk."""
    header = F.split(part, r"\r?\n@@ ", 2)[0]
    return F.array_max(F.regexp_extract_all(header, F.lit(rf'(?md)^{mark} (?:"?{side}/)?(.*?)"?\t?(?=\r?\n|\z)'), F.lit(1)))


def changes(diffs: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(changed (by, path, status), ranges (by, path, start, end)) of unified diffs (by, text).

    Status A, M or D; a renamed file counts under its new name, as M if lines changed, else not at all; binary files have no ranges. A
    hunk that adds no line gives no range. Removed lines that look like headers stand inside hunks and are passed over. A text is cut
    into its files and each is read where it lies, so no line is shuffled or sorted, and rows that share a key stay apart.
    """
    part, goal, source = F.col("part"), F.col("goal"), F.col("source")
    parts = diffs.select(by, F.explode(F.split("text", r"\r?\n(?=diff --git )")).alias("part")).where(part.startswith("diff --git "))
    known = parts.select(by, "part", _head(part, r"\+\+\+", "b").alias("goal"), _head(part, "---", "a").alias("source")).where("goal is not null").select(
        by, "part", F.when(goal == "/dev/null", source).otherwise(goal).alias("path"), F.when(goal == "/dev/null", "D").when(source == "/dev/null", "A").otherwise("M").alias("status")
    )
    hunk = F.lit(r"(?md)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
    found = F.arrays_zip(F.regexp_extract_all("part", hunk, F.lit(1)).alias("start"), F.regexp_extract_all("part", hunk, F.lit(2)).alias("n"))
    hunks = known.select(by, "path", F.explode(found).alias("h")).select(by, "path", F.col("h.start").cast("int").alias("start"), F.when(F.col("h.n") == "", "1").otherwise(F.col("h.n")).cast("int").alias("n"))
    return known.select(by, "path", "status"), hunks.where("n > 0").select(by, "path", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def whole_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, ranges) of untracked files (path, text): each is added as a whole; too large ones are left out."""
    own = files.where(F.octet_length("text") <= LARGEST)
    return own.select("path", F.lit("A").alias("status")), own.select("path", F.lit(1).alias("start"), line_count(F.col("text")).alias("end"))


def change_of(spark: SparkSession, root: str, scope: str = "worktree") -> tuple[DataFrame, DataFrame]:
    """(changed (path, status), ranges (path, start, end)) of a folder under version control, with its untracked files in the working tree's scope."""
    diffs = spark.createDataFrame([(0, diff_text(root, scope))], "id int, text string")
    changed, ranges = (df.drop("id") for df in changes(diffs, "id"))
    if scope == "worktree":
        from sieveline.sources.files import _contents

        paths = spark.createDataFrame([(p,) for p in untracked(root)], "path string")
        text = F.col("content").cast("string")
        fresh = whole_files(_contents(root, paths).where(F.is_valid_utf8(text)).select("path", text.alias("text")))
        changed, ranges = changed.unionByName(fresh[0]), ranges.unionByName(fresh[1])
    return changed, ranges
