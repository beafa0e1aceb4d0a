"""Versions of trees, retention, and caches of registry answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.blooms import left_join


def tree_diff(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, status) of paths added, deleted or modified between two trees of (keys, path, hash)."""
    on = [*keys, "path"]
    both = before.withColumnRenamed("hash", "h1").join(after.withColumnRenamed("hash", "h2"), on, "full_outer")
    status = F.when(F.col("h1").isNull(), "A").when(F.col("h2").isNull(), "D").when(F.col("h1") != F.col("h2"), "M")
    return both.select(*on, status.alias("status")).where("status is not null")


def list_with_changes(files: DataFrame) -> DataFrame:
    """By snapshot of (id, path, hash): paths added, deleted and modified since the one before it."""
    ids = files.select("id").distinct()
    chain = ids.select("id", F.lag("id").over(Window.orderBy("id")).alias("previous"))  # a row for each snapshot
    now = files.join(chain, "id").select("id", "path", "hash")
    old = chain.where("previous is not null").join(files.withColumnRenamed("id", "previous"), "previous").select("id", "path", "hash")
    changes = tree_diff(old, now, "id").groupBy("id").agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("A", "added"), ("D", "deleted"), ("M", "modified"))))
    return ids.join(changes, "id", "left").na.fill(0, ["added", "deleted", "modified"])


def prune(snapshots: DataFrame, keep: int, by: str = "namespace") -> DataFrame:
    """Snapshots with `kept`: the newest `keep` of each namespace, one at least."""
    w = Window.partitionBy(by).orderBy(F.desc("id"))
    return snapshots.withColumn("kept", F.row_number().over(w) <= max(1, keep))


def tree_hash(files: DataFrame) -> DataFrame:
    """(id, hash, n) of each snapshot: equal trees have equal hashes.

    Rows fall into 256 buckets by their digest; a bucket's sorted digests are digested, and then the buckets' digests in order,
    so no group holds a whole tree, and a tree can be found that has a given hash no easier than for SHA-256.
    """
    rows = files.select("id", F.sha2(F.concat_ws("\0", "path", "hash"), 256).alias("d"))
    parts = rows.groupBy("id", F.substring("d", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d"), F.count("*").alias("n"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x["b"], x["d"])), ",")
    return parts.groupBy("id").agg(F.sha2(ordered, 256).alias("hash"), F.sum("n").alias("n"))


def newest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key; of equally new ones the greatest. An aggregation, so a hot key combines early."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(at, *(c for c in rest if c != at))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def upsert(cache: DataFrame, fresh: DataFrame, now: int) -> DataFrame:
    """The cache with fresh answers: inconclusive ones and times from the future or before 1970 are not stored."""
    good = fresh.where(F.col("exists_flag").isNotNull() & F.col("fetched_at").between(0, now))
    return newest(cache.unionByName(good), ["ecosystem", "name"], "fetched_at")


def lookup(names: DataFrame, cache: DataFrame, now: int, ttl: int) -> DataFrame:
    """names with what the cache knows: exists, missing, or inconclusive if it has no row or an old one."""
    live = F.when(F.lit(now) - F.col("fetched_at") <= ttl, F.col("exists_flag"))
    verdict = F.when(live == 1, "exists").when(live == 0, "missing").otherwise("inconclusive")
    return left_join(names, cache, ["ecosystem", "name"]).withColumn("existence", verdict)


def snapshot_if_changed(trees: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, is_new) for a fresh tree (path, hash): the newest id that has the same tree, or the next id."""
    known = tree_hash(trees)
    own = tree_hash(fresh.withColumn("id", F.lit(0).cast(trees.schema["id"].dataType))).select("hash", "n")
    same = known.join(own, ["hash", "n"], "left_semi").agg(F.max("id").alias("same"))
    last = trees.agg(F.max("id").alias("last"))
    return same.crossJoin(last).select(F.coalesce("same", F.col("last") + 1, F.lit(1)).alias("id"), F.col("same").isNull().alias("is_new"))  # one row each


def resolve_ids(asked: DataFrame, snapshots: DataFrame, namespaces: tuple[str, ...] = ("manual", "auto")) -> DataFrame:
    """asked (id) with the namespace that has it, the first of several."""
    order = F.array_position(F.array(*map(F.lit, namespaces)), F.col("namespace"))
    best = snapshots.groupBy("id").agg(F.min(F.struct(order.alias("o"), F.col("namespace"))).alias("b")).select("id", F.col("b.namespace").alias("namespace"))
    return asked.join(best, "id", "left")


def materialize(trees: DataFrame, id: int) -> DataFrame:
    return trees.where(F.col("id") == id).select("path", "hash")


def restored(current: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action) that brings a tree back to a snapshot: write what it lacks or has otherwise, delete what came since."""
    action = F.when(F.col("status") == "D", "delete").otherwise("write")
    return tree_diff(target, current).withColumn("status", F.translate("status", "AD", "DA")).select("path", action.alias("action"))


def next_id(snapshots: DataFrame) -> DataFrame:
    """(next_id): one more than the highest id of all namespaces; 1 without any."""
    return snapshots.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def name_status(records: DataFrame, by: str = "id", text: str = "text") -> DataFrame:
    """(by, path, status) of NUL-separated name-status records: A, D, M, T with a path, R and C with a source and the destination that counts."""
    parts = records.select(by, F.filter(F.split(text, "\0"), lambda x: x != "").alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<status:string,path:string>>").alias("out"), F.lit("").alias("status"))

    def step(acc, x):
        opens = acc["at"] == 0
        two = x.startswith("R") | x.startswith("C")
        row = F.array(F.struct(acc["status"].alias("status"), x.alias("path")))
        return (
            F.when(opens, F.struct(F.when(two, 2).otherwise(1).alias("at"), acc["out"].alias("out"), F.substring(x, 1, 1).alias("status")))
            .when(acc["at"] == 2, F.struct(F.lit(1).alias("at"), acc["out"].alias("out"), acc["status"].alias("status")))
            .otherwise(F.struct(F.lit(0).alias("at"), F.concat(acc["out"], row).alias("out"), F.lit("").alias("status")))
        )

    return parts.select(by, F.explode(F.aggregate("p", start, step)["out"]).alias("r")).select(by, "r.path", "r.status")
