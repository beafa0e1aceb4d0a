"""A store of snapshots of trees: contents by digest, folders by the digest of what they hold, so equal folders are one row set and need no look.

Tables below a folder, as Parquet: `blobs` (hash, content), `nodes/depth=D` (parent, name, is_folder, digest), `snapshots` (id, namespace, ts, message, root,
n_files). A folder's digest is made of its entries' names and digests, from the deepest folders to the top, a round for each level; nodes and
blobs that are there already are not written again. A comparison begins with two roots and goes down only where digests differ.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.extraction import digest_of
from sieveline.operators.staging import exists, small_or_shuffled, staged

#: Entries of a folder are digested in so many buckets by their names, so that no group holds a large folder.
BUCKETS = 4096
_BLOBS, _NODES = "hash string, content binary", "parent string, name string, is_folder boolean, digest string, depth int"
_SNAPSHOTS = "id long, namespace string, ts long, message string, root string, n_files long"
#: The digest of a folder without entries.
EMPTY = "0" * 64


def _parts(entries: DataFrame) -> DataFrame:
    """(folder, bucket, own, digest): entries (folder, name, is_folder, digest) by bucket, in the order of their names."""
    one = F.struct("name", "is_folder", "digest")
    line = lambda e: digest_of(e["name"], e["is_folder"], e["digest"])
    bucket = F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int").alias("bucket")
    parts = entries.groupBy("folder", bucket).agg(F.array_sort(F.collect_list(one)).alias("own"))
    return parts.select("folder", "bucket", "own", F.sha2(F.array_join(F.transform("own", line), ","), 256).alias("digest"))


def merkle(tree: DataFrame, known: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(digest of the top, nodes) of a tree (path, hash): nodes (parent, name, is_folder, digest, depth), the top's entries at depth 0.

    A path stands once; one that is a file and a folder at once has an entry of each kind. Null paths are left out; null hashes are the empty text.
    Entries of known folders (parent, depth) are left out of the nodes; folders are compared, so entries of those that are there do not travel.
    """
    n = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    own = staged(tree.where(F.col("path").isNotNull()).select("path", n.alias("depth"), F.coalesce("hash", F.lit("")).alias("digest")))
    deepest = own.agg(F.max("depth")).head()[0]
    if deepest is None:
        return EMPTY, tree.sparkSession.createDataFrame([], _NODES)
    above, last = (lambda c, depth: F.substring_index(c, "/", depth) if depth else F.lit("")), (lambda c: F.substring_index(c, "/", -1))
    folders, nodes = None, []
    for depth in range(deepest, -1, -1):
        # a folder of `depth` names is told by its path; the empty path is the top at depth 0 alone
        here = own.where(F.col("depth") == depth).select(above("path", depth).alias("folder"), last("path").alias("name"), F.lit(False).alias("is_folder"), "digest")
        if folders is not None:
            here = here.unionByName(folders.select(above("folder", depth).alias("folder"), last("folder").alias("name"), F.lit(True).alias("is_folder"), "digest"))
        parts = staged(_parts(here))
        folders = parts.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("bucket", "digest"))).alias("own"))
        folders = staged(folders.select("folder", F.sha2(F.to_json("own"), 256).alias("digest")))
        # of equal folders one gives the nodes
        wanted = folders.groupBy(F.col("digest").alias("parent")).agg(F.min("folder").alias("folder"))
        if known is not None:
            wanted = wanted.join(known.where(F.col("depth") == depth).select("parent").distinct(), "parent", "left_anti")
        named = parts.select("folder", "own").join(wanted, "folder").select("parent", F.inline(F.array_distinct("own")))
        nodes.append(named.select("parent", "name", "is_folder", "digest", F.lit(depth).alias("depth")))
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return folders.head()["digest"], out


class SnapshotStore:
    """Snapshots in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{table}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", _SNAPSHOTS)

    def nodes(self, depth: int | None = None) -> DataFrame:
        """Entries of folders; of one depth, only that partition is read."""
        own = self._read("nodes", _NODES)
        return own if depth is None else own.where(F.col("depth") == depth)

    def blobs(self) -> DataFrame:
        return self._read("blobs", _BLOBS)

    def save(self, tree: DataFrame, namespace: str = "manual", ts: int = 0, message: str = "", contents: DataFrame | None = None) -> tuple[int, bool]:
        """(id, whether it is new) of a tree (path, hash); contents: (hash, content). The same tree as the namespace's newest one gives that one.

        Blobs and nodes come first and the snapshot's row last, so what breaks off on the way is only unused.
        """
        root, nodes = merkle(tree, self.nodes().select("parent", "depth"))
        rows = self.snapshots()
        newest = rows.where(F.col("namespace") == namespace).agg(F.max_by("root", "id"), F.max("id")).head()
        if newest[0] == root:
            return newest[1], False
        if contents is not None:
            fresh = contents.dropDuplicates(["hash"]).join(self.blobs().select("hash"), "hash", "left_anti")
            fresh.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/blobs")
        nodes.sortWithinPartitions("parent").write.mode("append").partitionBy("depth").parquet(f"{self.folder}/nodes")
        own = (rows.agg(F.max("id")).head()[0] or 0) + 1
        n_files = tree.where(F.col("path").isNotNull()).count()
        self.spark.createDataFrame([(own, namespace, ts, message, root, n_files)], _SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/snapshots")
        return own, True

    def _root(self, id: int | None) -> str:
        if id is None:
            return EMPTY
        found = self.snapshots().where(F.col("id") == id).head()
        if found is None:
            raise KeyError(f"no snapshot {id}")
        return found["root"]

    def _levels(self, before: str, after: str) -> Iterator[DataFrame]:
        """For each depth the entries (path, name.., a, b) of folders that differ: a and b are the digests before and after, null where there is no entry."""
        frontier = self.spark.createDataFrame([("", before, after)], "path string, a string, b string").where(F.lit(before != after))
        depth = 0
        while not frontier.isEmpty():
            own = self.nodes(depth).drop("depth")
            few = small_or_shuffled(frontier)
            side = lambda x: own.join(few.where(F.col(x).isNotNull()).select("path", F.col(x).alias("parent")), "parent").select("path", "name", "is_folder", F.col("digest").alias(x))  # noqa: E731,B023
            both = staged(side("a").join(side("b"), ["path", "name", "is_folder"], "full_outer").withColumn("path", F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("/"), "name"))))
            yield both
            frontier = both.where(F.col("is_folder") & ~F.col("a").eqNullSafe(F.col("b"))).select("path", "a", "b")
            depth += 1

    def diff(self, before: int | None, after: int | None) -> DataFrame:
        """(path, status) between two snapshots, None for the empty tree: A, D or M; only folders that differ are read."""
        one, other = self._root(before), self._root(after)
        if EMPTY in (one, other) and one != other:  # every file of one side
            return self._files(other if one == EMPTY else one).select("path", F.lit("A" if one == EMPTY else "D").alias("status"))
        return self.diff_and_seen(before, after)[0]

    def diff_and_seen(self, before: int | None, after: int | None) -> tuple[DataFrame, int]:
        """diff(), and how many entries it compared."""
        found, seen = self.spark.createDataFrame([], "path string, status string"), 0
        for both in self._levels(self._root(before), self._root(after)):
            status = F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").when(F.col("a") != F.col("b"), "M")
            found = found.unionByName(both.where(~F.col("is_folder")).select("path", status.alias("status")).where("status is not null"))
            seen += both.count()
        return found, seen

    def _files(self, root: str) -> DataFrame:
        """(path, hash) of the files below a root: folders are walked level by level, and files joined to theirs once."""
        found, depth = self.spark.createDataFrame([], "path string, hash string"), 0
        frontier = self.spark.createDataFrame([("", root)], "path string, parent string").where(F.lit(root != EMPTY))
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("/"), "name")).alias("path")
        while not frontier.isEmpty():
            below = self.nodes(depth).drop("depth").join(small_or_shuffled(frontier), "parent")
            found = found.unionByName(below.where(~F.col("is_folder")).select(path, F.col("digest").alias("hash")))
            frontier = staged(below.where("is_folder").select(path, F.col("digest").alias("parent")))
            depth += 1
        return found

    def tree(self, id: int) -> DataFrame:
        """(path, hash) of a snapshot."""
        return self._files(self._root(id))

    def restore(self, id: int) -> DataFrame:
        """(path, content) of a snapshot; a null content where the blob was not stored."""
        return self.tree(id).join(self.blobs(), "hash", "left").select("path", "content")

    def listed(self) -> DataFrame:
        """(id, namespace, ts, message, n_files, added, deleted, modified) of each snapshot, changes against the one before it in its namespace."""
        rows = self.snapshots().orderBy("namespace", "id").collect()  # a row for each snapshot, which people take
        out, last = [], {}
        for r in rows:
            counts = {x["status"]: x["count"] for x in self.diff(last.get(r["namespace"]), r["id"]).groupBy("status").count().collect()}
            last[r["namespace"]] = r["id"]
            out.append((r["id"], r["namespace"], r["ts"], r["message"], r["n_files"], *(counts.get(s, 0) for s in "ADM")))
        return self.spark.createDataFrame(out, "id long, namespace string, ts long, message string, n_files long, added long, deleted long, modified long")

    def prune(self, keep: int, target: str) -> "SnapshotStore":
        """A store in another folder with the newest `keep` snapshots of each namespace, one at least, and only what they reach."""
        from sieveline.operators.snapshots import prune

        rows = prune(self.snapshots(), keep).where("kept").drop("kept")
        reached = staged(rows.select(F.col("root").alias("parent")).distinct())
        hashes, depth = None, 0
        while not reached.isEmpty():
            own = staged(self.nodes(depth).drop("depth").join(small_or_shuffled(reached), "parent"))
            own.sortWithinPartitions("parent").write.mode("append").parquet(f"{target}/nodes/depth={depth}")
            files = own.where(~F.col("is_folder")).select(F.col("digest").alias("hash"))
            hashes = files if hashes is None else hashes.unionByName(files)
            reached = own.where("is_folder").select(F.col("digest").alias("parent")).distinct()
            depth += 1
        if hashes is not None:
            self.blobs().join(hashes.distinct(), "hash", "left_semi").write.option("compression", "zstd").parquet(f"{target}/blobs")
        rows.write.parquet(f"{target}/snapshots")
        return SnapshotStore(self.spark, target)
