"""Links between the members of shared buckets: no group emits all its pairs, and no key meets in one task.

A bucket links its members to its smallest member, its head. Pairs of other members are compared only in buckets whose
members are still in different components after that, in pairs of blocks of BLOCK members. So every pair
of members of a bucket is either compared or already connected, at a cost of a row for each member and, in a bucket that
stays apart, a row for each member and block.

Buckets that hold more than 1 / common.HEAVY of all rows are found on a hashed sample of the rows (which decides where rows are
worked on, never which rows count); there are fewer than that of them, so they can be broadcast, and their rows are not
shuffled by bucket. The other buckets are small parts of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm import common
from sieveline.llm.common import heavy_join, one_of, staged, width
from sieveline.llm.graph import connected_components

#: Rows of a block.
BLOCK = 256
#: One row of so many is looked at to find them.
SAMPLED = 16


def headed(members: DataFrame) -> DataFrame:
    """members (bucket, id, ..) of buckets with several of them, with `head`, the smallest id, and `n`, their number."""
    seen = members.where(F.pmod(F.xxhash64("bucket", "id"), F.lit(SAMPLED)) == 0)
    counts = staged(seen.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 3"), "counts")
    total = seen.count()
    heavy = counts.where(F.col("c") > total / common.HEAVY).select("bucket").limit(common.HEAVY)  # fewer by the sum; the limit states it
    hot = one_of("bucket", [r[0] for r in heavy.collect()])
    own = members.where(hot)
    heads = own.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("n"))
    w = Window.partitionBy("bucket")
    light = members.where(~hot).withColumns({"head": F.min("id").over(w), "n": F.count("*").over(w)})
    return light.where("n > 1").unionByName(own.join(F.broadcast(heads.limit(common.HEAVY)), "bucket").where("n > 1").select(*light.columns))


class Forest:
    """Passes on links that join what the links before them have not: a spanning forest, so components stay and most links of large groups go.

    It starts anew after SPAN links, which bounds its memory.
    """

    SPAN = 500_000

    def __init__(self):
        self.at: dict = {}

    def _root(self, x):
        while (up := self.at.get(x, x)) != x:
            self.at[x] = self.at.get(up, up)
            x = up
        return x

    def joins(self, a: list, b: list) -> pa.Array:
        """A mask of the links that join something new."""
        out = []
        for x, y in zip(a, b):
            p, q = self._root(x), self._root(y)
            out.append(p != q)
            if p != q:
                self.at[p] = q
                self.at.setdefault(q, q)
                if len(self.at) > self.SPAN:
                    self.at = {}
        return pa.array(out, pa.bool_())


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b, ..) of a task's batches that Forest passes on."""
    forest = Forest()
    for batch in batches:
        yield batch.filter(forest.joins(batch.column("a").to_pylist(), batch.column("b").to_pylist()))


def head_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with its head, each pair once."""
    return members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()


def least_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member with the smallest head of all its buckets; a pair for each member, where head_pairs has one for each head."""
    return members.groupBy("id").agg(F.min("head").alias("a")).where("a <> id").select("a", F.col("id").alias("b"))


def across(members: DataFrame, first: DataFrame, payload: DataFrame, compare: Callable, heads_done: bool = True, sift: Callable | None = None, light: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b, ..) between members of a bucket that the links `first` (a, b) leave in different components.

    payload: (id, ..), a row for each member. compare(table, i, j, component, put) gets the rows of two blocks, indices of
    their pairs of different components, and the components; put(i, j, ..) takes a link that is right, after which the pair's
    components count as one in this task: `component.same(i, j)`. It yields (a, b, *schema of compare.extra).

    sift(table, i, j) gives those of the pairs that are worth comparing, from the columns of `light` (id, ..) alone, a smaller payload. Only the
    members of such pairs are then dealt with their payload, besides the columns of light; rows go on, not pairs. block: members of a block.
    """
    spark, kind = members.sparkSession, members.schema["id"].dataType
    parts = connected_components(first.select("a", "b")).withColumnRenamed("node", "id")
    rows = members.where("id <> head") if heads_done else members
    known = staged(rows.drop("head", "n").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")), "known")
    spans = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
    left = heavy_join(known, staged(spans.select("bucket", "n"), "spans"), "bucket")
    dealt = (
        left.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("place", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
        .drop("bucket", "n", "blocks")
    )
    if sift is not None:
        by_light = dealt.join(light, "id").repartition(width(spark), "place").sortWithinPartitions("place")

        def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in by_group(batches, "place"):
                i, j = _open_pairs(group)[:2]
                if len(i):
                    i, j = sift(group, i, j)
                if len(i):
                    yield from group.take(pa.array(np.union1d(i, j))).to_batches()

        dealt = staged(by_light.mapInArrow(sifted, by_light.schema), "sifted")
    joined = dealt.join(payload, "id").repartition(width(spark), "place").sortWithinPartitions("place")
    extra = getattr(compare, "extra", [])
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "place"):
            i, j, parts_ = _open_pairs(group)
            if not len(i):
                continue
            found = _Found(group.column("id").to_pylist(), parts_)
            compare(group, i, j, found)
            if found.out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found.out), types)], names=schema.names)

    types = [_arrow(f.dataType) for f in schema.fields]
    return joined.mapInArrow(lambda batches: spanning(run(batches)), schema)


def _open_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, component of each row) of a pair of blocks: the pairs of rows of different components, none if one block is empty."""
    none = np.zeros(0, np.int64)
    own, other = group.column("own").to_numpy(), group.column("other").to_numpy()
    sides = np.unique(own)
    if len(sides) == 1 and (other != own).any():
        return none, none, none  # the other block of this pair is empty
    left, right = np.flatnonzero(own == sides[0]), np.flatnonzero(own == sides[-1])
    parts = np.unique(group.column("component").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    wanted = parts[left][:, None] != parts[right][None, :]
    if len(sides) == 1:
        wanted &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(wanted)
    return left[i], right[j], parts


class _Found:
    """Links found in a task, and the components that they join."""

    def __init__(self, ids: list, parts: np.ndarray):
        self.ids, self.parts, self.at, self.out = ids, parts.tolist(), {}, []

    def _root(self, x: int) -> int:
        while x in self.at:
            x = self.at[x]
        return x

    def same(self, i: int, j: int) -> bool:
        return self._root(self.parts[i]) == self._root(self.parts[j])

    def put(self, i: int, j: int, *more) -> None:
        self.at[self._root(self.parts[i])] = self._root(self.parts[j])
        self.out.append((min(self.ids[i], self.ids[j]), max(self.ids[i], self.ids[j]), *more))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column, from batches in which equal values stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and values[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = values[lo]
    if held:
        yield pa.Table.from_batches(held)


def binary_rows(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]
