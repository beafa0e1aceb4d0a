"""Joins whose left side is probed against a Bloom filter of the right side's keys, so that rows without a partner are not shuffled.

A filter is a table of blocks of BLOCK bits, as longs; a key's block comes from one hash and its PROBES bits from others, so one probe reads one
block. Blocks are built by an aggregation, and broadcast only as far as LARGEST bits, a bound that the counted keys are held against: fewer than
`rows` keys are broadcast themselves, and more than the filter can tell apart are joined as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.staging import BROADCAST_ROWS, staged

BLOCK, PROBES, BITS_PER_KEY = 4096, 5, 12
#: Bits of a filter that is broadcast: 64 MB.
LARGEST = 1 << 29
_WORDS = BLOCK // 64


def _block(keys: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), *keys), F.lit(blocks))


def _bits(keys: list[Column]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(BLOCK)).cast("int") for i in range(PROBES)]


def bloom_filter(keys: DataFrame, n: int) -> DataFrame:
    """(block, words) of distinct keys, of which there are about n; blocks without a key have no row."""
    own = [F.col(f"`{c}`") for c in keys.columns]
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK))
    bits = keys.select(_block(own, blocks).alias("block"), F.explode(F.array(*_bits(own))).alias("bit"))
    words = bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, bit & 63))").alias("bits"))
    by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    return words.groupBy("block").agg(by_word.alias("m")).select("block", F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("words"))


def probed(left: DataFrame, on: list[str], filter_: DataFrame, n: int, name: str = "may match") -> DataFrame:
    """left with `name`: false if no key of the filter equals the row's; null keys are false."""
    own = [F.col(f"`{c}`") for c in on]
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK))
    hit = reduce(Column.__and__, (F.getbit(F.get("words", F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1 for b in _bits(own)))
    whole = reduce(Column.__and__, (c.isNotNull() for c in own))
    joined = left.withColumn("own block", F.when(whole, _block(own, blocks))).join(F.broadcast(filter_), F.col("own block") == F.col("block"), "left")  # at most LARGEST bits
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("own block", "block", "words")


def _split(left: DataFrame, keys: DataFrame, on: list[str], rows: int) -> tuple[DataFrame, DataFrame] | bool:
    """(rows of left that may match, those that do not); True if keys are few enough to be broadcast, False if they are too many for a filter."""
    n = keys.count()
    if n <= rows:
        return True
    if n * BITS_PER_KEY > LARGEST:
        return False
    marked = probed(left, on, staged(bloom_filter(keys, n)), n)
    may = F.col("`may match`")
    return marked.where(may).drop("may match"), marked.where(~may).drop("may match")


def _keys(right: DataFrame, on: list[str]) -> DataFrame:
    return right.select(*(F.col(f"`{c}`") for c in on)).dropna().distinct()


def anti_join(left: DataFrame, right: DataFrame, on: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """left without the rows whose key the right side has; rows with a null in it stay. Only rows that may match are shuffled."""
    keys = staged(_keys(right, on))
    parts = _split(left, keys, on, rows)
    if isinstance(parts, bool):
        return left.join(F.broadcast(keys) if parts else keys, on, "left_anti")
    return parts[1].unionByName(parts[0].join(keys, on, "left_anti"))


def semi_join(left: DataFrame, right: DataFrame, on: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of left whose key the right side has."""
    keys = staged(_keys(right, on))
    parts = _split(left, keys, on, rows)
    if isinstance(parts, bool):
        return left.join(F.broadcast(keys) if parts else keys, on, "left_semi")
    return parts[0].join(keys, on, "left_semi")


def left_join(left: DataFrame, right: DataFrame, on: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """left with the right side's columns, null where it has no row; rows that cannot match get their nulls without a shuffle."""
    keys = staged(_keys(right, on))
    parts = _split(left, keys, on, rows)
    if isinstance(parts, bool):
        return left.join(F.broadcast(right) if parts and right.count() <= rows else right, on, "left")
    rest = [f for f in right.schema.fields if f.name not in on]
    alone = parts[1].select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))
    return parts[0].join(right, on, "left").unionByName(alone.select(*on, *(F.col(f"`{c}`") for c in left.columns if c not in on), *(F.col(f"`{f.name}`") for f in rest)))
