"""Places of rows in an order, numbered over many tasks: ranges of the order are sorted apart, and counts say where each begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.staging import small_or_shuffled, staged

#: Rows of a range that monotonically_increasing_id numbers: the range is in the bits above.
_IN_RANGE = 33


def numbered(df: DataFrame, order: list[Column], name: str = "place", group: list[str] | None = None, first: int = 1) -> DataFrame:
    """df with `name` (long): the place of each row in the order, from `first` and without gaps, within its group if there is one.

    Rows move once, into ranges of (group, order), which are sorted where they are. How many rows a range holds of a group, added up over the
    ranges before it, says where it begins: a table of a row for each range and group, so no task sees more than a range. Rows that are equal
    in group and order are dealt over ranges too, by where they were read, so one value may hold any share of the rows; their places among
    each other are open. Null groups count as a group. An empty table stays empty.
    """
    group = group or []
    keys = [F.col(f"`{g}`") for g in group]
    seq, at, part = "place seq", "place at", "place range"
    own = staged(df.withColumn(seq, F.monotonically_increasing_id()))
    by = [*(k.asc_nulls_first() for k in keys), *order, F.asc(f"`{seq}`")]
    sorted_ = staged(own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    in_range = F.col(f"`{at}`").bitwiseAND(F.lit((1 << _IN_RANGE) - 1))
    rows = sorted_.withColumn(part, F.shiftright(f"`{at}`", _IN_RANGE))
    counts = rows.groupBy(part, *keys).agg(F.count("*").alias("place n"), F.min(in_range).alias("place least"))
    if group:
        before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        begins = counts.withColumn("place begin", F.coalesce(F.sum("`place n`").over(before), F.lit(0)))
    else:
        begins = _added_up(counts, part)
    begins = begins.select(*(F.col(f"`{c}`").alias(f"of {c}") for c in (part, *group)), (F.col("`place begin`") - F.col("`place least`") + first).alias("place shift"))
    same = F.col(f"`{part}`") == F.col(f"`of {part}`")
    for g in group:
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"`of {g}`"))
    return rows.join(small_or_shuffled(begins), same).select(*(F.col(f"`{c}`") for c in df.columns), (in_range + F.col("`place shift`")).alias(name))


def _added_up(counts: DataFrame, part: str) -> DataFrame:
    """counts with the rows of all ranges before: one row for each range, as many as there are partitions, so the driver adds them up."""
    total, out = 0, []
    for r in counts.orderBy(part).collect():
        out.append((r[part], r["place least"], total))
        total += r["place n"]
    return counts.sparkSession.createDataFrame(out, f"`{part}` long, `place least` long, `place begin` long")
