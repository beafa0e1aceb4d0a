"""Findings as streams: what is new against a baseline or since a token was last seen, and counts by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """A stream of findings without those of a static baseline: a left join, since streams allow no anti join on this side."""
    known = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    return findings.join(known, "fingerprint", "left").where("known is null").drop("known")


def first_seen(findings: DataFrame, at: str = "ts", ttl: str = "7 days", late: str = "1 hour", baseline: DataFrame | None = None, events: bool = False) -> DataFrame:
    """A stream of the findings whose token is new: not of the baseline, and not seen within `ttl` before, by the findings' own time.

    State is one time for each token, kept in the query's checkpoint, so a restarted query goes on where it stopped: what it has reported is
    not reported again. A token that is seen again keeps its place; one that was not for longer than `ttl` is forgotten when the watermark passes, and new
    again after that. Rows later than the watermark (`late`) are left out. Of the rows of a token in one batch the earliest counts first; equal
    times are taken in the order of their columns. events: also rows with `event` 'expired' when a token is forgotten, null but for
    fingerprint and time; `event` is 'new' for the others. Rows without a token or a time are left out.
    """
    fields = [f for f in findings.schema.fields if f.name not in (at, "event")]
    own = findings.select(*(F.col(f"`{f.name}`") for f in fields), F.col(f"`{at}`").cast("timestamp").alias(at)).where(F.col("fingerprint").isNotNull() & F.col(at).isNotNull())
    if baseline is not None:
        own = new_since(own, baseline).select(own.columns)
    span = int(pd.Timedelta(ttl).total_seconds() * 1000)
    names = [*own.columns, "event"] if events else own.columns
    schema = T.StructType([*own.schema.fields, T.StructField("event", T.StringType())] if events else own.schema.fields)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (seen,) = state.get
            state.remove()
            if events:
                gone = pd.DataFrame({n: [None] for n in names}, dtype=object)
                gone["fingerprint"], gone[at], gone["event"] = key[0], pd.Timestamp(seen + span, unit="ms"), "expired"
                yield gone
            return
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows[at].iloc[i], tuple(map(str, rows.iloc[i]))))]
        last = state.get[0] if state.exists else None
        keep = []
        for i, when in enumerate(rows[at]):
            now = int(when.timestamp() * 1000)
            if last is None or now - last > span:
                keep.append(i)
            last = now if last is None else max(last, now)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1) + 1)
        if keep:
            out = rows.iloc[keep]
            yield out.assign(event="new")[names] if events else out[names]

    return own.withWatermark(at, late).groupBy("fingerprint").applyInPandasWithState(step, schema, T.StructType([T.StructField("seen", T.LongType())]), "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(findings: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by rule and tumbling window; rows later than the watermark are left out."""
    timed = findings.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "id").agg(F.count("*").alias("n"))
