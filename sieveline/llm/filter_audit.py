"""What each of five filters removes under every order of applying them.

A document fails a set of the filters, one of 32, and an order of them removes it at the first step whose filter is in the set. That step is
looked up in a table of 32 sets by 120 orders. Tasks count their rows by part and set, send the counts through the table and keep one array
of removals by order, step and label for each part; the arrays of all tasks are summed.

Filters: A under 200 words; B under half of the words distinct; C more than 2 of 100 code points in A-Z; D a character of `#$%&*|`; E the text
of a smaller doc_id. Words are runs without space and \\t\\n\\v\\f\\r, case-sensitive.

Defined results: a null text is empty, and equal to other empty ones; an empty text fails A alone, but for E; a null part is the empty string; rows
without a doc_id never fail E, serve no other row as a smaller one and have no label; rows that repeat a doc_id and its text are not copies of each
other; a doc_id is good or toxic if any row of the labels says so; other columns play no part; an empty table gives no rows. Texts count whole: they
are read in pieces of 4 MB at word bounds, so a long one costs its distinct words beside its own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import heavy_keys, one_of, staged, text_chunks
from sieveline.llm.words import UNSPACED
from sieveline.operators.staging import small_or_shuffled

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: By set of failed filters (A is bit 0) and order: the step that removes a document, 0 if none does.
TABLE = np.array([[next((i + 1 for i, f in enumerate(order) if failed >> FILTERS.index(f) & 1), 0) for order in ORDERS] for failed in range(1 << len(FILTERS))], np.int64)
STEPS = len(FILTERS) + 1
_ALL, _SETS = len(ORDERS) * STEPS, len(TABLE)
#: A part's array: removals by order and step of all, good and toxic documents, then failures by filter, alone and with others.
_SIZE = 3 * _ALL + 2 * len(FILTERS)
#: Parts whose arrays a task keeps before it hands them on.
PARTS = 2048
_PIECE, _CHUNK = 4 << 20, 16 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True


def _words(raw: np.ndarray) -> tuple[int, int]:
    """(words, distinct words) of a text's bytes."""
    if len(raw) <= _PIECE:
        found = raw.tobytes().split()
        return len(found), len(set(found))
    n, seen, lo = 0, set(), 0
    while lo < len(raw):
        hi, look = min(len(raw), lo + _PIECE), _PIECE
        while hi < len(raw) and UNSPACED[raw[hi]]:  # on to the end of the word
            space = np.flatnonzero(~UNSPACED[raw[hi : hi + look]])
            hi = hi + int(space[0]) if len(space) else min(len(raw), hi + look)
        found = raw[lo:hi].tobytes().split()
        n += len(found)
        seen.update(found)
        lo = hi
    return n, len(seen)


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        failed, digests = np.zeros(batch.num_rows, np.int8), []
        for lo, hi, data, at in text_chunks(batch.column("text"), _CHUNK):
            total = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[at])
            points, upper = total((data & 0xC0) != 0x80), total((data >= 65) & (data <= 90))
            mask = (100 * upper > 2 * points) * 4 + (total(_SYMBOL[data]) > 0) * 8
            for i in range(hi - lo):
                raw = data[at[i] : at[i + 1]]
                n, distinct = _words(raw)
                mask[i] += (n < 200) + 2 * (100 * distinct < 50 * n)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            failed[lo:hi] = mask
        keep = [batch.column(c) for c in ("doc_id", "part")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(failed), pa.array(digests, pa.binary())], names=["doc_id", "part", "failed", "digest"])


def failed_filters(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, failed) of each row: the set of filters that its text fails, as bits. Only ids, parts and 16-byte digests are shuffled, never texts.

    Digests that more than 1 / HEAVY of the rows share are broadcast with their smallest doc_id; other rows are joined to theirs.
    """
    own = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = staged(own.mapInArrow(_failures, f"doc_id {kind}, part string, failed byte, digest binary"), "failures")
    first = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    hot_keys = heavy_keys(first, "digest", total=rows.count())
    hot = one_of("digest", hot_keys)
    joined = rows.where(~hot).join(first.where(~hot), "digest", "left")
    if hot_keys:
        joined = joined.unionByName(rows.where(hot).join(F.broadcast(first.where(hot)), "digest"))
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return joined.select("doc_id", "part", (F.col("failed") + copy).cast("int").alias("failed"))


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, np.ndarray] = {}
    bits = (np.arange(_SETS)[:, None] >> np.arange(len(FILTERS))) & 1

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.string()), pa.array(list(known.values()), pa.list_(pa.int64()))], names=["part", "counts"])

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        n_parts = len(parts.dictionary)
        cell = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * _SETS + batch.column("failed").to_numpy()
        labels = [None, *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("good", "toxic"))]
        counts = [np.bincount(cell, w, n_parts * _SETS).reshape(n_parts, _SETS) for w in labels]
        used = np.flatnonzero(counts[0])
        key = ((used // _SETS)[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * STEPS + TABLE[used % _SETS]
        removed = [np.bincount(key.ravel(), np.repeat(c.ravel()[used], len(ORDERS)), n_parts * _ALL).reshape(n_parts, _ALL) for c in counts]
        alone = counts[0][:, 1 << np.arange(len(FILTERS))]
        found = np.concatenate([*removed, counts[0] @ bits, alone], axis=1).astype(np.int64)
        for name, row in zip(parts.dictionary.to_pylist(), found):
            known[name] = known[name] + row if name in known else row
        if len(known) >= PARTS:
            yield out()
            known.clear()
    if known:
        yield out()


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    which = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    for batch in batches:
        for name, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            counts = np.zeros(_SIZE, np.int64)
            for c in cells:
                counts[c["pos"]] = c["n"]
            removed, good, toxic = (counts[k * _ALL : (k + 1) * _ALL].reshape(len(ORDERS), STEPS) for k in range(3))
            fails, alone = counts[3 * _ALL :].reshape(2, -1)
            here = removed[:, 1:]
            kept = removed.sum(axis=1, keepdims=True) - np.cumsum(here, axis=1)
            shapley = np.bincount(which.ravel(), here.ravel(), len(FILTERS)).astype(np.int64)
            numbers = [kept, here, fails[which] - here, alone[which], good[:, 1:], toxic[:, 1:], shapley[which]]
            n = here.size
            arrays = [pa.array([name] * n, pa.string()), pa.array(np.repeat(ORDERS, STEPS - 1).tolist()), pa.array(np.tile(np.arange(1, STEPS), len(ORDERS)), pa.int32()), *(pa.array(np.ascontiguousarray(x).ravel()) for x in numbers)]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _RESULT.split(", ")])


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order and step, as the module says; see _RESULT for the columns.

    The sums are of one row for each task, part and cell of its array that is not 0, and combine before they are shuffled.
    """
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failed_filters(docs, part).join(small_or_shuffled(marks), "doc_id", "left")
    rows = rows.select("part", "failed", *(F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")))
    partial = rows.mapInArrow(_partials, "part string, counts array<long>")
    cells = partial.select("part", F.posexplode("counts").alias("pos", "n")).where("n <> 0").groupBy("part", "pos").agg(F.sum("n").alias("n"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("pos", "n")).alias("cells")).mapInArrow(_report, _RESULT)


#: The same in SQL.
SQL = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 m AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM w),
 l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
 c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, f),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
 o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE a.k <> b.k AND a.k <> c.k AND a.k <> d.k AND a.k <> e.k AND b.k <> c.k AND b.k <> d.k AND b.k <> e.k AND c.k <> d.k AND c.k <> e.k AND d.k <> e.k),
 r AS (SELECT part, filter_order, n, good, toxic, f, list_position(list_transform(range(1, 6), lambda i: f[ascii(substr(filter_order, i, 1)) - 64]), true) AS gone FROM c, o),
 g AS (SELECT part, filter_order, s.step, substr(filter_order, s.step, 1) AS k, sum(n) FILTER (gone IS NULL OR gone = 0 OR gone > s.step) AS kept, sum(n) FILTER (gone = s.step) AS removed, sum(n) FILTER (f[ascii(substr(filter_order, s.step, 1)) - 64] AND gone < s.step) AS redundant,
   sum(n) FILTER (f[ascii(substr(filter_order, s.step, 1)) - 64] AND len(list_filter(f, lambda y: y)) = 1) AS unique_fails, sum(good) FILTER (gone = s.step) AS good_lost, sum(toxic) FILTER (gone = s.step) AS toxic_lost FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s GROUP BY part, filter_order, s.step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley FROM g"""
