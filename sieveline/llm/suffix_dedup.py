"""Removal of byte strings that also start in an earlier document, by blockwise suffix sorting.

A byte goes if a string of WIDTH bytes covers it that also starts in a document with a smaller key. The suffixes that start
such strings are sorted one bucket at a time. The bucket of a suffix is the least hashed K-gram among those of its first
WIDTH bytes (its anchor), so equal strings meet in one bucket, at equal distances from their anchors. A bucket's text is
laid out with its anchors on multiples of V; a difference cover modulo V picks the sample positions, whose ranks are
computed first. Suffixes of one bucket and residue are then sorted by one word, which reaches the next sample position,
and longer ties are resolved by that position's rank, as it lies equally far behind each of them. Neighbours that agree in WIDTH bytes form a group, whose smallest key keeps
its string. Memory holds one bucket's text and ranks at a time.

Across the cluster: documents are gathered into blocks of a few MB, stored once. A first pass finds which anchors occur in
more than one document (sorted hashes by shard; the answer is a bit for each, and one for anchors whose strings differ a lot in
many blocks). A second pass drops, in each
block, slices that an earlier document of the block holds whole, and sends each of the others once to the shards that sort them, so a
passage that many documents share costs a row for each block. Anchors whose strings differ a lot are sent string by string, dealt by
the strings' hashes, so that no shard gets all of them. Ranges to
remove come back to the blocks, which are bucketed so that their text is never shuffled.

Defined results: null and empty texts have no bytes and lose none; whole texts are judged; equal keys are one document;
keys are long or int, but not both the least and the greatest long in one table; null keys come after all others and lose nothing to each other; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import note_table, shared_dir, splitmix, text_chunks, width
from sieveline.llm.words import BACK, STEP, power

WIDTH, K = 50, 24
V = 32
#: Bytes of a block's texts, if no text alone has more.
BLOCK = 1_000_000
#: Bytes of one suffix bucket's text, if no string alone has more.
BUCKET = 2_000_000
#: An anchor with more than MANY bytes of different slices in more than HOT blocks is dealt out by its strings.
MANY, HOT = 1000, 256
#: So is one in more than WIDE blocks, however little each has of it.
WIDE = 1 << 14
#: Bytes of texts for each shard, at the most; the memory of a task follows it and not the number of partitions.
SHARD = 16_000_000
#: What stands for a null key among keys; a table that has it as a key is worked on with its keys less one.
LAST = (1 << 63) - 1


def difference_cover(v: int) -> list[int]:
    """Residues of which some pair differs by each number modulo v, chosen greedily."""
    cover, have = [0], {0}
    while len(have) < v:
        best = max((r for r in range(v) if r not in cover), key=lambda r: len({(r - c) % v for c in cover} | {(c - r) % v for c in cover} | have))
        have |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = np.array(difference_cover(V))
#: By residue: the distance to the next sample position.
AHEAD = np.array([min((c - r) % V for c in COVER) for r in range(V)])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, number of windows, anchor position, anchor hash)."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < WIDTH:
        return empty, empty, empty, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, size = BYTES[data], 1
        while size * 2 <= K:  # a hash of twice as many bytes from two neighbours
            h = h[: len(h) - size] * np.uint64(MULTIPLIERS[size]) + h[size:]
            size *= 2
        if size < K:
            rest = K - size
            h = h[: len(h) - rest] * np.uint64(MULTIPLIERS[K]) + h[rest:]
        h = splitmix(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, size, least = WIDTH - K + 1, 1, key
    while size * 2 <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    left = np.repeat(at[1:], np.diff(at))[: len(place)] - np.arange(len(place))
    starts = np.flatnonzero(left >= WIDTH)
    if not len(starts):
        return empty, empty, empty, np.zeros(0, np.uint64)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    # the least of some hashes is small; mixed again, anchors are even over the shards
    return starts[first], np.diff(np.append(first, len(starts))), place[first], splitmix(h[place[first]] ^ np.uint64(0x9E3779B97F4A7C15))


BYTES = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLIERS = {s: int(splitmix(np.array([s * 7919], np.uint64))[0]) | 1 for s in (1, 2, 4, 8, 16, K)}


def repeated_windows(text: np.ndarray, begin: np.ndarray, count: np.ndarray, lead: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of the slices, one slice after the other: whether its string also starts in a document of a smaller key.

    A slice holds `count` windows from text[begin]; its anchor lies `lead` bytes behind its begin (or before it, if negative).
    """
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    order = np.argsort(anchor, kind="stable")
    groups = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1])) if len(order) else np.zeros(0, int)
    size = np.cumsum(count[order] + WIDTH - 1 + V)
    lo = 0
    while lo < len(order):
        reach = np.searchsorted(size, (size[lo - 1] if lo else 0) + BUCKET, "right")
        g = np.searchsorted(groups, max(reach, lo + 1), "right") - 1
        hi = int(groups[g]) if reach < len(order) and groups[g] > lo else (len(order) if reach >= len(order) else int(np.append(groups, len(order))[np.searchsorted(groups, lo, "right")]))
        rows = order[lo:hi]
        heavy = size[hi - 1] - (size[lo - 1] if lo else 0) > BUCKET
        lo = hi
        if len(rows) < 2:
            continue
        flags = (_sort_strings if heavy else _sort_bucket)(text, begin[rows], count[rows], lead[rows], anchor[rows], doc[rows])
        to = np.repeat(ends[rows] - count[rows], count[rows]) + _steps(count[rows])
        out[to] = flags
    return out


def _sort_strings(text: np.ndarray, begin: np.ndarray, count: np.ndarray, lead: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """_sort_bucket for one anchor with more than BUCKET bytes: its windows go to buckets by the hashes of their strings."""
    length = count + WIDTH - 1
    h = []
    for lo, hi in _runs(length, BUCKET):
        body = text[np.repeat(begin[lo:hi], length[lo:hi]) + _steps(length[lo:hi])]
        h.append(string_hashes(body, np.repeat(np.cumsum(length[lo:hi]) - length[lo:hi], count[lo:hi]) + _steps(count[lo:hi]), WIDTH))
    h = np.concatenate(h)
    slot = np.repeat(np.arange(len(count)), count)
    by = np.lexsort((doc[slot], h))
    first = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
    sizes = np.diff(np.append(first, len(by)))
    several = doc[slot[by[first]]] != doc[slot[by[first + sizes - 1]]]
    by, sizes = by[np.repeat(several, sizes)], sizes[several]
    ends = np.cumsum(sizes)
    offset = _steps(count)
    out = np.zeros(len(h), bool)
    for lo, hi in _runs(sizes * (WIDTH + V), BUCKET):
        own = by[ends[lo] - sizes[lo] : ends[hi - 1]]
        out[own] = _sort_bucket(text, begin[slot[own]] + offset[own], np.ones(len(own), np.int64), lead[slot[own]] - offset[own], h[own], doc[slot[own]])
    return out


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, one after last) of runs of neighbours whose sizes sum up to `most`, or that stand alone."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def string_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A hash of the bytes from each begin, the same wherever they stand."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * power(STEP, len(data), "step"), out=total[1:])
        return splitmix((total[begin + length] - total[begin]) * power(BACK, len(data), "back")[begin])


def heads(data: np.ndarray, begin: np.ndarray, count: np.ndarray, lead: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each slice: the slice of the smallest key that holds the same bytes around the same anchor, which may be itself. Hashes find, bytes confirm."""
    out = np.arange(len(begin))
    length = count + WIDTH - 1
    with np.errstate(over="ignore"):
        key = splitmix(string_hashes(data, begin, length) + anchor + (lead * 64 + count).astype(np.uint64))
    by = np.lexsort((doc, key))
    new = np.append(True, key[by][1:] != key[by][:-1])
    head = np.repeat(by[new], np.diff(np.append(np.flatnonzero(new), len(by))))
    may = (by != head) & (length[by] == length[head]) & (lead[by] == lead[head])
    own, first = by[may], head[may]
    for lo, hi in _runs(length[own], BUCKET):
        steps, size = _steps(length[own[lo:hi]]), length[own[lo:hi]]
        same = data[np.repeat(begin[own[lo:hi]], size) + steps] == data[np.repeat(begin[first[lo:hi]], size) + steps]
        same = np.logical_and.reduceat(same, np.cumsum(size) - size)
        out[own[lo:hi][same]] = first[lo:hi][same]
    return out


def _steps(count: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _sort_bucket(text: np.ndarray, begin: np.ndarray, count: np.ndarray, lead: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    length = count + WIDTH - 1
    # each slice starts where its anchor falls on a multiple of V
    shift = (-lead) % V
    room = (shift + length + V - 1) // V * V
    base = np.cumsum(room) - room + shift
    total = int(room.sum())
    laid = np.zeros(total + V + 64, np.uint8)
    steps = _steps(length)
    laid[np.repeat(base, length) + steps] = text[np.repeat(begin, length) + steps]
    word = np.zeros(total + V + 56, np.uint64)
    for k in range(8):
        word |= laid[k : k + len(word)].astype(np.uint64) << np.uint64(56 - 8 * k)
    start = np.repeat(base, count) + _steps(count)
    residue = (start % V).astype(np.int32)
    # ranks of the sample positions that suffixes lean on, to the depth that a tie can need
    behind = start + AHEAD[residue]
    sample = np.zeros(len(word), bool)
    sample[behind] = True
    sample = np.flatnonzero(sample)
    deep = [word[sample + 8 * k] for k in range(6, -1, -1)]
    by = np.lexsort(deep)
    new = np.zeros(len(by), bool)
    for w in deep:
        w = w[by]
        new[1:] |= w[1:] != w[:-1]
    rank = np.zeros(len(word), np.int32)
    rank[sample[by]] = np.cumsum(new)
    # a suffix is its bytes up to the next sample position, which one word holds, and that position's rank
    bucket = np.repeat(np.cumsum(np.append(False, anchor[1:] != anchor[:-1])), count).astype(np.int32) * V + residue
    by = np.lexsort((rank[behind], word[start], bucket))
    at = start[by]
    new = np.zeros(len(at), bool)
    new[:1] = True
    for k in (0, 8, 16, 24, 32, 40, WIDTH - 8):
        w = word[at + k]
        new[1:] |= w[1:] != w[:-1]
    owner = np.repeat(doc, count)[by]
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(at))))
    out = np.zeros(len(at), bool)
    out[by] = owner > least
    return out


def _hash_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash() of long values, to place rows in table buckets."""

    def mix(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15)) | (k >> np.uint32(17))
        return k * np.uint32(0x1B873593)

    with np.errstate(over="ignore"):
        h = np.full(len(values), seed, np.uint32)
        for half in (values & 0xFFFFFFFF, (values >> 32) & 0xFFFFFFFF):
            h ^= mix(half.astype(np.uint32))
            h = (h << np.uint32(13)) | (h >> np.uint32(19))
            h = h * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.astype(np.int32)


def _one_of_each(buckets: int) -> np.ndarray:
    """A value for each table bucket that falls into it."""
    found = np.full(buckets, -1, np.int64)
    lo = 0
    while (found < 0).any():
        values = np.arange(lo, lo + 20 * buckets)
        place = _hash_long(values).astype(np.int64) % buckets
        found[place[::-1]] = np.where(found[place[::-1]] < 0, values[::-1], found[place[::-1]])
        lo += 20 * buckets
    return found


def _ranges(flags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, one after last byte) of the strings of flagged windows, neighbours together."""
    at = np.sort(starts[flags])
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + WIDTH


def stored_blocks(docs: DataFrame, key: str, text: str, size: int, less: int = 0) -> tuple[DataFrame, int]:
    """The documents as blocks, in a table bucketed by `part`: (part, block, keys, ends, data, rest, size); keys are lowered by `less`."""
    spark = docs.sparkSession
    n = width(spark)
    names = [c for c in docs.columns if c not in (key, text)]
    values = _one_of_each(n)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made = used = 0
        held: list[tuple] = []
        held_bytes = 0

        def full() -> pa.RecordBatch:
            nonlocal made, used
            part = int(values[(task * 7 + used // (12 * size)) % n])
            keys = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            data = b"".join(h[2] for h in held)
            rest = pa.Table.from_batches([h[3] for h in held]).combine_chunks() if names else None
            sink = pa.BufferOutputStream()
            if names:
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_table(rest)
            used += len(data)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([(task << 24) + made]), pa.array([keys.tobytes()]), pa.array([np.cumsum(sizes).tobytes()]), pa.array([data], pa.binary()), pa.array([sink.getvalue().to_pybytes() if names else b""]), pa.array([len(data)])], names=["part", "block", "keys", "ends", "data", "rest", "size"])

        for batch in batches:
            keys = batch.column("own key").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            other = batch.select([f"c{i}" for i in range(len(names) + 1)]) if names else None
            for lo, hi, data, at in text_chunks(batch.column("own text"), size):
                held.append((keys[lo:hi], np.diff(at), data.tobytes(), other.slice(lo, hi - lo) if names else None))
                held_bytes += len(data)
                if held_bytes >= size:
                    yield full()
                    held, held_bytes = [], 0
        if held:
            yield full()

    rows = docs.select((F.col(key).cast("long") - less).alias("own key"), F.col(text).alias("own text"), F.isnull(text).alias("c0"), *(F.col(c).alias(f"c{i + 1}") for i, c in enumerate(names)))
    blocks = rows.mapInArrow(gather, "part long, block long, keys binary, ends binary, data binary, rest binary, size long")
    table = f"sieveline_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    note_table(table, path)
    blocks.write.option("compression", "zstd").option("path", path).bucketBy(n, "part").saveAsTable(table)
    return spark.table(table), n


def _open_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, ends = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ends"], np.int64)
    return keys, np.concatenate([[0], ends]), np.frombuffer(row["data"], np.uint8)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _shift(docs: DataFrame, key: str) -> int:
    """1 if some key is the one that stands for null, else 0."""
    if docs.schema[key].dataType.simpleString() != "bigint":
        return 0
    low, high = docs.agg(F.min(key), F.max(key)).head()
    if high != LAST:
        return 0
    if low == -LAST - 1:
        raise ValueError(f"{key}: the least and the greatest long cannot both be keys")
    return 1


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", result: str = "bytes", block: int = BLOCK) -> DataFrame:
    """Every document with what is left of it: its columns with `kept` in place of the text, and the counts.

    result: what `kept` is: "bytes"; "text", without characters that are cut in part; or "digest", the column then being
    `kept_sha256`. n_bytes, n_removed and n_spans count the text's bytes, those removed and their runs.
    """
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(docs.schema[key].dataType.simpleString())
    if kind is None:
        raise ValueError(f"{key}: keys must be long or int")
    spark = docs.sparkSession
    less = _shift(docs, key)
    blocks, n = stored_blocks(docs, key, text, block, less)
    stored = blocks.agg(F.sum("size")).head()[0] or 0
    shards = max(4 * n, -(-stored // SHARD))  # smaller than partitions, as a shard is held in memory at once
    edges = (np.arange(1, shards, dtype=np.float64) / shards * 2.0**48).astype(np.uint64)
    many_bytes, hot_blocks, wide_blocks = MANY, HOT, WIDE

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, at, data = _open_block(row)
            first, count, place, long = anchors(data, at)
            h = long >> np.uint64(16)
            owner = keys[np.searchsorted(at, first, "right") - 1]
            by = np.lexsort((owner, h))
            new = np.append(True, h[by][1:] != h[by][:-1]) if len(h) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            several = owner[by[start]] != owner[by[np.append(start[1:], len(h)) - 1]] if len(h) else new
            many = np.zeros(len(start), bool)
            if len(h):
                group = np.zeros(len(h), np.int64)
                group[by] = np.cumsum(new) - 1
                may = np.flatnonzero((np.bincount(group, weights=count + WIDTH - 1) > many_bytes)[group])
                if len(may):
                    own = may[heads(data, first[may], count[may], (place - first)[may], long[may], owner[may]) == np.arange(len(may))]
                    many = np.bincount(group[own], weights=count[own] + WIDTH - 1, minlength=len(start)) > many_bytes
            h = h[by[start]]
            cut = np.concatenate([[0], np.searchsorted(h, edges, "left"), [len(h)]])
            raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards)), pa.array(np.full(shards, row["part"])), pa.array(np.full(shards, row["block"])), pa.array([raw[a:b].tobytes() for a, b in zip(cut, cut[1:])]), *(pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(cut, cut[1:])]) for x in (several, many))], names=["shard", "part", "block", "hashes", "several", "many"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "shard"):
            raw = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in group.column("hashes").to_pylist()]
            sizes = np.array([len(r) for r in raw])
            wide = np.zeros((int(sizes.sum()), 8), np.uint8)
            wide[:, :6] = np.concatenate(raw)
            h = wide.view("<u8").ravel()
            several, many = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c).astype(bool) for x, c in zip(group.column(name).to_pylist(), sizes)]) for name in ("several", "many"))
            by = np.argsort(h, kind="stable")
            same = h[by[1:]] == h[by[:-1]]
            hit = several[by]
            hit[1:] |= same
            hit[:-1] |= same
            flags, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
            flags[by] = hit
            if len(h) and (many.any() or len(sizes) > wide_blocks):
                run = np.cumsum(np.append(True, ~same)) - 1
                hot[by] = ((np.bincount(run, weights=many[by]) > hot_blocks) | (np.bincount(run) > wide_blocks))[run]
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([group.column("part").combine_chunks(), group.column("block").combine_chunks(), group.column("shard").combine_chunks(), *(pa.array([np.packbits(x[e - c : e]).tobytes() for e, c in zip(ends, sizes)]) for x in (flags, hot)), pa.array(sizes)], names=["part", "block", "shard", "bits", "hot", "n"])

    known = blocks.select("part", "block", "keys", "ends", "data").mapInArrow(hashes, "shard long, part long, block long, hashes binary, several binary, many binary")
    known = known.repartitionById(n, (F.col("shard") % n).cast("int")).sortWithinPartitions("shard", "block")
    bits = known.mapInArrow(shared, "part long, block long, shard long, bits binary, hot binary, n long")
    bits = bits.groupBy("part").agg(F.collect_list(F.struct("block", "shard", "bits", "hot", "n")).alias("answers"))
    second = blocks.select("part", "block", "keys", "ends", "data").join(bits.hint("shuffle_hash"), "part")
    second = second.select("part", "block", "keys", "ends", "data", F.expr("array_sort(transform(filter(answers, x -> x.block = block), x -> struct(x.shard, x.bits, x.hot, x.n)))").alias("answers"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for row in _rows(batches):
            keys, at, data = _open_block(row)
            begin, count, place, h = anchors(data, at)
            if not len(begin):
                continue
            flags, hot = (np.concatenate([np.unpackbits(np.frombuffer(x[name], np.uint8), count=x["n"]).astype(bool) for x in row["answers"]]) for name in ("bits", "hot"))
            short = h >> np.uint64(16)
            slot = np.searchsorted(np.unique(short), short)
            keep, hot = flags[slot], (flags & hot)[slot]
            begin, count, lead, h, hot = begin[keep], count[keep], (place - begin)[keep], h[keep], hot[keep]
            if not len(begin):
                continue
            if hot.any():
                n_of, offset = count[hot], _steps(count[hot])
                windows = np.repeat(begin[hot], n_of) + offset
                lead = np.concatenate([lead[~hot], np.repeat(lead[hot], n_of) - offset])
                h = np.concatenate([h[~hot], string_hashes(data, windows, WIDTH)])
                begin, count = np.concatenate([begin[~hot], windows]), np.concatenate([count[~hot], np.ones(len(windows), np.int64)])
            doc = keys[np.searchsorted(at, begin, "right") - 1]
            head = heads(data, begin, count, lead, h, doc)
            gone = doc > doc[head]
            rows = [(0, -1, begin[gone], begin[gone] + count[gone] + WIDTH - 1, b"", b"")]
            # of equal slices of a document one is sent, with the places of the others
            own, again = np.flatnonzero(head == np.arange(len(head))), np.flatnonzero(~gone & (head != np.arange(len(head))))
            by = np.argsort(h[own], kind="stable")
            place = np.zeros(len(head), np.int64)
            place[own[by]] = np.arange(len(own))
            again = again[np.argsort(place[head[again]], kind="stable")]
            where = place[head[again]]
            s, c, l, g, d = (x[own] for x in (begin, count, lead, h, doc))
            cut = np.concatenate([[0], np.searchsorted(g[by] >> np.uint64(16), edges, "left"), [len(by)]])
            for shard in np.flatnonzero(np.diff(cut)).tolist():
                i = by[cut[shard] : cut[shard + 1]]
                length = c[i] + WIDTH - 1
                body = data[np.repeat(s[i], length) + _steps(length)]
                lo, hi = np.searchsorted(where, [cut[shard], cut[shard + 1]])
                meta = np.concatenate([[len(i)], g[i].view(np.int64), d[i], s[i], c[i], l[i], where[lo:hi] - cut[shard], begin[again[lo:hi]]]).astype("<i8")
                rows.append((1, shard, np.zeros(0, np.int64), np.zeros(0, np.int64), pack.compress(meta.tobytes()), pack.compress(body.tobytes())))
            spread = row["block"] % shards
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] if r[0] else spread for r in rows], pa.int32()), pa.array([row["part"]] * len(rows)), pa.array([row["block"]] * len(rows)), pa.array([np.concatenate([r[2], r[3]]).astype("<i8").tobytes() for r in rows]), pa.array([r[4] for r in rows]), pa.array([r[5] for r in rows])], names=["kind", "shard", "part", "block", "ranges", "meta", "body"])

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for group in _groups(batches, "shard"):
            kinds = group.column("kind").to_numpy()
            parts, names_ = group.column("part").to_numpy(), group.column("block").to_numpy()
            known_ = group.column("ranges").to_pylist()
            metas, bodies = group.column("meta").to_pylist(), group.column("body").to_pylist()
            for i in np.flatnonzero(kinds == 0):
                yield pa.RecordBatch.from_arrays([pa.array([parts[i]]), pa.array([names_[i]]), pa.array([known_[i]])], names=["part", "block", "ranges"])
            own = np.flatnonzero(kinds == 1)
            if not len(own):
                continue
            raw = [np.frombuffer(unpack.decompress(metas[i]), "<i8") for i in own]
            g, d, s, c, l = np.concatenate([m[1 : 1 + 5 * m[0]].reshape(5, -1) for m in raw], axis=1)
            body = np.frombuffer(b"".join(unpack.decompress(bodies[i]) for i in own), np.uint8)
            length = c + WIDTH - 1
            begin = np.cumsum(length) - length
            gone = repeated_windows(body, begin, c, l, g.view(np.uint64), d)
            to = np.concatenate([[0], np.cumsum([m[0] for m in raw])])
            ends = np.concatenate([[0], np.cumsum(c)])
            for i, m, a, b in zip(own, raw, to, to[1:]):
                flags = gone[ends[a] : ends[b]]
                if not flags.any():
                    continue
                where, others = m[1 + 5 * m[0] :].reshape(2, -1)
                size = c[a:b][where]
                flags = np.concatenate([flags, flags[np.repeat(ends[a:b][where] - ends[a], size) + _steps(size)]])
                lo, hi = _ranges(flags, np.concatenate([np.repeat(s[a:b], c[a:b]) + _steps(c[a:b]), np.repeat(others, size) + _steps(size)]))
                if len(lo):
                    yield pa.RecordBatch.from_arrays([pa.array([parts[i]]), pa.array([names_[i]]), pa.array([np.concatenate([lo, hi]).astype("<i8").tobytes()])], names=["part", "block", "ranges"])

    sliced = second.mapInArrow(resolve, "kind int, shard int, part long, block long, ranges binary, meta binary, body binary")
    sliced = sliced.repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard", "block")
    gone = sliced.mapInArrow(sort_shard, "part long, block long, ranges binary")
    gone = gone.groupBy("part").agg(F.collect_list(F.struct("block", "ranges")).alias("gone"))
    third = blocks.join(gone.hint("shuffle_hash"), "part", "left")
    third = third.select("block", "keys", "ends", "data", "rest", F.expr("transform(filter(gone, x -> x.block = block), x -> x.ranges)").alias("gone"))

    kept = [f for f in docs.schema.fields if f.name not in (text, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")]
    last = T.StructField("kept_sha256", T.StringType()) if result == "digest" else T.StructField("kept", T.BinaryType() if result == "bytes" else T.StringType())
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), last])
    others = [c for c in docs.columns if c not in (key, text)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, at, data = _open_block(row)
            edge = np.zeros(len(data) + 1, np.int32)
            for raw in row["gone"] or []:
                lo, hi = np.frombuffer(raw, "<i8").reshape(2, -1)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
            covered = np.cumsum(edge[:-1]) > 0
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            inner = at[1:-1][at[1:-1] < len(data)]
            begins[inner] = covered[inner]
            total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (covered, begins))
            rest_of = [data[a:b][~covered[a:b]].tobytes() for a, b in zip(at, at[1:])]
            made = {key: pa.array(np.where(keys == LAST, keys, keys + less), kind, mask=keys == LAST), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), "n_spans": pa.array(spans[at[1:]] - spans[at[:-1]], pa.int64())}
            if result == "digest":
                made[last.name] = pa.array([hashlib.sha256(x).hexdigest() for x in rest_of])
            elif result == "text":
                made[last.name] = pa.array([x.decode("utf-8", "ignore") for x in rest_of])
            else:
                made[last.name] = pa.array(rest_of, pa.binary())
            if others:
                table = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
                for i, c in enumerate(others):
                    if c not in made:
                        made[c] = table.column(f"c{i + 1}").combine_chunks() if table.num_rows else table.column(f"c{i + 1}")
            yield pa.RecordBatch.from_arrays([made[f.name] if not isinstance(made[f.name], pa.ChunkedArray) else pa.concat_arrays(made[f.name].chunks) for f in schema.fields], names=schema.names)

    return third.mapInArrow(apply, schema)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
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
