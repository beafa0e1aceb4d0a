"""Packing of documents into sequences along a space-filling curve.

A document is a vector of hashed byte trigrams; a random projection maps it to DIMS dimensions, and its place on the
Hilbert curve through them is its sort key, so that documents of like content become neighbours. Key
ranges of even bytes (equal keys are spread by a hash of the id) are dealt to partitions, and each partition
fills its sequences in curve order, cutting a document where a sequence is full. What a partition has left at its end,
less than one sequence, is cut into sequences whose lengths are powers of two, which need no padding.

Defined results: null and empty texts are documents of the end id alone; whole texts are packed, whatever their length;
repeated rows are packed each; an empty table gives an empty table; only the key and the text are read, so extra columns
never clash. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import splitmix, staged, text_chunks, width

DIMS, BITS, BUCKETS = 4, 8, 256
CAPACITY = 1024
END = 0
CHUNK = 2_000_000
#: Fine ranges for each partition when its range is cut, and bytes that a document counts besides its text.
FINE, PER_DOCUMENT = 16, 32
PROJECTION = np.random.default_rng(1024).normal(0, 1, (BUCKETS, DIMS))
#: Fixed value: how byte-level BPE of this kind splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def project(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The projected vectors of a chunk's texts: trigram shares, projected."""
    n_docs = len(at) - 1
    counts = np.zeros((n_docs, BUCKETS))
    if len(data) > 2:
        gram = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
        bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64)
        doc = np.repeat(np.arange(n_docs), np.diff(at))[: len(bucket)]
        counts = np.bincount((doc << 8) | bucket, minlength=n_docs << 8).reshape(n_docs, BUCKETS).astype(float)
    return (counts / np.maximum(np.diff(at), 1)[:, None]) @ PROJECTION


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows, dimensions), by Skilling's transposition (2004)."""
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for d in range(len(x)):
            on = (x[d] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            out = (out << 1) | (((x[d] ^ t) >> b) & 1)
    return out


def curve_keys(points: np.ndarray, middle: np.ndarray, spread: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sort keys: the place on the curve, then a hash of the id."""
    scaled = np.clip((points - middle) / np.maximum(spread, 1e-12) / 6 + 0.5, 0, 1 - 1e-9)
    with np.errstate(over="ignore"):
        tie = (splitmix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
    return (hilbert((scaled * (1 << BITS)).astype(np.int64)) << 31) | tie


class ByteTokenizer:
    """The ids that a byte-level BPE file of the tokenizers library gives, by a faster encoder where the file allows it.

    The strings of the file's added tokens give those tokens' ids, as in the library; the text between them is encoded apart.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        fast = _fast_encoder(spec)
        if fast:
            self.encode = fast
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids


def _fast_encoder(spec: dict):
    """An encoder of the same ids, if the file has no normalizer, splits as PATTERN does and ranks its tokens by its merges; else None."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens", [])
    plain_split = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    odd_model = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    odd_added = any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model.get("type") != "BPE" or spec.get("normalizer") or not plain_split or odd_model or odd_added:
        return None
    byte_of = {c: b for b, c in _byte_letters().items()}
    special = {t["content"]: t["id"] for t in added}
    plain = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = len(plain) - len(merges)
    if first != 256 or any(plain.get(a + b) != first + k for k, (a, b) in enumerate(merges)) or any(c not in byte_of for t in plain for c in t):
        return None
    import tiktoken

    ranks = {bytes(byte_of[c] for c in t): i for t, i in plain.items()}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = list(special)

    def encode(text: str) -> list[int]:
        if any(m in text for m in marks):
            return own.encode(text, allowed_special="all")
        return own.encode_ordinary(text)

    return encode


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_loaded: dict[str, ByteTokenizer] = {}


class Packer:
    """Fills sequences with documents in the order in which they come."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: list[tuple] = []  # (document, start, ids, doc_tokens) of the sequence that is not full
        self.used = 0
        self.pieces: list[tuple] = []  # (document, start, ids, doc_tokens, sequence, offset)

    def _close(self) -> None:
        offset = 0
        for doc, start, ids, total in self.open:
            self.pieces.append((doc, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.open, self.used = [], 0
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.capacity - self.used]
            self.open.append((doc, start, part, len(ids)))
            start += len(part)
            self.used += len(part)
            if self.used == self.capacity:
                self._close()

    def finish(self) -> None:
        """Cut what is left into sequences of powers of two."""
        rest, left = self.open, self.used
        self.open, self.used = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, ids, total = rest.pop(0)
                self.open.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._close()


def even_cuts(sized: DataFrame, n: int) -> np.ndarray:
    """The upper bounds, but for the last, of n ranges of keys that are about even in the sum of sizes; sized: (k, size).

    FINE ranges of even row counts for each of them are weighed first, and whole ones are put together.
    """
    if n < 2:
        return np.zeros(0, np.int64)
    fine = sized.select(F.percentile_approx("k", [i / (FINE * n) for i in range(1, FINE * n)], 8 * FINE * n)).head()[0]
    fine = np.unique(np.array(fine or [], np.int64))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.searchsorted(fine, batch.column("k").to_numpy(), "left")
            sums = np.bincount(where, batch.column("size").to_numpy(), len(fine) + 1)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used].astype(np.int64))], names=["bin", "size"])

    sizes = np.zeros(len(fine) + 1)
    for r in sized.mapInArrow(bins, "bin int, size long").groupBy("bin").agg(F.sum("size").alias("size")).collect():  # a row for each fine range
        sizes[r["bin"]] = r["size"]
    total = np.cumsum(sizes)
    goals = total[-1] * np.arange(1, n) / n
    at = np.searchsorted(total, goals, "left")
    before = np.concatenate([[0.0], total])[at]
    at = at - (goals - before < total[at] - goals)  # the nearer end of the fine range that holds the goal
    return np.unique(fine[np.clip(at, 0, len(fine) - 1)]) if len(fine) else fine


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, group: str | None = None) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids][, group]) of every piece of every document.

    group: a text column; within each stretch of the curve, sequences are filled with one value of it after the other.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    n = width(spark)
    own = [F.col(f"`{group}`").cast("string").alias("own group")] if group else []
    rows = docs.select(key, F.coalesce(F.xxhash64(key), F.lit(0)).alias("h"), text, *own)
    z = [f"z{d}" for d in range(DIMS)]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(1), CHUNK):
                found = project(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.array(found[:, d]) for d in range(DIMS))], names=["h", "size", *z])

    sized = rows.select("h", text, (F.coalesce(F.octet_length(text), F.lit(0)) + PER_DOCUMENT).cast("long").alias("size"))
    drawn = staged(sized.mapInArrow(points, "h long, size long, " + ", ".join(f"{c} double" for c in z)), "points")
    stats = drawn.select(*(F.avg(c) for c in z), *(F.stddev_pop(c) for c in z)).head()
    middle, spread = (np.array([v or 0.0 for v in part]) for part in (stats[:DIMS], stats[DIMS:]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.stack([batch.column(c).to_numpy() for c in z], 1)
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(found, middle, spread, batch.column("h").to_numpy())), batch.column("size")], names=["k", "size"])

    cuts = even_cuts(staged(drawn.mapInArrow(keys, "k long, size long"), "keys"), n)  # staged, as a task with two Python steps holds two workers

    own_names = ["own group"] * len(own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(2), CHUNK):
                part = batch.slice(lo, hi - lo)
                k = curve_keys(project(data, at), middle, spread, part.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, k, "left").astype(np.int32)), pa.array(k), part.column(0), part.column(2), *(part.column(3) for _ in own_names)], names=["part", "k", "doc", "text", *own_names])

    dealt = rows.mapInArrow(place, f"part int, k long, doc {kind}, text string" + ", `own group` string" * len(own)).repartitionById(n, "part").sortWithinPartitions("part", *own_names, "k", "doc")
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids + [group] * len(own_names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = ByteTokenizer(tokenizer)
        encode = _loaded[tokenizer].encode
        packer, last = None, None

        def made(pieces: list[tuple], kind_: pa.DataType) -> pa.RecordBatch:
            arrays = [
                pa.array([p[0][0] for p in pieces], kind_),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([len(p[2]) for p in pieces], pa.int64()),
                pa.array([zlib.crc32(p[2]) for p in pieces], pa.int64()),
                pa.array([p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([p[5] for p in pieces], pa.int64()),
            ] + [pa.array([p[2].tolist() for p in pieces], pa.list_(pa.int32()))] * with_ids + [pa.array([p[0][1] for p in pieces], pa.string()) for _ in own_names]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        kind_ = pa.int64()
        for batch in batches:
            kind_ = batch.schema.field("doc").type
            for part, doc, body, *value in zip(*(batch.column(c).to_pylist() for c in ("part", "doc", "text", *own_names))):
                if part != last:
                    if packer:
                        packer.finish()
                        yield made(packer.pieces, kind_)
                    packer, last = Packer(part << 40), part
                ids = encode(body or "")
                ids.append(END)
                packer.add((doc, *value), np.array(ids, "<u4"))
                if len(packer.pieces) >= 5000:
                    yield made(packer.pieces, kind_)
                    packer.pieces = []
        if packer:
            packer.finish()
            yield made(packer.pieces, kind_)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids + f", `{group}` string" * len(own_names)
    return dealt.select("part", "doc", "text", *own_names).mapInArrow(pack, schema)
