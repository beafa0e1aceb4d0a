"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Documents are sets of five-word shingles; two are linked if their Jaccard similarity reaches the threshold, and
components of links are the groups. Equal sets first collapse to the one with the smallest id. 32 bands of four
MinHash values propose candidates (a pair at 0.75 shares no band with a probability under 1e-5). Signatures are compared
in batches of 32 values: after each batch the pair goes if the posterior probability (uniform prior) that its
similarity reaches the threshold is under MISS. What survives is verified on the full sets.

Candidates are handled in two passes, so that no group emits all its pairs (see linking). In the first, each bucket links its
members to its smallest document. In the second, only buckets whose members are still in different components remain; their
documents are dealt in pairs of blocks, and each task compares the pairs of its two blocks that lie in different components,
each pair at the first band that it shares. So every candidate pair is either compared or already connected.

Defined results: null and empty texts and texts without words have an empty set and link with nothing; a null key
gets no component and is kept; whole texts count; repeated rows fall into one component; an empty table
gives an empty table; only the key and the text are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import heavy_join, staged, text_chunks
from sieveline.llm.graph import connected_components
from sieveline.llm.linking import across, binary_rows, head_pairs, headed, spanning
from sieveline.llm.shingles import shingle_sets
from sieveline.operators.blooms import semi_join

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
#: Probability at which a batch may lose a pair that reaches the threshold.
MISS = 1e-6
CHUNK = 1_500_000
#: Members of a block that are compared with those of another, and pairs whose signatures are compared at once.
MEMBERS, PAIRS = 512, 100_000
_rng = np.random.default_rng(20240229)
FACTOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of 64-bit hashes."""
    found = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(17)).astype(np.uint32)
    for k in range(0, len(low), 256):
        np.minimum(found, (low[k : k + 256, None] * FACTOR + SHIFT).min(0), out=found)
    return found


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """By batch: the fewest matches among the values so far at which a pair stays.

    With m of n values equal, P(similarity >= t) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i of left, j of right) that no batch prunes."""
    kept = []
    for lo in range(0, len(i), 100_000):
        a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
        matches = np.zeros(len(a), np.int64)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += (left[a, part] == right[b, part]).sum(1)
            stay = matches >= need
            a, b, matches = a[stay], b[stay], matches[stay]
        kept.append((a, b))
    return tuple(np.concatenate([k[c] for k in kept]) if kept else np.zeros(0, np.int64) for c in (0, 1))


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """By pair of signature rows: the first band in which they agree, or BANDS."""
    same = (left == right).reshape(len(left), BANDS, ROWS).all(2)
    return np.where(same.any(1), same.argmax(1), BANDS)


def linked(a: np.ndarray, b: np.ndarray, hundredths: int) -> bool:
    """Whether the similarity of two sorted sets of hashes reaches hundredths / 100."""
    if 100 * min(len(a), len(b)) < hundredths * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= hundredths * (len(a) + len(b) - both)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, set_key, sig): the size, a 128-bit key and the MinHash signature of each document's set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(1), CHUNK):
                shingles, sizes = shingle_sets(data, at)
                ends = np.cumsum(sizes)
                sets = [shingles[e - n : e] for e, n in zip(ends, sizes)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n_shingles", "set_key", "sig"])

    return docs.select(key, text).mapInArrow(sketch, f"id {docs.schema[key].dataType.simpleString()}, n_shingles long, set_key binary, sig binary")


def full_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, shingles): each document's sorted set as 64-bit words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(1), CHUNK):
                shingles, sizes = shingle_sets(data, at)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([shingles[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], names=["id", "shingles"])

    return docs.select(key, text).mapInArrow(make, f"id {docs.schema[key].dataType.simpleString()}, shingles binary")


def near_duplicate_links(docs: DataFrame, reps: DataFrame, key: str, text: str, hundredths: int = 75) -> DataFrame:
    """Links (a, b) between documents of different sets whose components are those of all links; reps: (id, sig)."""
    kind = docs.schema[key].dataType.simpleString()
    least = least_matches(hundredths / 100)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    members = staged(headed(reps.select(F.posexplode(bands).alias("band", "bucket"), "id")), "members")
    candidates = staged(members.select("id").distinct(), "candidates")
    # texts of documents that share no bucket are not shuffled
    sets = staged(full_sets(semi_join(docs.select(key, text), candidates.withColumnRenamed("id", key), [key]), key, text), "sets")
    sigs = staged(semi_join(reps, candidates, ["id"]), "sigs")

    def side(df: DataFrame, end: str, own: str) -> DataFrame:
        return df.select(F.col("id").alias(end), F.col(own).alias(f"{own}_{end}"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.stack(binary_rows(batch.column(c), np.uint32)) for c in ("sig_a", "sig_b"))
                rows = np.arange(len(left))
                yield batch.select(["a", "b"]).take(pa.array(survivors(left, right, rows, rows, least)[0]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = binary_rows(batch.column("shingles_a"), np.uint64), binary_rows(batch.column("shingles_b"), np.uint64)
            yield batch.select(["a", "b"]).filter(pa.array([linked(x, y, hundredths) for x, y in zip(left, right)], pa.bool_()))

    pairs = head_pairs(members)
    for table, own, check in ((sigs, "sig", prune), (sets, "shingles", lambda batches: spanning(verify(batches)))):
        both = pairs.join(side(table, "a", own), "a").join(side(table, "b", own), "b")
        pairs = staged(both.select("a", "b", f"{own}_a", f"{own}_b").mapInArrow(check, f"a {kind}, b {kind}"), "pairs")

    def sift(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that signatures leave, each in the first band that it shares."""
        sig = np.stack(binary_rows(rows.column("sig"), np.uint32))
        parts = [survivors(sig, sig, i[lo : lo + PAIRS], j[lo : lo + PAIRS], least) for lo in range(0, len(i), PAIRS)]
        i, j = (np.concatenate([p[k] for p in parts]) for k in (0, 1)) if parts else (i, j)
        own = first_shared(sig[i], sig[j]) == rows.column("band").to_numpy()[i]
        return i[own], j[own]

    def compare(rows: pa.Table, i: np.ndarray, j: np.ndarray, found) -> None:
        whole: dict[int, np.ndarray] = {}
        words = rows.column("shingles")
        i, j = sift(rows, i, j)
        for x, y in zip(i.tolist(), j.tolist()):
            if not found.same(x, y):
                for k in (x, y):
                    if k not in whole:
                        whole[k] = np.frombuffer(words[k].as_py(), np.uint64)
                if linked(whole[x], whole[y], hundredths):
                    found.put(x, y)

    more = across(members, pairs, sets, compare, sift=sift, light=sigs, block=MEMBERS)
    return staged(pairs.unionByName(more).distinct(), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hundredths: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document; a component's smallest key is its id, and is kept."""
    drawn = staged(sketches(docs, key, text), "sketches")
    linking = F.col("set_key").isNotNull() & F.col("id").isNotNull()
    firsts = staged(drawn.where(linking).groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "firsts")
    reps = drawn.select("id", "sig").join(firsts.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    links = near_duplicate_links(docs, staged(reps, "reps"), key, text, hundredths)
    component = connected_components(links).select(F.col("node").alias("rep"), "component")
    found = staged(firsts.join(component, "rep", "left").select("set_key", "n", F.coalesce("component", "rep").alias("component_id")), "found")
    grouped = heavy_join(drawn.where(linking).select("set_key", "id", "n_shingles"), found, "set_key").select("id", "n_shingles", "component_id")
    alone = drawn.where(~linking).select("id", "n_shingles", F.col("id").alias("component_id"))  # no set or no id: their own groups
    return grouped.unionByName(alone).select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
