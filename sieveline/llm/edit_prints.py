"""Document fingerprints by a randomised edit embedding.

A walk reads a text: at step j it writes the character under its pointer and moves on or stays, as a random bit shared by
all documents says for that step and character. Two walks over texts that differ by an edit soon meet again, so edit
distance becomes Hamming distance of what the walks write (Chakraborty, Goldenberg, Koucky 2016). The walk goes on until
the text is used up. Each of SLOTS slots samples the written string at the position whose random priority is the least
among all that were written, so texts of like length sample like positions, and keeps 8 bits of the WRITTEN
characters from there on. The likeness of two fingerprints is the share of equal slots, less what chance makes equal.

Near documents: two fingerprints are near at a likeness of LIKE or more. Bands of sampled slots propose pairs, and the whole fingerprints verify
them. Of the pairs that brute force over likeness finds in 6,000 documents of the test tables, bands propose 0.945 (0.89 at a likeness of 0.3,
0.59 at 0.2, which is why LIKE is not lower). Of 150 pairs 3, 10 and 20 edits apart, 0.96, 0.92 and 0.73 share a band at 450 characters, 0.99, 0.93 and
0.81 at 1,450, and 0.99, 0.98 and 0.93 at 5,700; most of the others are less alike than LIKE. The components of such links are the groups; every pair that shares
a band is compared or already connected (see linking). near_links goes on to edit distance itself.

Defined results: null and empty texts have length 0 and the fingerprint of nothing, and are near nothing but each other; whole
texts are walked; equal texts have equal fingerprints; the next document is the one with the next smaller key (equal keys by
text), after the last the first, so a lone document is its own next; null keys come last and belong to no group; keys are
long or int; an empty table gives an empty table; only the key and the text are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from sieveline.llm.common import heavy_join, splitmix, staged, width
from sieveline.llm.graph import connected_components
from sieveline.llm.linking import across, binary_rows, head_pairs, headed, least_pairs, spanning

SLOTS = 64
CHARS = 2_000_000
PERIOD = 1 << 14
_rng = np.random.default_rng(16_2016)
MOVES = _rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
SALT = _rng.integers(1, 1 << 62, SLOTS, dtype=np.uint64) | np.uint64(1)
REST = np.zeros(16, np.uint8)
#: Bands and their slots for finding near pairs.
BANDS, WIDTH = 21, 3
#: Written characters of a slot: some five of the text, so that unrelated texts agree by chance alone.
WRITTEN = 8
#: Likeness at which fingerprints are near, as low as the bands find with a recall of over 0.9; of unrelated texts of one language, one pair in a thousand reaches 0.06.
LIKE = 0.35
#: With so few walks left, each is walked by itself: a batch step costs as much as some fifty steps of one walk.
FEW = 40
#: Characters of a gram, for the pairs that no band finds.
GRAM = 12


def _records() -> list[np.ndarray]:
    """By slot: the positions whose priority is less than all before. After one at j, the next is past x with probability j / x."""
    out = []
    for k in range(SLOTS):
        rng, at = np.random.default_rng([5, k]), [0]
        while at[-1] < 1 << 45:
            at.append(int((at[-1] + 1) / (1 - rng.random())))
            if at[-1] <= at[-2]:
                at[-1] = at[-2] + 1
        out.append(np.array(at))
    return out


RECORDS = _records()


def embed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what the walks write, where each walk's part starts, how long it is); texts: character classes from 1 to 255."""
    n = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n, kind="stable")
    # walks are looked at after each 16 steps, so that each text is followed by room to run out in
    total = np.concatenate([x for i in order for x in (texts[i], REST)] or [REST])
    at = np.cumsum(n[order] + len(REST)) - n[order] - len(REST)
    last = at + n[order]
    room = 2 * n[order] + 8 * np.sqrt(n[order]).astype(np.int64) + 64
    base = np.cumsum(room) - room
    out = np.zeros(int(room.sum()) + 4, np.uint8)
    length = np.zeros(len(texts), np.int64)
    live = int((n > 0).sum())
    walker = np.arange(live)
    pos, stop, to, full = at[:live].copy(), last[:live].copy(), base[:live].copy(), room[:live].copy()
    alone: list[tuple[int, int, int]] = []  # walks that go on by themselves: (walk, position, steps)
    j = 0
    while len(walker) > FEW:
        moves = MOVES[j & (PERIOD - 1)]
        c = total[pos]
        out[to] = c
        pos += moves[c]
        to += 1
        j += 1
        if j & 15 == 0:
            done, tight = pos >= stop, full - j < 16
            if done.any() or tight.any():
                length[walker[done]] = j
                alone += [(int(w), int(p), j) for w, p in zip(walker[tight & ~done], pos[tight & ~done])]
                keep = ~(done | tight)
                walker, pos, stop, to, full = walker[keep], pos[keep], stop[keep], to[keep], full[keep]
    alone += [(int(w), int(p), j) for w, p in zip(walker, pos)]
    more, size = [out], len(out)
    for w, p, steps in alone:
        a, b = int(at[w]), int(last[w])
        rest = _walk(total[p : b + len(REST)].tobytes(), b - p, steps)
        own = np.concatenate([out[base[w] : base[w] + steps], np.frombuffer(rest, np.uint8), REST])
        base[w], length[w] = size, steps + len(rest)
        more.append(own)
        size += len(own)
    back = np.empty(len(texts), np.int64)
    back[order] = np.arange(len(texts))
    return np.concatenate(more), base[back], length[back]


def _walk(text: bytes, stop: int, steps: int) -> bytearray:
    """What one walk writes from here on; steps: how many it has made, a multiple of 16."""
    if not _steps:
        rows = [bytes(r) for r in MOVES]
        _steps.extend(tuple(rows[k : k + 16]) for k in range(0, PERIOD, 16))
    out, pos, k = bytearray(), 0, (steps >> 4) % len(_steps)
    put = out.append
    while pos < stop:
        for row in _steps[k]:
            c = text[pos]
            put(c)
            pos += row[c]
        k += 1
        if k == len(_steps):
            k = 0
    return out


_steps: list[tuple[bytes, ...]] = []


def fingerprints(texts: list[np.ndarray]) -> np.ndarray:
    """A row of SLOTS bytes for each text."""
    out, base, length = embed(texts)
    found = np.zeros((len(texts), SLOTS), np.uint8)
    some = np.flatnonzero(length > 0)
    with np.errstate(over="ignore"):
        for k in range(SLOTS):
            step = RECORDS[k][np.searchsorted(RECORDS[k], length[some], "left") - 1]
            gram = np.full(len(some), SALT[k])
            for i in range(WRITTEN):  # what stands behind the end of a walk counts as nothing
                seen = np.where(step + i < length[some], out[base[some] + np.minimum(step + i, length[some] - 1)], 0)
                gram = (gram ^ seen.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                gram ^= gram >> np.uint64(29)
            found[some, k] = gram >> np.uint64(56)
    return found


def classes(text: str) -> np.ndarray:
    """The characters of a text as classes from 1 to 255."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (((code * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a == b).mean(1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)


def with_next(docs: DataFrame, key: str, text: str, near: DataFrame) -> DataFrame:
    """(part, halo, id, near_id, text), dealt by ranges of falling keys and sorted; the last row of a part is a halo: the document after the part.

    near: (id, near_id), whose rows are dealt alike and stand before the documents of their key (halo is -1), so that texts need no join.
    """
    spark = docs.sparkSession
    n = width(spark)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).head()[0] if n > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part(k: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, k.to_numpy(), "left"), dtype="int32")

    dealt = rows.withColumn("part", part("k"))
    heads = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.max("k")).collect())  # a row for each part
    before = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]
    halo = spark.createDataFrame(before or [(0, -1)], "k long, part int")
    none = F.lit(None).cast(docs.schema[key].dataType)
    beside = near.withColumns({"k": F.col("id").cast("long"), "text": F.lit("")}).withColumn("part", part("k"))
    return (
        dealt.select("part", F.lit(0).alias("halo"), "id", "k", none.alias("near_id"), "text")
        .unionByName(rows.join(F.broadcast(halo), "k").select("part", F.lit(1).alias("halo"), "id", "k", none.alias("near_id"), "text"))
        .unionByName(beside.select("part", F.lit(-1).alias("halo"), "id", "k", "near_id", "text"))
        .repartitionById(n, "part")
        .sortWithinPartitions("part", F.col("halo") == 1, F.desc("k"), "halo", "text")
    )


def near_groups(prints: DataFrame) -> DataFrame:
    """(id, near_id) of documents in groups of near fingerprints; prints: (id, fingerprint as bytes), staged. near_id is a group's smallest id.

    Equal fingerprints collapse to their smallest id first, so that copies make no pairs.
    """
    kind = prints.schema["id"].dataType.simpleString()
    known = prints.where("id is not null").withColumn("h", F.md5("fingerprint"))
    firsts = staged(known.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("fingerprint").alias("fingerprint")), "firsts")
    reps = firsts.select(F.col("rep").alias("id"), "fingerprint")
    members = staged(headed(reps.select("id", F.explode(bands("fingerprint")).alias("bucket"))), "members")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack(binary_rows(batch.column(c), np.uint8)) for c in ("fa", "fb"))
                yield batch.select(["a", "b"]).filter(pa.array(likeness(a, b) >= LIKE))

    def compare(rows: pa.Table, i: np.ndarray, j: np.ndarray, found) -> None:
        own = np.stack(binary_rows(rows.column("fingerprint"), np.uint8))
        for lo in range(0, len(i), 100_000):
            a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
            near = likeness(own[a], own[b]) >= LIKE
            for x, y in zip(a[near].tolist(), b[near].tolist()):
                if not found.same(x, y):
                    found.put(x, y)

    pairs = least_pairs(members)  # copies share most buckets, so this connects most of them; the rest is compared within buckets
    both = pairs.join(reps.toDF("a", "fa"), "a").join(reps.toDF("b", "fb"), "b")
    first = staged(both.select("a", "b", "fa", "fb").mapInArrow(lambda batches: spanning(verify(batches)), f"a {kind}, b {kind}"), "links")
    links = first.unionByName(staged(across(members, first, reps, compare, heads_done=False), "links"))
    component = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("near_id"))
    grouped = firsts.join(component, "rep", "left").where("n > 1 or near_id is not null").select("h", "n", F.coalesce("near_id", "rep").alias("near_id"))
    return heavy_join(known.select("id", "h"), staged(grouped, "groups"), "h").select("id", "near_id")


def bands(fingerprint: str) -> "F.Column":
    """The bucket of each band: slots sampled once for all documents."""
    places = np.random.default_rng(3).permutation(SLOTS)[: BANDS * WIDTH].reshape(BANDS, WIDTH)
    return F.array(*(F.xxhash64(F.lit(i), *(F.substring(fingerprint, int(p + 1), 1) for p in row)) for i, row in enumerate(places)))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_id) of every document.

    The edited text is the document with its last half replaced by the start of the next document; near_id is the smallest
    key of the document's group of near documents, its own if it is alone.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id"]
    ids_type = {"bigint": pa.int64(), "int": pa.int32()}.get(docs.schema[key].dataType.simpleString())
    if ids_type is None:
        raise ValueError(f"{key}: keys must be long or int")
    prints = staged(plain_fingerprints(docs, key, text, raw=True).withColumnRenamed(key, "id"), "prints")
    near = staged(near_groups(prints), "near")

    def judge(ids: list, texts: list[str], groups: dict) -> pa.RecordBatch:
        """A row for each text but the last, which is the next of the one before it."""
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
        prints = fingerprints([classes(t) for t in [*texts, *edited]])
        own, new = prints[: len(texts)], prints[len(texts) :]
        arrays = [
            pa.array(ids, ids_type),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([p.tobytes().hex() for p in own[:-1]]),
            pa.array([p.tobytes().hex() for p in new]),
            pa.array(likeness(own[:-1], new)),
            pa.array(likeness(own[:-1], own[1:])),
            pa.array([groups.get(i, i) for i in ids], ids_type),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        groups: dict = {}
        held = 0
        part, done = None, False
        for batch in batches:
            for p, h, i, g, t in zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "id", "near_id", "text"))):
                if p != part:  # an earlier part ended with its halo
                    ids, texts, groups, held, part, done = [], [], {}, 0, p, False
                if h < 0:
                    groups[i] = g
                    continue
                if done:
                    continue
                texts.append(t)
                held += len(t)
                if h:
                    done = True
                else:
                    ids.append(i)
                if (h or held > CHARS) and len(texts) > 1:
                    n = len(texts) - 1
                    yield judge(ids[:n], texts, groups)
                    groups = {k: groups[k] for k in ids[n - 1 :] if k in groups}  # repeated keys may go on
                    ids, texts, held = ids[n:], texts[-1:], len(texts[-1])

    schema = f"`{key}` {{0}}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id {{0}}".format(docs.schema[key].dataType.simpleString())
    return with_next(docs, key, text, near).select("part", "halo", "id", "near_id", "text").mapInArrow(run, schema)


def plain_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", raw: bool = False) -> DataFrame:
    """(key, fingerprint) of every document; raw: as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= CHARS):
                    held += len(texts[hi])
                    hi += 1
                found = [p.tobytes() for p in fingerprints([classes(t) for t in texts[lo:hi]])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found if raw else [f.hex() for f in found])], names=[key, "fingerprint"])
                lo = hi

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint {'binary' if raw else 'string'}")


def grams(text: str, distance: int) -> tuple[np.ndarray, bool]:
    """(the least GRAM * distance + 1 hashes of runs of GRAM characters, whether the text has no more than GRAM * distance).

    An edit changes at most GRAM runs, so texts within the distance share the least hash of what both hold, unless both have few.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(code) - GRAM + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n]
    found = np.unique(splitmix(mixed))
    return found[: GRAM * distance + 1], len(found) <= GRAM * distance


def within(a: str, b: str, distance: int) -> int:
    """The edit distance of two texts, or -1 if it exceeds the distance: by diagonals, the farthest row that e edits reach."""
    n, m, none = len(a), len(b), -9
    before = [none] * (2 * distance + 3)
    for e in range(distance + 1):
        now = [none] * (2 * distance + 3)
        for k in range(-e, e + 1):
            at = k + distance + 1
            i = min(0 if e == 0 else max(before[at] + 1, before[at - 1], before[at + 1] + 1), n, m - k)
            if i < 0 or i + k < 0:
                continue
            w, grow = 8, True
            while w:
                t = min(w, n - i, m - i - k)
                if t and a[i : i + t] == b[i + k : i + k + t]:
                    i += t
                else:
                    grow = False
                w = w * 2 if grow else w // 2
            if i == n and i + k == m:
                return e
            now[at] = i
        before = now
    return -1


def gram_buckets(one: DataFrame, distance: int) -> DataFrame:
    """(bucket, id): texts of like length that share one of their least grams, and those of like length with few grams."""
    cell = 8 * (distance + 1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            with np.errstate(over="ignore"):
                for t in batch.column(1).to_pylist():
                    found, few = grams(t, distance)
                    found = np.append(found, np.uint64(0)) if few else found
                    cells = np.unique([len(t) // cell, (len(t) + distance) // cell]).astype(np.uint64)
                    out.append(np.concatenate([splitmix(found + splitmix(c + np.uint64(1))) for c in cells]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "buckets"])

    kind = one.schema["id"].dataType.simpleString()
    return one.select("id", "text").mapInArrow(make, f"id {kind}, buckets array<long>").select(F.explode("buckets").alias("bucket"), "id").distinct()


def across_links(one: DataFrame, first: DataFrame, distance: int) -> DataFrame:
    """Links (a, b, distance) that join components of the links `first`: every near pair of `one` is then linked or connected."""

    def compare(rows: pa.Table, i: np.ndarray, j: np.ndarray, found) -> None:
        texts = rows.column("text").to_pylist()
        # characters of each of 64 kinds: an edit changes two counts at most, by one each
        seen = np.stack([np.bincount(classes(t) & 63, minlength=64) for t in texts]).astype(np.int32)
        for lo in range(0, len(i), 100_000):
            a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
            may = np.abs(seen[a] - seen[b]).sum(1) <= 2 * distance
            for x, y in zip(a[may].tolist(), b[may].tolist()):
                if not found.same(x, y) and (far := within(texts[x], texts[y], distance)) >= 0:
                    found.put(x, y, far)

    compare.extra = [T.StructField("distance", T.IntegerType())]
    return across(headed(staged(gram_buckets(one, distance), "grams")), first, one.select("id", "text"), compare, heads_done=False)


def near_links(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 20) -> DataFrame:
    """(a, b, distance): links within an edit distance, whose components are those of all pairs within it.

    Bands of sampled slots propose, each bucket links to its smallest key instead of emitting all pairs, and the edit
    distance verifies. As bands miss pairs, and a bucket's smallest key stands for not all of it, the members of gram
    buckets that are then still unconnected are compared exactly. Equal texts collapse to their smallest key first. Null keys
    link with nothing, null texts are empty, repeated rows give no links of their own, an empty table gives none.
    """
    one = docs.where(F.col(key).isNotNull()).groupBy(F.coalesce(F.col(text), F.lit("")).alias("text")).agg(F.min(key).alias("id"))
    one = staged(one, "texts")
    drawn = staged(plain_fingerprints(one, "id", "text", raw=True), "prints")
    pairs = head_pairs(headed(drawn.select("id", F.explode(bands("fingerprint")).alias("bucket"))))
    texts = one.select("id", "text")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    first = staged(both.select("a", "b", F.levenshtein("ta", "tb", distance).alias("distance")).where("distance >= 0"), "links")
    return first.unionByName(staged(across_links(one, first, distance), "links")).distinct()
