"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its hashed terms: runs of letters and digits, A-Z in lower case, and the first bytes of each, so
that compounds of one stem share a term. Its logit is a bias, a weight
for each term and, for each pair of terms, the inner product of their factors, so that pairs such as an
insult with a group mention count beyond their parts. Weights learn by FTRL with an L1 penalty, which leaves
uninformative terms at nothing, so long clean texts gather no noise; factors learn by AdaGrad. Terms take part whose
share differs between the labels by more than chance (SIGNIFICANT standard errors) and, as long as a part of the sample
is judged wrongly, in turn those whose share does so among the texts with another term (any term, or a significant
one), or all terms of LEAST_DOCS texts: the choice that judges that part best is used. The part also
sets where the score crosses 0.7. The model is fitted on at most SAMPLE labelled rows; all texts are scored.

Defined results: null and empty texts have no terms and get the score of the bias; whole texts count, whatever their
length; repeated rows score alike; without both labels to learn from every score is 0; a null label is not
learned from, and of several labels of a document the largest counts; an empty table gives an empty table; only the
named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import held_out, share_bound, spread, text_chunks
from sieveline.llm.words import ALNUM, word_hashes

BITS = 18
FACTORS = 4
#: Labelled rows that the model is fitted on at most.
SAMPLE = 6000
EPOCHS, BATCH = 4, 64
LEAST_DOCS, SIGNIFICANT = 4, 4.0
#: Standard errors for a pair of any terms, and for one with a term that is significant by itself.
SIGNIFICANT_PAIR, SIGNIFICANT_AFTER = 6.0, 2.5
START = 1e-3
PREFIXES = (0, 4, 6)
THRESHOLD = 0.7
CHUNK = 2_000_000


def _in_pairs(terms: np.ndarray, sizes: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """A mask of the terms of pairs (left, right; masks): among the texts with the left term, the right one's share differs
    between the labels by more than `least` standard errors."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found = np.zeros(len(left), bool)

    def blocks(which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for own in np.array_split(np.flatnonzero(which), max(1, which.sum() // 512)):
            place = np.full(len(which), -1, np.int32)
            place[own] = np.arange(len(own))
            at = place[terms]
            x = np.zeros((len(sizes), len(own)), np.float32)
            x[doc[at >= 0], at[at >= 0]] = 1
            yield own, x

    rows = [np.flatnonzero(label == c) for c in (0, 1)]
    for a, x in blocks(left):
        for b, y in blocks(right):
            hits, n = [x[r].T @ y[r] for r in rows], [x[r].sum(0)[:, None] for r in rows]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = (hits[0] + hits[1]) / (n[0] + n[1])
                rough = 1 / n[0] + 1 / n[1]
                far = np.abs(hits[1] / n[1] - hits[0] / n[0]) - rough / 2 > least * np.sqrt(p * (1 - p) * rough)
            far &= (hits[0] + hits[1] >= LEAST_DOCS) & (a[:, None] != b[None, :])
            found[a[far.any(1)]] = found[b[far.any(0)]] = True
    return found


class FactorizationMachine:
    """Weights and factors of hashed terms, for sets of terms given as one index array and the sets' sizes."""

    def __init__(self, seed: int = 7):
        size = 1 << BITS
        self.bias, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, START, (size, FACTORS)).astype(np.float32)
        self.scale, self.middle = 1.0, 0.0

    @staticmethod
    def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
        np.cumsum(values, axis=0, out=total[1:])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def logits(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        v = self.v[terms]
        pairs = 0.5 * (self._sums(v, sizes) ** 2 - self._sums(v * v, sizes)).sum(1)
        return self.bias + self._sums(self.w[terms], sizes) + pairs

    def scores(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = self.scale * (self.logits(terms, sizes) - self.middle) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(at, -60, 60)))

    def fit(self, terms: np.ndarray, sizes: np.ndarray, label: np.ndarray, seed: int = 7) -> None:
        """Learn from all rows but each fifth, which chooses the terms and sets the threshold's place."""
        docs = [np.bincount(terms[np.repeat(label == c, sizes)], minlength=len(self.w)) for c in (0, 1)]
        n0, n1 = max(1, (label == 0).sum()), max(1, (label == 1).sum())
        both = (docs[0] + docs[1]) / (n0 + n1)
        error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n0 + 1 / n1))
        common = docs[0] + docs[1] >= LEAST_DOCS
        told = common & (np.abs(docs[1] / n1 - docs[0] / n0) > SIGNIFICANT * error)
        frequent = common & (docs[0] + docs[1] >= SIGNIFICANT_PAIR**2)  # rarer ones cannot reach it
        start, best = self.v.copy(), None
        for choice in (
            lambda: told,
            lambda: told | _in_pairs(terms, sizes, label, frequent, frequent, SIGNIFICANT_PAIR),
            lambda: told | _in_pairs(terms, sizes, label, told, common, SIGNIFICANT_AFTER),
            lambda: common,
        ):
            seen = choice()
            self.bias, self.w, self.v = 0.0, np.zeros_like(self.w), np.where(seen[:, None], start, 0)
            self._learn(terms, sizes, label, seen, seed)
            wrong = self._place(terms, sizes, label)
            if best is None or wrong < best[0]:
                best = (wrong, self.bias, self.w, self.v, self.middle, self.scale)
            if not best[0]:
                break
        _, self.bias, self.w, self.v, self.middle, self.scale = best

    def _learn(self, terms: np.ndarray, sizes: np.ndarray, label: np.ndarray, seen: np.ndarray, seed: int) -> None:
        """Weights and factors of the terms that are seen."""
        rng = np.random.default_rng(seed)
        start = np.cumsum(sizes) - sizes
        z, n = np.zeros(len(self.w)), np.zeros(len(self.w))
        gv = np.full(self.v.shape, 1e-4)
        rate, l1 = 0.2, 1.0
        learn = np.flatnonzero(np.arange(len(sizes)) % 5 != 4)
        heavier = min(5.0, max(1.0, (label[learn] == 0).sum() / max(1, (label[learn] == 1).sum()) / 2))
        for _ in range(EPOCHS):
            rng.shuffle(learn)
            for lo in range(0, len(learn), BATCH):
                rows = learn[lo : lo + BATCH]
                own = [terms[start[r] : start[r] + sizes[r]] for r in rows]
                own = [x[seen[x]] for x in own]
                count = np.array([len(x) for x in own])
                idx = np.concatenate(own)
                p = 1 / (1 + np.exp(-np.clip(self.logits(idx, count), -30, 30)))
                g = (p - label[rows]) * np.where(label[rows] == 1, heavier, 1.0)
                self.bias -= 0.3 * g.mean()
                each = np.repeat(g, count)
                unique, place = np.unique(idx, return_inverse=True)
                gw = np.bincount(place, each, len(unique))
                step = (np.sqrt(n[unique] + gw * gw) - np.sqrt(n[unique])) / rate
                z[unique] += gw - step * self.w[unique]
                n[unique] += gw * gw
                self.w[unique] = np.where(np.abs(z[unique]) <= l1, 0, -(z[unique] - np.sign(z[unique]) * l1) / ((1 + np.sqrt(n[unique])) / rate))
                v = self.v[idx]
                toward = each[:, None] * (np.repeat(self._sums(v, count), count, axis=0) - v)
                grad = np.stack([np.bincount(place, toward[:, k], len(unique)) for k in range(FACTORS)], 1) + 1e-3 * self.v[unique]
                gv[unique] += grad * grad
                self.v[unique] -= (0.02 * grad / np.sqrt(gv[unique])).astype(np.float32)

    def _place(self, terms: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> int:
        """Sets the threshold's place on each fifth row; the number of those rows that are then judged wrongly."""
        start = np.cumsum(sizes) - sizes
        held = np.arange(len(sizes)) % 5 == 4
        if len(set(label[held])) < 2:
            held[:] = True
        values = np.concatenate([self.logits(terms[start[r] : start[r] + sizes[r]], sizes[r : r + 1]) for r in np.flatnonzero(held)])
        good, bad = np.sort(values[label[held] == 0]), np.sort(values[label[held] == 1])
        cuts = np.unique(np.concatenate([good, bad]))
        cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
        wrong = (len(good) - np.searchsorted(good, cuts)) + np.searchsorted(bad, cuts)
        least = np.flatnonzero(wrong == wrong.min())
        self.middle = float(cuts[least].mean()) if len(least) > 1 else float(cuts[least[0]])
        spread = np.median(bad) - np.median(good)
        self.scale = float(np.clip(8 / max(spread, 1e-6), 0.1, 50))
        return int(wrong.min())

    def active(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero((self.w != 0) | self.v.any(1)).astype(np.int32)
        return at, self.w[at], self.v[at]


def _terms(data: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, each once a text, in order; their number in each text); keep: a mask of the terms that matter."""
    found = []
    for prefix in PREFIXES:
        hashes, counts = word_hashes(data, at, ALNUM, prefix)
        terms = ((hashes + np.uint64(prefix << 60)) >> np.uint64(64 - BITS)).astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        if keep is not None:
            doc, terms = doc[keep[terms]], terms[keep[terms]]
        found.append((doc << BITS) | terms)
    both = np.unique(np.concatenate(found))
    return both & ((1 << BITS) - 1), np.bincount(both >> BITS, minlength=len(counts))


def _packed(terms: np.ndarray) -> bytes:
    """A term set in no more bytes than a bit for each possible term takes, so the whole sample is of bounded size."""
    if len(terms) < 1 << (BITS - 5):
        return terms.tobytes()
    bits = np.zeros(1 << BITS, np.uint8)
    bits[terms] = 1
    return np.packbits(bits).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32) if len(raw) < 1 << (BITS - 3) else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32)


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term sets and labels of a sample of the labelled rows that are not held out: half of it each label if there are so many."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    even = spread(key, 11)
    found = {r[0]: r[1:] for r in known.groupBy("y").agg(F.count("*"), F.min(even)).collect()}
    if len(found) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rare = min(SAMPLE // 2, found[1][0])
    bound = {c: max(found[c][1], share_bound(part, found[c][0])) for c, part in ((1, rare), (0, SAMPLE - rare))}
    # about SAMPLE rows of a key and a label, and one of each at least; the limit proves the bound, so the texts need no shuffle
    chosen = known.where(even <= F.when(F.col("y") == 1, bound[1]).otherwise(bound[0])).limit(2 * SAMPLE)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(key, text, "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(1), CHUNK):
                terms, sizes = _terms(data, at)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                raw = terms.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([_packed(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())], names=["k", "y", "terms"])

    kind = docs.schema[key].dataType.simpleString()
    got = sorted(rows.mapInArrow(features, f"k {kind}, y int, terms binary").limit(2 * SAMPLE).collect(), key=lambda r: (r.k, r.y))
    sets = [_unpacked(bytes(r.terms)) for r in got]
    return np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64), np.array([len(s) for s in sets], np.int64), np.array([r.y for r in got], np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of every document; labels: (key, 0 or 1), of which held-out rows are not used."""
    terms, sizes, y = _sample(docs, labels, key, text, label)
    model = None
    if len(set(y.tolist())) == 2:
        fitted = FactorizationMachine()
        fitted.fit(terms, sizes, y)
        model = (fitted.bias, fitted.scale, fitted.middle, *fitted.active())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            own = FactorizationMachine.__new__(FactorizationMachine)
            own.bias, own.scale, own.middle, at_, w, v = model
            own.w, own.v = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32)
            own.w[at_], own.v[at_] = w, v
            keep = (own.w != 0) | own.v.any(1)
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(1), CHUNK):
                found = own.scores(*_terms(data, at, keep)) if model else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found)], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(key, text).mapInArrow(score, f"`{key}` {kind}, score double")
    return scored.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
