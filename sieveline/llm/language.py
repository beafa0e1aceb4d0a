"""Language identification with a string kernel.

The kernel of two texts counts the hashed byte n-grams (2 to 4, A-Z in lower case) that both hold, over the root
of the product of their numbers (blended spectrum, presence only). Landmark texts give the Nyström map, and
one-versus-rest kernel ridge regression on it gives a value for each language; a batch of texts is scored by
two matrix products. The model is fitted on a sample of labelled rows whose size is bounded by SAMPLE;
every whole text is scored.

Defined results: a null text and a text without a letter are `und` with score 0, as is every text where nothing
can be learned; whole texts count, whatever their length; repeated rows are judged alike; an empty table gives an
empty table; only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import held_out, share_bound, spread, text_chunks
from sieveline.llm.words import LOWER

SIZES = (2, 3, 4)
BITS = 13
#: Labelled rows, over all languages, that the model is fitted on at most, and landmarks among them; one of each language at least.
SAMPLE, LANDMARKS = 3000, 160
RIDGE = 0.003
CHUNK = 1_500_000
UNKNOWN = "und"


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 0/1 matrix, texts by hashed n-grams."""
    n_docs = len(at) - 1
    out = np.zeros((n_docs, 1 << BITS), np.uint8)
    flat, low = out.reshape(-1), LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(n_docs, dtype=np.int64) << BITS, np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    gram = low
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            break
        gram = (gram[: len(data) - n + 1] << np.uint32(8)) | low[n - 1 :]
        if n in SIZES:
            fits = left[: len(gram)] >= n
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            flat[(row[: len(gram)] + (mixed >> np.uint32(32 - BITS)))[fits]] = 1
    return out


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """x: 0/1 matrix; landmarks: rows already divided by the roots of their sums."""
    x = x.astype(np.float32)
    return (x @ landmarks.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(x: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, landmarks as 0/1 rows, weights landmarks x languages)."""
    names = sorted(set(langs))
    label = np.array([names.index(v) for v in langs])
    each = max(1, LANDMARKS // len(names))
    chosen = np.sort(np.concatenate([np.flatnonzero(label == c)[:each] for c in range(len(names))]))
    marks = x[chosen]
    scaled = marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True, dtype=np.float32), 1))
    values, vectors = np.linalg.eigh(_kernel(marks, scaled).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # the Nyström map is kernel @ root
    phi = _kernel(x, scaled).astype(np.float64) @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(label, minlength=len(names))[label][:, None]  # languages weigh alike
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    gram = phi1.T @ (phi1 * weight) + RIDGE * np.eye(phi1.shape[1])
    solved = np.linalg.solve(gram, phi1.T @ (target * weight))
    return names, marks, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)


def _sample(docs: DataFrame, key: str, text: str, lang: str) -> tuple[np.ndarray, list[str]]:
    """Presence rows and labels of a sample of rows that are not held out, spread over the languages by a hash of the key."""
    learned = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    even = spread(key, 7)
    found = learned.groupBy(lang).agg(F.count("*"), F.min(even)).collect()  # a row for each language, as the model has
    if not found:
        return np.zeros((0, 1 << BITS), np.uint8), []
    each = max(1, SAMPLE // len(found))
    most = 2 * max(SAMPLE, len(found))
    # the hash is even over the keys, so each language gives about its share, and the row of its least hash at least
    bounds = docs.sparkSession.createDataFrame([(v, max(least, share_bound(each, n))) for v, n, least in found], "own_lang string, bound long")
    rows = learned.join(F.broadcast(bounds), F.col(lang) == F.col("own_lang")).where(even <= F.col("bound")).select(key, text, lang)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(1), CHUNK):
                bits = np.packbits(presence(data, at), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in bits], pa.binary())], names=["k", "lang", "bits"])

    kind = docs.schema[key].dataType.simpleString()
    got = sorted(rows.mapInArrow(features, f"k {kind}, lang string, bits binary").limit(most).collect(), key=lambda r: r.k)
    x = np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), -1)
    return np.unpackbits(x, axis=1), [r.lang for r in got]


def predict_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: bool = False) -> DataFrame:
    """(key, held_out, lang_pred, score) of every document; labels are learned from rows that are not held out.

    carry: instead, every column of docs with those after them; columns of the same names go.
    """
    x, langs = _sample(docs, key, text, lang)
    if langs:
        names, marks, weights = fit(x, langs)
        packed, n_marks = np.packbits(marks, axis=1), len(marks)
    else:
        names, packed, weights, n_marks = [], None, None, 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if n_marks:
            own = np.unpackbits(packed, axis=1).astype(np.float32)
            own /= np.sqrt(np.maximum(own.sum(1, keepdims=True), 1))
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(text), CHUNK):
                letters = np.zeros(len(data) + 1, np.int64)
                np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122), out=letters[1:])
                some = letters[at[1:]] > letters[at[:-1]]
                for i in np.flatnonzero(~some & (at[1:] > at[:-1])):
                    some[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode())
                best, value = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                if n_marks:
                    for a in range(0, hi - lo, 1024):
                        b = min(hi - lo, a + 1024)
                        found = _kernel(presence(data[at[a] : at[b]], at[a : b + 1] - at[a]), own) @ weights[:-1] + weights[-1]
                        best[a:b] = found.argmax(1)
                        value[a:b] = np.clip((found.max(1) + 1) / 2, 0, 1)
                known = some & bool(n_marks)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([names[k] if s else UNKNOWN for k, s in zip(best, known)], pa.string()), pa.array(np.where(known, value, 0.0))], names=[*others, "lang_pred", "score"])

    made = ("held_out", "lang_pred", "score")
    others = [c for c in docs.columns if c not in made] if carry else [key]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    read = docs.select(*others) if carry else docs.select(key, text)
    return read.mapInArrow(score, schema).select(*others, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "lang_pred", "score")
