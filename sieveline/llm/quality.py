"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains on a document. Expectation-maximisation over the counts of all
documents' vote patterns estimates how accurate each rule is and how many documents are good, and the posterior probability
of good quality under these accuracies decides, instead of a demand that all rules pass. No accuracy is set by hand: the
only inputs are the votes and the start, in which objections count against a document. Rules overlap on purpose (junk of one
kind draws several objections), as agreement is what tells a rule's accuracy. There are at most 3^rules
patterns, so what reaches the driver has a fixed bound.

Defined results: words are runs of bytes other than space and \\t\\n\\v\\f\\r; null and empty texts have no words and
fail the base rules; whole texts are counted, whatever their length; repeated rows are judged alike; an empty
table gives an empty table; only the key and the text are read, so extra columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import staged, text_chunks
from sieveline.llm.words import ALNUM

CHUNK = 2_000_000
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
#: What ends a sentence, in several scripts.
ENDS = tuple(c.encode() for c in ".!?。！？؟।።…")
#: How likely good quality is held at the start, by objections (none, one, several).
FIRST_GUESS = (0.95, 0.5, 0.1)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words", "n_ends", "n_wide", "n_exclaims", "n_symbol_runs", "n_bare", "n_stutters")


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """By document: how many words lie in a window of five words that its text holds at least twice.

    A 64-bit key finds the windows that may repeat; those are then compared in full.
    """
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        key = doc[:n].astype(np.uint64)
        for k in range(WINDOW):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
    start = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    key = key[start]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    may = start[order[again]]
    if not len(may):
        return np.zeros(n_docs, np.int64)
    rows = np.stack([doc[may], *(ids[may + k] for k in range(WINDOW))])
    order = np.lexsort(rows)
    same = (rows[:, order[1:]] == rows[:, order[:-1]]).all(0)
    hit = np.zeros(len(may), bool)
    hit[1:] |= same
    hit[:-1] |= same
    edge = np.zeros(len(ids) + 1, np.int64)
    first = may[order[hit]]
    np.add.at(edge, first, 1)
    np.add.at(edge, first + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def _three(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where three marked bytes of one text begin."""
    out = np.zeros(len(mask), bool)
    if len(mask) > 2:
        out[:-2] = mask[:-2] & mask[1:-1] & mask[2:]
        for back in (1, 2):
            out[at[1:-1][at[1:-1] >= back] - back] = False
    return out


def _bare_words(data: np.ndarray, at: np.ndarray, space: np.ndarray) -> np.ndarray:
    """By text: words without a letter, digit or character beyond ASCII."""
    n = len(data)
    if not n:
        return np.zeros(len(at) - 1, np.int64)
    first = ~space
    first[1:] &= space[:-1]
    starts_text = at[:-1][at[:-1] < at[1:]]
    first[starts_text] = ~space[starts_text]
    start = np.flatnonzero(first)
    sound = np.zeros(n + 1, np.int64)
    np.cumsum(ALNUM[data], out=sound[1:])
    bare = sound[np.append(start[1:], n)] == sound[start]  # between words there are only spaces
    edge = np.searchsorted(start, at)
    total = np.concatenate([[0], np.cumsum(bare)])
    return total[edge[1:]] - total[edge[:-1]]


def count_chunk(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    n_docs, raw = len(at) - 1, data.tobytes()

    def total(mask: np.ndarray) -> np.ndarray:
        ends = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=ends[1:])
        return ends[at[1:]] - ends[at[:-1]]

    space = SPACES[data]
    out = {
        "word_chars": total(~space & ((data & 0xC0) != 0x80)),
        "n_symbols": total(SYMBOLS[data]),
        "n_upper": total((data >= 65) & (data <= 90)),
        "n_letters": total(((data | 32) >= 97) & ((data | 32) <= 122)),
        "n_wide": total(data >= 0xE0),
        "n_exclaims": total(data == 33),
        "n_symbol_runs": total(_three(SYMBOLS[data], at)),
        "n_bare": _bare_words(data, at, space),
    }
    numbers, ids, sizes = _Numbers(), [], np.zeros(n_docs, np.int64)
    for name in ("n_dup_lines", "n_lines", "n_distinct_words", "n_ends"):
        out[name] = np.zeros(n_docs, np.int64)
    for i in range(n_docs):
        text = raw[at[i] : at[i + 1]]
        words = text.split()
        sizes[i] = len(words)
        ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_distinct_words"][i] = len(set(words))
        out["n_ends"][i] = sum(map(text.count, ENDS))
    out["n_words"] = sizes
    ids, doc = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.repeat(np.arange(n_docs), sizes)
    out["n_repeat_words"] = repeated_words(ids, doc, n_docs)
    again = np.flatnonzero((ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])) + 1
    out["n_stutters"] = np.bincount(doc[again], minlength=n_docs)
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """The key and the counts of every whole text; carry: every column of docs instead of the key, those named like a count left out.

    Null and empty texts count nothing; repeated rows are counted alike; an empty table gives an empty table.
    """
    others = [c for c in docs.columns if c not in COUNTS] if carry else [key]
    read = docs.select(*others) if carry else docs.select(key, text)
    schema = T.StructType([*(docs.schema[c] for c in others), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(text), CHUNK):
                found, part = count_chunk(data, at), batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=[*others, *COUNTS])

    return read.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_votes() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains. Most rules only ever object; a document without words gets votes as well."""
    words, lines, letters = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1)), F.greatest("n_letters", F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        objects = F.when(bad, -1)
        return (objects if good is None else objects.when(good, 1)).otherwise(0)

    mean = F.col("word_chars") / words
    spaced = F.col("n_wide") * 2 < F.col("word_chars")  # scripts that write no spaces have no word lengths
    return {
        "length": vote(F.col("n_words") < 10, F.col("n_words").between(30, 100_000)),
        "word_length": vote((mean < 2.0) | (mean > 14.0) & spaced, mean.between(3.0, 9.0)),
        "symbols": vote(F.col("n_symbols") * 10 > words),
        "symbol_runs": vote(F.col("n_symbol_runs") * 20 > words),
        "bare_words": vote(F.col("n_bare") * 10 > words),
        "lines": vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 2 > lines)),
        "repeats": vote(F.col("n_repeat_words") * 5 > words),
        "stutters": vote(F.col("n_stutters") * 10 > words),
        "capitals": vote(F.col("n_upper") * 2 > letters),
        "exclaims": vote(F.col("n_exclaims") * 10 > words),
        "sentences": vote((F.col("n_words") >= 100) & (F.col("n_ends") == 0), F.col("n_ends") * 60 >= words),
    }


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation: (share of good, P(vote | good), P(vote | bad)), each of the latter rules x 3 votes.

    Votes are taken as independent given the class. The start is FIRST_GUESS by objections; then all rates are learned, with
    one document of each vote added to each class, so that a vote that was never seen rules out nothing. The
    good class is the one that draws fewer objections.
    """
    if not patterns:
        return 0.5, np.full((n_rules, 3), 1 / 3), np.full((n_rules, 3), 1 / 3)
    votes = np.array([p for p, _ in patterns], int).reshape(-1, n_rules) + 1
    counts = np.array([c for _, c in patterns], float)
    marks = votes[:, :, None] == np.arange(3)
    p = np.array(FIRST_GUESS)[np.minimum((votes == 0).sum(1), 2)]
    for _ in range(rounds):
        share = (p @ counts + 1) / (counts.sum() + 2)
        rates = [np.einsum("prv,p->rv", marks, r * counts) + 1 for r in (p, 1 - p)]
        good, bad = (r / r.sum(1, keepdims=True) for r in rates)
        odds = np.einsum("prv,rv->p", marks, np.log(good) - np.log(bad)) + math.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-12:
            break
    if good[:, 0].sum() > bad[:, 0].sum():
        share, good, bad = 1 - share, bad, good
    return share, good, bad


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, carry: bool = False) -> DataFrame:
    """The key, the counts, the votes, base_failed, the posterior `quality` and `kept` of every document.

    carry: with every column of docs, which should have no names of these.
    """
    votes = rule_votes()
    names = [f"vote_{n}" for n in votes]
    counted = staged(word_counts(docs, key, text, carry), "counts").withColumns({f"vote_{n}": v for n, v in votes.items()})
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in counted.groupBy(*names).count().collect())
    share, good, bad = fit_accuracies(patterns, len(names))
    odds = F.lit(math.log(share / (1 - share)))
    for i, n in enumerate(names):
        step = np.log(good[i]) - np.log(bad[i])
        odds = odds + F.when(F.col(n) == 1, float(step[2])).when(F.col(n) == -1, float(step[0])).otherwise(float(step[1]))
    judged = counted.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
