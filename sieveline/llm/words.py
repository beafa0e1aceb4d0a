"""Word hashes of many texts at once, from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from sieveline.llm.common import splitmix

STEP = np.uint64(0x5851F42D4C957F2D)
BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
#: Bytes of words: all but space and \t\n\v\f\r.
UNSPACED = np.ones(256, bool)
UNSPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of terms: ASCII letters and digits, and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
with np.errstate(over="ignore"):
    _VALUE = splitmix(LOWER.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
_powers: dict[str, np.ndarray] = {}


def power(base: np.uint64, n: int, name: str) -> np.ndarray:
    found = _powers.get(name)
    if found is None or len(found) < n:
        with np.errstate(over="ignore"):
            found = np.full(max(n, 1), base)
            found[0] = 1
            found = np.multiply.accumulate(found)
        if n <= 8_000_000:
            _powers[name] = found
    return found[:n]


def word_hashes(data: np.ndarray, at: np.ndarray, of: np.ndarray = UNSPACED, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z in lower case, number of words of each text); words are runs of bytes in `of`.

    With prefix: the hash of that many bytes of each word, or of the whole word if it has no more.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    inside = of[data]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    starts_here[first] = inside[first]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:]
    ends_here[at[1:][at[:-1] < at[1:]] - 1] = inside[at[1:][at[:-1] < at[1:]] - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * power(STEP, n, "step"), out=total[1:])
        hashes = splitmix((total[ends] - total[starts]) * power(BACK, n, "back")[starts] + (ends - starts).astype(np.uint64))
    counts = np.searchsorted(starts, at[1:]) - np.searchsorted(starts, at[:-1])
    return hashes, counts
