"""Word shingle sets of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from sieveline.llm.common import splitmix
from sieveline.llm.words import UNSPACED, word_hashes


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted, one text after the other; their number in each text).

    A shingle is `width` words with A-Z in lower case. A text with fewer words has its whole sequence as its one
    shingle; a text without words has none.
    """
    hashes, counts = word_hashes(data, at, UNSPACED)
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(hashes)
    with np.errstate(over="ignore"):
        long = np.zeros(n, np.uint64)
        m = max(0, n - width + 1)
        for k in range(width):
            long[:m] = (long[:m] ^ (long[:m] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
        long = splitmix(long)
        whole = np.zeros(len(counts), np.uint64)
        for k in range(width - 1):
            here = (counts > k) & (counts < width)
            whole[here] = (whole[here] ^ (whole[here] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[starts[here] + k] + np.uint64(1)
        whole = splitmix(whole)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, c) in enumerate(zip(starts.tolist(), counts.tolist())):
        if c:
            found = np.unique(long[a : a + c - width + 1]) if c >= width else whole[i : i + 1]
            sizes[i] = len(found)
            out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes
