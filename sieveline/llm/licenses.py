"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies them.

A text is its sequence of terms (runs of letters and digits, A-Z in lower case) and of its five-term shingles. Windows have levels:
at level l they hold 2^(l + 1) shingles and start at every multiple of 2^l, so a run of 2^l lies in one. A template of s
shingles belongs to the least level with 2^l >= s. A window that holds HUNDREDTHS percent of it has a Jaccard similarity of
at least 0.75 / 4.25 with it, and each of BANDS bands is one MinHash value, so such a window shares no band with a probability
under (1 - 0.176)^BANDS, about 4e-6. By level and band an index maps MinHash values to templates, so the work on a text does not
grow with the number of templates; the minima of a level are made from those of the level below. A retrieved template
matches if the window holds at least HUNDREDTHS percent of its distinct shingles.

Defined results: null and empty texts and texts of fewer than five terms match nothing; whole texts are scanned; repeated
rows match alike; an empty table gives an empty table; only the key and the text are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sieveline.llm.common import splitmix, text_chunks
from sieveline.llm.words import ALNUM, word_hashes

_GRANT_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_MIT = _GRANT_MIT + ', including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GPL_START = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
_GPL_END = " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
#: Usual license notices, grants, and the sentences by which licenses are known. A name may have a wording after `:`.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0:name": "Apache License Version 2.0, January 2004",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License.",
    "mit:licensed": "Licensed under the MIT License.",
    "mit:terms": "under the terms of the MIT License",
    "mit:project": "This project is licensed under the MIT License",
    "mit-grant": _GRANT_MIT,
    "mit-text": _MIT,
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-header": _GPL_START + _GPL_END.strip(),
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-3.0-header": _GPL_START + "Affero" + _GPL_END,
    "bsd-clause": _BSD_START,
    "bsd-2-clause-text": _BSD_START + _BSD_TWO,
    "bsd-3-clause-text": _BSD_START + _BSD_TWO + _BSD_THREE,
    "isc-grant": _ISC_GRANT,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cddl-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "artistic-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0:work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
SHINGLE = 5
BANDS = 64
HUNDREDTHS = 75
CHUNK = 2_000_000
#: Low bits of a MinHash value that the index looks at first.
LOW = 12
_rng = np.random.default_rng(1989)
FACTOR = _rng.integers(0, 1 << 32, BANDS, dtype=np.uint32) | np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, BANDS, dtype=np.uint32)


def shingle_sequence(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of each text in order, their number in each text)."""
    hashes, counts = word_hashes(data, at, ALNUM)
    sizes = np.maximum(counts - SHINGLE + 1, 0)
    m = max(0, len(hashes) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        rolled = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
        rolled = splitmix(rolled)
    starts = np.cumsum(counts) - counts
    return rolled[np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)], sizes


class Index:
    """Templates by level: their distinct shingles, and by band their MinHash values in order. One without shingles is an error."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.sets: list[np.ndarray] = []
        for name, text in templates.items():
            data = np.frombuffer(text.encode(), np.uint8)
            self.sets.append(np.unique(shingle_sequence(data, np.array([0, len(data)]))[0]))
            if not len(self.sets[-1]):
                raise ValueError(f"template {name} has fewer than {SHINGLE} terms")
        by_level: dict[int, list[int]] = {}
        for k, own in enumerate(self.sets):
            by_level.setdefault((len(own) - 1).bit_length(), []).append(k)
        # (MinHash values, templates, which low bits the values have), by bands, values in order
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for level, members in by_level.items():
            least = np.array([[(self.sets[k].astype(np.uint32) * f + b).min() for k in members] for f, b in zip(FACTOR, SHIFT)])
            order = np.argsort(least, 1, kind="stable")
            may = np.zeros((BANDS, 1 << LOW), bool)
            np.put_along_axis(may, (least & np.uint32((1 << LOW) - 1)).astype(np.int64), True, 1)
            self.levels[level] = np.take_along_axis(least, order, 1), np.array(members)[order], may


def scan_chunk(sequence: np.ndarray, sizes: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, template, first shingle of a window, template shingles that it holds, windows of the text that match)."""
    if not len(sequence):
        return []
    ends = np.cumsum(sizes)
    top = max(index.levels)
    # by level: where the blocks of the level below that make up each block begin, the text of each block, the last block of each text
    starts, docs, alone = [np.arange(len(sequence))], [], []
    count = sizes
    for level in range(top + 1):
        if level:
            below, count = count, -(-count // 2)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            starts.append(np.repeat(np.cumsum(below) - below, count) + 2 * step)
        docs.append(np.repeat(np.arange(len(sizes)), count))
        alone.append(np.flatnonzero(np.append(docs[-1][1:] != docs[-1][:-1], True)))
    found: set[tuple[int, int, int]] = set()
    low_bits = np.uint32((1 << LOW) - 1)
    low = sequence.astype(np.uint32)
    for band, (f, b) in enumerate(zip(FACTOR, SHIFT)):
        block = low * f + b
        for level in range(top + 1):
            if level:
                block = np.minimum.reduceat(block, starts[level])
            if level in index.levels:
                least = block.copy()
                np.minimum(block[:-1], block[1:], out=least[:-1])
                least[alone[level]] = block[alone[level]]
                values, own, may = (x[band] for x in index.levels[level])
                some = np.flatnonzero(may[least & low_bits])  # nearly all windows stop here
                at = np.searchsorted(values, least[some])
                hit = values[np.minimum(at, len(values) - 1)] == least[some]
                for w, k in zip(some[hit].tolist(), at[hit].tolist()):
                    while k < len(values) and values[k] == least[w]:
                        found.add((level, w, int(own[k])))
                        k += 1
    first = [np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(sizes)))]) for d in docs]
    best: dict[tuple[int, int], list[int]] = {}
    for level, w, k in sorted(found):
        d = int(docs[level][w])
        begin = int(ends[d] - sizes[d]) + ((w - int(first[level][d])) << level)
        held = int(np.isin(index.sets[k], sequence[begin : min(begin + (2 << level), int(ends[d]))]).sum())
        if 100 * held >= HUNDREDTHS * len(index.sets[k]):
            own = best.setdefault((d, k), [begin - int(ends[d] - sizes[d]), held, 0])
            own[1] = max(own[1], held)
            own[2] += 1
    return [(d, k, *v) for (d, k), v in sorted(best.items())]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, license, first_shingle, held, of, n_windows): the templates that each document holds.

    Wordings of a name (`name:wording`) are templates of their own, so each has its row.
    """
    index = Index(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(1), CHUNK):
                rows = scan_chunk(*shingle_sequence(data, at), index)
                if rows:
                    doc, k, first, held, windows = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array([index.names[i] for i in k]), pa.array(first, pa.int64()), pa.array(held, pa.int64()), pa.array([len(index.sets[i]) for i in k], pa.int64()), pa.array(windows, pa.int64())], names=[key, "license", "first_shingle", "held", "of", "n_windows"])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {docs.schema[key].dataType.simpleString()}, license string, first_shingle long, held long, of long, n_windows long")
