"""Edit distance with transpositions, for pairs that a cheap bound has let through."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def damerau_levenshtein(a: str, b: str) -> int:
    """The unrestricted distance: insert, delete, replace, swap neighbours, and edit between swapped ones."""
    far = len(a) + len(b)
    last_row: dict[str, int] = {}
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last_match = 0
        for j, y in enumerate(b, 1):
            row, column = last_row.get(y, 0), last_match
            if x == y:
                last_match = j
            table[i + 1][j + 1] = min(
                table[i][j] + (x != y),
                table[i + 1][j] + 1,
                table[i][j + 1] + 1,
                table[row][column] + (i - row - 1) + 1 + (j - column - 1),
            )
        last_row[x] = i
    return table[-1][-1]


def damerau(a: Column | str, b: Column | str) -> Column:
    """damerau_levenshtein of two columns, in batches."""

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else damerau_levenshtein(p, q) for p, q in zip(x, y)], dtype="Int32")

    return distance(a, b)
