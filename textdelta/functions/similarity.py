"""Similarities of two strings that need a table or a scan of characters: Arrow UDFs over code points."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The weight of a common prefix, its greatest length, and the similarity from which it counts.
PREFIX_WEIGHT, PREFIX, PREFIX_FROM = 0.1, 4, 0.7


def damerau(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, with edits allowed between swapped ones."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, before = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), before
            if x == y:
                before = j
            swap = rows[k][m] + (i - k - 1) + 1 + (j - m - 1)
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap))
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


def jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    met = []
    for i, x in enumerate(a):
        for j in range(max(i - reach, 0), min(i + reach + 1, len(b))):
            if not taken[j] and b[j] == x:
                taken[j] = True
                met.append(x)
                break
    n = len(met)
    if not n:
        return 0.0
    other = [y for y, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(met, other, strict=True)) // 2
    jaro = (n / len(a) + n / len(b) + (n - swaps) / n) / 3
    same = next((k for k, (x, y) in enumerate(zip(a[:PREFIX], b[:PREFIX], strict=False)) if x != y), min(len(a), len(b), PREFIX))
    return jaro + same * PREFIX_WEIGHT * (1 - jaro) if jaro > PREFIX_FROM else jaro


def _udf(of: Callable[[str, str], float], kind: T.DataType, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else of(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], arrow)

    return run


damerau_distance = _udf(damerau, T.LongType(), pa.int64())
jaro_winkler_similarity = _udf(jaro_winkler, T.DoubleType(), pa.float64())
