"""String similarities in percent, as Arrow-batched functions (Spark has no built-in for them)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with whole rows as bits of one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / both lengths; two empty strings are equal."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs(a, b) / n


def token_set(a: str, b: str) -> float:
    """The best ratio among common words alone and with either side's rest; a side without rest scores 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not p or not q):
        return 100.0
    with_p, with_q = f"{both} {p}".strip(), f"{both} {q}".strip()
    best = indel_ratio(with_p, with_q)
    return max(best, indel_ratio(both, with_p), indel_ratio(both, with_q)) if both else best


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
