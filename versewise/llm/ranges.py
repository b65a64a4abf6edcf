"""Ranges of an integer key with about equal numbers of bytes, as plain column expressions.

Unlike ``repartitionByRange`` the ranges are fixed before the rows are computed, so that costly columns are not
computed a second time for a sample, and every consumer sees the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges at most; the driver holds a number a range.
MOST_RANGES = 1 << 16


def range_bounds(rows: DataFrame, key: str, size: Column, range_bytes: int) -> list[int]:
    """Bounds between ranges of about ``range_bytes`` each: quantiles of the key."""
    total = rows.agg(F.sum(size).alias("b"), F.count(key).alias("n")).first()
    n = max(1, min(MOST_RANGES, (total.b or 0) // range_bytes, total.n or 1))
    if n == 1:
        return []
    return sorted(set(rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("p")).first().p))


def range_of(column: Column, bounds: list[int], fan: int = 256) -> Column:
    """Number of bounds that are at most the value (0 for null): among every ``fan``-th, then in between."""
    if not bounds:
        return F.lit(0)
    every = F.array(*[F.lit(b) for b in bounds])
    tops = F.array(*[F.lit(b) for b in bounds[fan - 1 :: fan]]) if len(bounds) >= fan else F.array().cast("array<bigint>")
    whole = F.size(F.filter(tops, lambda b: b <= column)) * fan
    return F.coalesce(whole + F.size(F.filter(F.slice(every, whole + 1, F.lit(fan)), lambda b: b <= column)), F.lit(0))
