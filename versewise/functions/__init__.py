"""Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once, however often it is used: keeps expressions small."""
    return F.element_at(F.transform(F.array(value), body), 1)
