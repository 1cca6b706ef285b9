"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default when b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def safe_mean(total: Column, count: Column, default: float = 1.0) -> Column:
    return safe_div(total, count, default)


def lookup(mapping: dict[str, float], key: Column) -> Column:
    """Value of a small label map; null for a label outside of it."""
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k, float(v))]
    return F.try_element_at(F.create_map(*pairs), key)
