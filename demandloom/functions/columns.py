"""Column expressions shared by operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ["store_id", "sku_id"]
#: Segments in the order in which quotas are dealt.
SEGMENTS = ["fast", "medium", "intermittent"]


def segment(zero_ratio: Column, fast: float = 0.20, slow: float = 0.60) -> Column:
    """Strict bounds: a ratio on either bound is medium."""
    return F.when(zero_ratio < fast, "fast").when(zero_ratio > slow, "intermittent").otherwise("medium")


def selection_score(seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("store_id"), F.col("sku_id")), 256)


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def any_null(columns: list[str]) -> Column:
    return any_of([F.col(c).isNull() for c in columns])


def iso_weekday(d: str) -> Column:
    return F.weekday(d) + 1


def joined_names(*names: str) -> Column:
    """Non-null names joined by ' | '; null if there is none."""
    return F.when(any_of([F.col(n).isNotNull() for n in names]), F.concat_ws(" | ", *names))


def pinball(q: float, error: Column) -> Column:
    return F.greatest(q * error, (q - 1) * error)


def distinct_count(c: str) -> Column:
    """Exact distinct count that counts null as a value."""
    return F.count_distinct(F.struct(c))
