"""Equi-join of a prefix-filtered side with another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_like(left: DataFrame, right: DataFrame, left_on: str, right_on: str, column: str, prefix: str,
              ignore_case: bool = False, how: str = "inner") -> DataFrame:
    """Rows of ``left`` whose ``column`` starts with ``prefix`` (taken
    literally, ``%``/``_``/``#`` included) joined to ``right``.

    The case-sensitive prefix test reaches the Parquet scan as a pushed
    ``StringStartsWith`` filter.  The join strategy is left to AQE, which
    broadcasts the filtered side only when its measured size is small."""
    c = F.col(column)
    cond = F.lower(c).startswith(prefix.lower()) if ignore_case else c.startswith(prefix)
    kept = left.where(cond)
    return kept.join(right, kept[left_on] == right[right_on], how)


NO_CASE = "UTF8_LCASE"


def join_like_nocase(left: DataFrame, right: DataFrame, left_on: str, right_on: str, column: str, prefix: str,
                     how: str = "inner") -> DataFrame:
    """``join_like`` under a case-insensitive collation, for the prefix and for the
    text join key alike; both sides keep their spelling.

    The comparison is the collation's, so no lowered copy of a column is made.
    Parquet's statistics are in byte order, so the prefix under a collation
    can't be pushed to the scan; the filter runs right above it, before the
    join's shuffle.  The join hashes the key by its collation key, so a hot key
    is split as in any other join of two shuffles."""
    kept = left.where(F.collate(F.col(column), NO_CASE).startswith(F.collate(F.lit(prefix), NO_CASE)))
    return kept.join(right, F.collate(kept[left_on], NO_CASE) == F.collate(right[right_on], NO_CASE), how)
