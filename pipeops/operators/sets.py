"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(
    left: DataFrame, right: DataFrame, allow_missing_columns: bool = False
) -> DataFrame:
    """All rows of both sides, columns matched by name."""
    return left.unionByName(right, allowMissingColumns=allow_missing_columns)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both sides, columns matched by position."""
    return left.union(right)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows found on both sides.

    One grouping of both sides: equal rows are folded before the shuffle, so a large
    group of copies does not land in one task. Nulls are equal.
    """
    return _sides(left, right, "__left AND __right")


def except_(left: DataFrame, right: DataFrame, all: bool = True) -> DataFrame:
    """Left rows not on the right: as a bag (each right row takes away one copy), or
    with ``all=False`` as a set. Both fold equal rows before the shuffle.
    """
    return left.exceptAll(right) if all else _sides(left, right, "__left AND NOT __right")


def _sides(left: DataFrame, right: DataFrame, kept: str) -> DataFrame:
    """Distinct rows by the sides they are on; columns are matched by position."""
    both = left.select("*", F.lit(True).alias("__left"), F.lit(False).alias("__right")).unionAll(
        right.select("*", F.lit(False), F.lit(True))
    )
    columns = [F.col(f"`{c}`") for c in left.columns]
    found = both.groupBy(*columns).agg(
        F.max("__left").alias("__left"), F.max("__right").alias("__right")
    )
    return found.where(kept).select(*columns)
