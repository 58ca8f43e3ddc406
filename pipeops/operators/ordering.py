"""Order, limit and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pipeops.functions import as_column, sort_keys


def sort(df: DataFrame, expressions: Sequence, spread_ties: Sequence = ()) -> DataFrame:
    """Order by ``"x DESC NULLS LAST"`` texts, ``("x", "desc")`` tuples or Columns.

    Spark sends all rows with equal sort keys to one task. ``spread_ties`` names
    further sort keys that let it cut such a run; they only settle ties.
    """
    if not expressions:
        raise ValueError("a sort needs expressions")
    return df.sort(*sort_keys([*expressions, *spread_ties]))


def limit(df: DataFrame, count: int) -> DataFrame:
    """The first rows; after :func:`sort` a top-k that needs no full sort."""
    if count < 0:
        raise ValueError("count must not be negative")
    return df.limit(count)


def repartition(df: DataFrame, partitions: int = 200, columns: Sequence[str] = ()) -> DataFrame:
    """Shuffle into a number of partitions, by columns if given. A hot column value
    stays in one partition; leave the columns out to spread rows evenly.
    """
    return df.repartition(partitions, *[as_column(c) for c in columns])


def dealt(df: DataFrame, columns: Sequence[str], share: int = 8) -> DataFrame:
    """Shuffle by columns into ``share`` times the session's shuffle partitions, ahead of a grouping
    that hardly shrinks its rows.

    The grouping then runs behind this shuffle alone: no task sorts or hashes its rows before
    it, and one behind it holds a ``share``-th of what it would.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return repartition(df, share * partitions, columns)


def coalesce(df: DataFrame, partitions: int = 1) -> DataFrame:
    """Fewer partitions without a shuffle. It also lowers the parallelism of the
    stage before it, so small numbers suit small results only.
    """
    return df.coalesce(partitions)
