"""Grouping, distinct rows and keyed latest-row selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeops.functions import as_column, named_column, sort_keys

# Fixed value: what is computed when no aggregation is given.
ROW_COUNT = ({"expression": "count(*)", "alias": "row_count"},)


def aggregate(
    df: DataFrame,
    group_by: Sequence = (),
    aggregations: Sequence[Mapping[str, str]] = ROW_COUNT,
) -> DataFrame:
    """Group by names, SQL expressions or ``{"expression", "alias"}`` dicts.

    Aggregations are any Spark SQL aggregates: ``FILTER (WHERE ..)``, distinct,
    approximate, ``max_by``. ``window(ts, '10 minutes')`` and ``session_window``
    are allowed as group keys, on streams too.
    """
    columns = [named_column(a) for a in aggregations or ROW_COUNT]
    if group_by:
        return df.groupBy(*[named_column(g) for g in group_by]).agg(*columns)
    return df.agg(*columns)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence) -> DataFrame:
    """The first row of each key in ``order_by``.

    Spark keeps one row per key in every task before the shuffle (window group
    limit), so a hot key sends at most one row per task.
    """
    if not keys:
        raise ValueError("at least one key column is required")
    ranked = df.withColumn(
        "__rank",
        F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_keys(order_by))),
    )
    return ranked.where("__rank = 1").drop("__rank")


def drop_duplicates(
    df: DataFrame, columns: Sequence[str] = (), order_by: Sequence = ()
) -> DataFrame:
    """One row per key. Which one is arbitrary unless ``order_by`` says (batch only)."""
    if not order_by:
        return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()
    return latest_per_key(df, list(columns) or df.columns, order_by)


def session_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    gap: str,
    sums: Mapping[str, str],
    chunk: str = "hour",
) -> DataFrame:
    """Sessions per key: start, end and summed expressions, safe for a hot key (batch).

    ``session_window`` sorts all rows of a key in one task. Here sessions are first built per
    key and calendar ``chunk`` (a unit of ``date_trunc``), which spreads a hot key. Only the
    first and the last of a chunk can meet a session of another chunk: those edges, at most
    two rows per key and chunk, are scanned in order and joined, and all sessions inside a
    chunk are final where they are, however many a key has. ``sums`` maps an output name to an
    expression that is summed, e.g. ``{"events": "1"}``.
    """
    keys = list(keys)
    length = F.expr(f"INTERVAL '{gap}'")
    pieces = (
        df.withColumn("__chunk", F.date_trunc(chunk, F.col(time)))
        .groupBy(*keys, "__chunk", F.session_window(F.col(time), gap).alias("__s"))
        .agg(
            F.min(time).alias("__first"),
            F.max(time).alias("__last"),
            *[F.sum(as_column(e)).alias(name) for name, e in sums.items()],
        )
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__first")
    marked = pieces.withColumn("__edge", F.lag("__last").over(inside).isNull() | F.lead("__last").over(inside).isNull())
    columns = [*keys, F.col("__first").alias("session_start"), (F.col("__last") + length).alias("session_end"), *sums]
    final = marked.where("NOT __edge").select(*columns)
    edges = marked.where("__edge")
    in_order = Window.partitionBy(*keys).orderBy("__first")
    # the last of the chunk before may lie behind sessions that are final, but never behind one it could join
    opens = F.when(F.col("__first") <= F.lag("__last").over(in_order) + length, 0).otherwise(1)
    numbered = edges.withColumn("__new", opens).withColumn("__session", F.sum("__new").over(in_order))
    joined = numbered.groupBy(*keys, "__session").agg(
        F.min("__first").alias("__first"), F.max("__last").alias("__last"), *[F.sum(name).alias(name) for name in sums]
    )
    return final.unionByName(joined.select(*columns))
