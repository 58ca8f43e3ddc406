"""Event-time operators that work on batches and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from pipeops.operators.aggregates import latest_per_key


def watermark(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Allow rows to come ``delay`` late; stateful operators below drop later ones.

    Spark takes no watermark on a timestamp without time zone, so such a column
    is read as session time zone first.
    """
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, delay)


def deduplicate_event_time(
    df: DataFrame, columns: Sequence[str], event_time: str, delay: str = "10 minutes"
) -> DataFrame:
    """One row per key.

    Batch: the row with the latest event time; ties go to the row that is greatest
    in its other columns. Stream: the first row to arrive, with the keys kept in
    state only until the watermark passes them.
    """
    if not columns:
        raise ValueError("deduplicate_event_time needs key columns")
    if df.isStreaming:
        return watermark(df, event_time, delay).dropDuplicatesWithinWatermark(list(columns))
    others = [c for c in df.columns if c not in columns and c != event_time]
    return latest_per_key(df, columns, [F.col(c).desc() for c in [event_time, *others]])
