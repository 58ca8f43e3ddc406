"""Streaming-query progress from event logs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The JSON names Spark writes, only those needed here.
_FIELDS = {
    "id": "STRING",
    "runId": "STRING",
    "timestamp": "STRING",
    "batchId": "BIGINT",
    "numInputRows": "BIGINT",
    "inputRowsPerSecond": "DOUBLE",
    "processedRowsPerSecond": "DOUBLE",
    "eventTime": "STRUCT<watermark: STRING>",
    "stateOperators": "ARRAY<STRUCT<operatorName: STRING, numRowsTotal: BIGINT, "
    "numRowsUpdated: BIGINT, memoryUsedBytes: BIGINT>>",
}
# Names under which progress and checkpoint folders are logged.
EVENTS = (
    "org.apache.spark.sql.streaming.StreamingQueryListener$QueryProgressEvent",
    "SparkListenerStreamingQueryProgress",
    "query_progress",
)
CHECKPOINTS = ("checkpointLocation", "checkpoint_path", "checkpointPath")


class Progress(NamedTuple):
    """``progress``: one row per query and batch; ``latest``: each query's last row;
    ``state``: one row per state operator and batch; ``checkpoints``: distinct paths.
    """

    progress: DataFrame
    latest: DataFrame
    state: DataFrame
    checkpoints: DataFrame


def streaming_progress(lines: DataFrame, value: str = "value") -> Progress:
    flat = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())
    nested = ", ".join(f"{name}: {kind}" for name, kind in _FIELDS.items())
    # All three names hold this word; other lines are not parsed.
    parsed = lines.where(F.contains(F.col(value), F.lit("rogress"))).select(
        F.from_json(value, f"Event STRING, progress STRUCT<{nested}>, {flat}").alias("e"),
        F.col(value).alias("__line"),
    )
    kind = F.coalesce(F.col("e.Event"), F.get_json_object("__line", "$.event"))
    body = F.coalesce(
        F.col("e.progress"),
        F.struct(*[F.col(f"e.{name}") for name in _FIELDS]),
    )
    rows = parsed.where(kind.isin(*EVENTS)).select(body.alias("p"))
    progress = rows.select(
        F.coalesce("p.id", "p.runId", F.lit("unknown")).alias("query_id"),
        F.col("p.timestamp").alias("timestamp"),
        F.col("p.batchId").alias("batch_id"),
        F.col("p.inputRowsPerSecond").alias("input_rows_per_second"),
        F.col("p.processedRowsPerSecond").alias("processed_rows_per_second"),
        F.col("p.numInputRows").alias("num_input_rows"),
        F.col("p.eventTime.watermark").alias("watermark"),
        F.col("p.stateOperators").alias("state_operators"),
    )
    latest = (
        progress.groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("batches"),
            F.max_by(F.struct("*"), F.struct("timestamp", "batch_id")).alias("last"),
        )
        .select("query_id", "batches", *[f"last.{c}" for c in progress.columns if c != "query_id"])
    )
    state = progress.select(
        "query_id", "timestamp", "batch_id", F.inline("state_operators")
    ).select(
        "query_id",
        "timestamp",
        "batch_id",
        F.col("operatorName").alias("operator"),
        F.col("numRowsTotal").alias("num_rows_total"),
        F.col("numRowsUpdated").alias("num_rows_updated"),
        F.col("memoryUsedBytes").alias("memory_used_bytes"),
    )
    found = F.from_json(value, ", ".join(f"{name} STRING" for name in CHECKPOINTS))
    checkpoints = (
        # All three names hold this word; other lines are not parsed.
        lines.where(F.contains(F.col(value), F.lit("heckpoint")))
        .select(F.explode(F.array(*[found[n] for n in CHECKPOINTS])).alias("checkpoint"))
        .where("checkpoint <> ''")
        .distinct()
    )
    return Progress(progress, latest, state, checkpoints)
