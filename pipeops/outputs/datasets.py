"""Where results go: tables, views and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pipeops.sources.secrets import resolve_options


def materialized_view(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Compute a batch result, store it as table ``name`` and return the stored table."""
    if df.isStreaming:
        raise ValueError("a materialized view needs a batch input; use streaming_table")
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.read.table(name)


def streaming_table(
    df: DataFrame, name: str, checkpoint: str, path: str | None = None
) -> DataFrame:
    """Append the input not seen before (by ``checkpoint``) to table ``name``."""
    if not df.isStreaming:
        raise ValueError("a streaming table needs a streaming input; use materialized_view")
    writer = (
        df.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if path:
        writer = writer.option("path", path)
    writer.toTable(name).awaitTermination()
    return df.sparkSession.read.table(name)


def temporary_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def external_sink(
    df: DataFrame,
    name: str,
    format: str,
    checkpoint: str,
    options: Mapping[str, object] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start appending a stream to an external sink and return the running query."""
    if not df.isStreaming:
        raise ValueError("an external sink needs a streaming input")
    writer = (
        df.writeStream.queryName(name)
        .format(format)
        .options(**resolve_options(options))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def append_flow(df: DataFrame, target: str, flow: str, checkpoint_root: str) -> None:
    """Append the input not seen before to the folder ``target``, as one of several flows.

    Every flow has its own checkpoint and its own sub-folders, one per micro-batch: a
    batch that is repeated after a failure replaces its own folder, and flows do not
    disturb each other. :func:`read_flows` reads them all.
    """
    if not df.isStreaming:
        raise ValueError("an append flow needs a streaming input")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/flow={flow}/batch={batch_id}")

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{checkpoint_root}/{flow}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_flows(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """All rows appended to ``target``, with the name of the flow in the column ``flow``."""
    return spark.read.schema(schema).parquet(target).withColumn(
        "flow", F.regexp_extract(F.col("_metadata.file_path"), "/flow=([^/]+)/", 1)
    )
