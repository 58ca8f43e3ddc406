"""Running a stream over what is there now and reading the result back."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pipeops.files import committed, mark
from pipeops.outputs.cdc import CdcTarget

Finished = Callable[[StreamingQuery], None]


def drain(df: DataFrame, path: str, checkpoint: str, finished: Finished | None = None) -> DataFrame:
    """Process all available input in append mode into Parquet files and read them.

    Started again with the same checkpoint it takes in only new input. ``finished`` is given
    the query when it has ended, to look at its progress.
    """
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if finished:
        finished(query)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drain_updates(
    df: DataFrame, keys: Sequence[str], path: str, checkpoint: str, finished: Finished | None = None, **target: int
) -> DataFrame:
    """The same in update mode, for windowed aggregates with a watermark: a micro-batch gives
    the rows that changed, which replace the rows with their ``keys``.

    State is let go when the watermark passes it, and a batch writes what it changed, not the
    whole result. Changes are kept in buckets of the key (see :class:`pipeops.outputs.CdcTarget`,
    whose ``buckets`` and ``compact_every`` may be given).
    """
    kept = CdcTarget(path, keys, "__batch", **target)

    def write(changed: DataFrame, batch_id: int) -> None:
        kept.write_batch(changed.withColumn("__batch", F.lit(batch_id).cast("long")), batch_id)

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if finished:
        finished(query)
    stored = StructType([*df.schema.fields]).add("__batch", "long")
    return kept.read(df.sparkSession, stored).drop("__batch")


def with_closing_rows(stream: DataFrame, folder: str) -> DataFrame:
    """The stream together with rows put into ``folder`` by :func:`close`."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def close(spark: SparkSession, folder: str, schema: StructType, rows: Sequence[Mapping[str, object]]) -> None:
    """Rows that move the watermark past all that came before, once the input has ended.

    Each gives an event time beyond every window and wait, and what it takes to reach the
    watermark of its stream (such as a column that is filtered on); other columns are null, so
    that it matches nothing. What is emitted for a closing row stays behind the watermark and
    never comes out. Run the same query again, with its checkpoint, to let the rest out.
    """
    listed = [tuple(row.get(name) for name in schema.names) for row in rows]
    spark.createDataFrame(listed, schema).coalesce(1).write.mode("append").parquet(folder)


def drain_complete(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The same in complete mode: each micro-batch writes the whole result to a folder of its
    own, so repeating a batch after a failure changes nothing. State and output hold every
    group there ever was: for small sets of groups only.
    """

    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        mark(result.sparkSession.range(1), f"{path}/log", "batch", batch_id)

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = df.sparkSession
    last = committed(spark, f"{path}/log", "batch")[-1]
    return spark.read.schema(df.schema).parquet(f"{path}/batch={last}")
