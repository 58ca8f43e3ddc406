"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pipeops.session import scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: its lineage is cut, and it survives lost executors."""
    spark = frame.sparkSession
    path = scratch(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
