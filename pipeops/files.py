"""Which numbered folders of a shared store are complete, told by small marker tables.

Only Spark's reader and writer are used, so this works over Spark Connect as well.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def mark(rows: DataFrame, folder: str, prefix: str, number: int) -> None:
    """Commit ``number`` with a few rows, in one file that is there whole or not at all."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{prefix}={number}")


def marked(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """All marker rows below a folder, with the number in a column named by the prefix; None if there are none."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def committed(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers marked below a folder, in order."""
    found = marked(spark, folder, f"{prefix} long")
    return [] if found is None else sorted(r[0] for r in found.distinct().collect())


def emptied(spark: SparkSession, folder: str) -> None:
    """Remove a folder's files; an empty table stays."""
    spark.range(0).write.mode("overwrite").parquet(folder)
