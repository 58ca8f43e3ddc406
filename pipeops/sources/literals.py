"""Single-row sources: pipeline parameters and constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .secrets import resolve


def _literal(value: object, data_type: str | None) -> Column:
    column = F.lit(resolve(value))
    return column.cast(data_type) if data_type else column


def parameter(
    spark: SparkSession, name: str, default: object = None, data_type: str | None = None
) -> DataFrame:
    """One row with one column; ``data_type`` is any Spark SQL type."""
    if not name:
        raise ValueError("a parameter needs a name")
    return spark.range(1).select(_literal(default, data_type).alias(name))


def constant(
    spark: SparkSession, name: str, value: object, data_type: str | None = None
) -> DataFrame:
    return parameter(spark, name, value, data_type)


def with_constants(df: DataFrame, *single_rows: DataFrame) -> DataFrame:
    """Add the columns of single-row sources to every row.

    A source of several rows, or of none, fails the query: one aggregate brings it to the
    single row that is broadcast.
    """
    for row in single_rows:
        held = row.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("*")).alias("only"))
        one = F.when(F.col("n") == 1, F.col("only")).otherwise(
            F.raise_error(F.concat(F.lit("a single row is needed, found "), F.col("n").cast("string"))).cast(held.schema["only"].dataType)
        )
        df = df.crossJoin(F.broadcast(held.select(one.alias("only")).select("only.*")))
    return df
