"""Tables, files, JDBC, Kafka, SQL text, data sources and user functions as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .secrets import resolve, resolve_options

FILE_FORMATS = ("parquet", "csv", "json", "orc", "text", "binaryFile")


def _required(**values: object) -> None:
    for name, value in values.items():
        if value is None or value == "":
            raise ValueError(f"{name} is required")


def read_table(spark: SparkSession, table: str, streaming: bool = False) -> DataFrame:
    _required(table=table)
    return spark.readStream.table(table) if streaming else spark.read.table(table)


def dataset_reference(spark: SparkSession, name: str, streaming: bool = False) -> DataFrame:
    """A dataset written earlier; it is read back, not computed again."""
    return read_table(spark, name, streaming)


def read_file(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    streaming: bool = False,
    options: Mapping[str, object] | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Files of one format. A stream must be given its schema and a folder."""
    _required(path=path)
    if format not in FILE_FORMATS:
        raise ValueError(f"format must be one of {', '.join(FILE_FORMATS)}")
    if streaming and schema is None and format not in ("text", "binaryFile"):
        raise ValueError("a streaming file source needs a schema")
    reader = (spark.readStream if streaming else spark.read).format(format)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**resolve_options(options)).load(resolve(path))


def jdbc_options(
    url: str,
    dbtable: str,
    options: Mapping[str, object] | None = None,
    partition_column: str | None = None,
    lower_bound: object = None,
    upper_bound: object = None,
    num_partitions: int | None = None,
) -> dict[str, object]:
    _required(url=url, dbtable=dbtable)
    split = {
        "partitionColumn": partition_column,
        "lowerBound": lower_bound,
        "upperBound": upper_bound,
        "numPartitions": num_partitions,
    }
    given = {key: value for key, value in split.items() if value is not None}
    if given and len(given) < len(split):
        missing = ", ".join(sorted(set(split) - set(given)))
        raise ValueError(f"a split JDBC read also needs {missing}")
    return {**resolve_options(options), **given, "url": resolve(url), "dbtable": resolve(dbtable)}


def read_jdbc(spark: SparkSession, url: str, dbtable: str, **config) -> DataFrame:
    """A JDBC table or subquery (batch only).

    Without the four split arguments Spark reads over one connection in one
    task; give them for any table of size.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, dbtable, **config)).load()


def kafka_options(
    bootstrap_servers: str, subscribe: str, options: Mapping[str, object] | None = None
) -> dict[str, object]:
    _required(bootstrap_servers=bootstrap_servers, subscribe=subscribe)
    return {
        **resolve_options(options),
        "kafka.bootstrap.servers": resolve(bootstrap_servers),
        "subscribe": resolve(subscribe),
    }


def read_kafka(
    spark: SparkSession,
    bootstrap_servers: str,
    subscribe: str,
    options: Mapping[str, object] | None = None,
) -> DataFrame:
    """A Kafka topic (streaming only), in Kafka's own column layout."""
    opts = kafka_options(bootstrap_servers, subscribe, options)
    return spark.readStream.format("kafka").options(**opts).load()


def decode_kafka(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Timestamp and text payload of Kafka rows; rows without a value are left out."""
    return df.select("timestamp", F.col("value").cast("string").alias(payload)).where(
        F.col(payload).isNotNull()
    )


def sql_query(spark: SparkSession, query: str, **inputs: DataFrame) -> DataFrame:
    """Any Spark SQL query; ``{name}`` in the text stands for the DataFrame ``name``."""
    _required(query=query)
    return spark.sql(query, **inputs)


def read_generic(
    spark: SparkSession,
    format: str,
    options: Mapping[str, object] | None = None,
    streaming: bool = False,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Any data source known to the session, Python data sources among them."""
    _required(format=format)
    reader = (spark.readStream if streaming else spark.read).format(format)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**resolve_options(options)).load()


def custom_source(spark: SparkSession, build: Callable[[SparkSession], DataFrame]) -> DataFrame:
    result = build(spark)
    if not isinstance(result, DataFrame):
        raise ValueError("a custom source must return a DataFrame")
    return result
