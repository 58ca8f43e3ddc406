from .literals import constant, parameter, with_constants
from .readers import (
    custom_source,
    dataset_reference,
    decode_kafka,
    jdbc_options,
    kafka_options,
    read_file,
    read_generic,
    read_jdbc,
    read_kafka,
    read_table,
    sql_query,
)
from .row_groups import RowGroups, register

__all__ = [
    "RowGroups",
    "register",
    "constant",
    "custom_source",
    "dataset_reference",
    "decode_kafka",
    "jdbc_options",
    "kafka_options",
    "parameter",
    "read_file",
    "read_generic",
    "read_jdbc",
    "read_kafka",
    "read_table",
    "sql_query",
    "with_constants",
]
