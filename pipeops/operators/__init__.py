from .aggregates import aggregate, distinct, drop_duplicates, latest_per_key, session_aggregate
from .frames import places, split_frame
from .joins import join
from .ordering import coalesce, dealt, limit, repartition, sort
from .sets import except_, intersect, union, union_by_name
from .shaping import (
    build_array,
    build_map,
    build_struct,
    cast,
    custom,
    derive,
    drop,
    drop_nulls,
    explode,
    fill_nulls,
    filter_rows,
    flatten_struct,
    json_parse,
    posexplode,
    rename,
    reorder,
    replace,
    select,
    sql_project,
)
from .windows import split_window, split_windows, window

__all__ = [
    "aggregate",
    "build_array",
    "build_map",
    "build_struct",
    "cast",
    "coalesce",
    "custom",
    "dealt",
    "derive",
    "distinct",
    "drop",
    "drop_duplicates",
    "drop_nulls",
    "except_",
    "explode",
    "fill_nulls",
    "filter_rows",
    "flatten_struct",
    "intersect",
    "join",
    "json_parse",
    "latest_per_key",
    "limit",
    "places",
    "posexplode",
    "rename",
    "reorder",
    "repartition",
    "replace",
    "select",
    "session_aggregate",
    "sort",
    "split_frame",
    "split_window",
    "split_windows",
    "sql_project",
    "union",
    "union_by_name",
    "window",
]
