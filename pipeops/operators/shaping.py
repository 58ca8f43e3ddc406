"""Row-local operators: filters, projections and column shaping. None of them shuffles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from pipeops.functions import as_column, named_column


def filter_rows(df: DataFrame, expression: str | Column) -> DataFrame:
    """Rows for which the expression is true; null counts as not true."""
    return df.filter(as_column(expression))


def select(df: DataFrame, columns: Sequence = ("*",)) -> DataFrame:
    """Names, SQL expressions, ``{"expression", "alias"}`` dicts, or ``"*"``."""
    return df.select(*["*" if c == "*" else named_column(c) for c in columns or ("*",)])


def derive(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """Add a column; an existing column of that name is overwritten."""
    if not name:
        raise ValueError("a derived column needs a name")
    return df.withColumn(name, as_column(expression))


def sql_project(df: DataFrame, query: str | Sequence[str]) -> DataFrame:
    """A projection as SQL: a list of expressions, ``"a, b * 2 AS c"``, or a whole
    ``SELECT .. FROM {input}``.
    """
    if not isinstance(query, str):
        return df.selectExpr(*query)
    text = query.strip()
    if not text:
        raise ValueError("a SQL projection needs a query")
    if "{input}" not in text:
        text = f"SELECT {text} FROM {{input}}"
    return df.sparkSession.sql(text, input=df)


def custom(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user function from DataFrame to DataFrame (PySpark block, custom code)."""
    result = fn(df)
    if not isinstance(result, DataFrame):
        raise ValueError("a custom block must return a DataFrame")
    return result


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Leave columns out; unknown names are ignored."""
    return df.drop(*columns)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename all columns at once, so two names can be swapped. Unknown names are ignored."""
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def cast(df: DataFrame, column: str, data_type: str, mode: str = "strict") -> DataFrame:
    """``strict`` fails on text that does not parse (ANSI), ``try`` gives null."""
    if mode not in ("strict", "try"):
        raise ValueError("mode must be strict or try")
    source = F.col(column)
    return df.withColumn(
        column, source.cast(data_type) if mode == "strict" else source.try_cast(data_type)
    )


def reorder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in this order; the others are left out."""
    return df.select(*columns)


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def drop_nulls(df: DataFrame, how: str = "any", subset: Sequence[str] = ()) -> DataFrame:
    """Drop rows with any / only nulls in ``subset``; an empty subset means all columns."""
    if how not in ("any", "all"):
        raise ValueError("how must be any or all")
    return df.dropna(how=how, subset=list(subset) or df.columns)


def _follow(mapping: Mapping[object, object]) -> dict[object, object]:
    """Where each value ends when the entries are applied once each in sorted order."""
    ordered = sorted(mapping.items(), key=lambda entry: str(entry[0]))

    def end(value: object) -> object:
        for old, new in ordered:
            if value == old:
                value = new
        return value

    return {old: end(old) for old, _ in ordered}


def replace(
    df: DataFrame, column: str, mapping: Mapping[object, object], chained: bool = True
) -> DataFrame:
    """Replace whole values. Chained, ``{A: B, B: C}`` turns A into C; otherwise into B.

    Chains are followed here, over the mapping, so the plan holds one flat CASE
    whatever the mapping's size.
    """
    entries = list((_follow(mapping) if chained else mapping).items())
    if not entries:
        return df
    source = F.col(column)
    (first_old, first_new), *rest = entries
    case = F.when(source == F.lit(first_old), F.lit(first_new))
    for old, new in rest:
        case = case.when(source == F.lit(old), F.lit(new))
    return df.withColumn(column, case.otherwise(source))


def flatten_struct(df: DataFrame, column: str) -> DataFrame:
    """Put the struct's fields after the other columns; a field whose name is taken
    gets the prefix ``<column>_``.
    """
    struct = df.schema[column].dataType
    if not isinstance(struct, StructType):
        raise ValueError(f"{column} is not a struct")
    others = [c for c in df.columns if c != column]
    fields = [
        F.col(column)[name].alias(f"{column}_{name}" if name in others else name)
        for name in struct.fieldNames()
    ]
    return df.select(*[F.col(f"`{c}`") for c in others], *fields)


def build_struct(df: DataFrame, target: str, fields: Mapping[str, str]) -> DataFrame:
    """A struct column with its fields in name order."""
    if not fields:
        raise ValueError("a struct needs fields")
    parts = [as_column(fields[name]).alias(name) for name in sorted(fields)]
    return df.withColumn(target, F.struct(*parts))


def build_map(
    df: DataFrame, target: str, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    if len(keys) != len(values) or not keys:
        raise ValueError("a map needs as many values as keys, and at least one")
    pairs = [as_column(part) for pair in zip(keys, values, strict=True) for part in pair]
    return df.withColumn(target, F.create_map(*pairs))


def build_array(df: DataFrame, target: str, expressions: Sequence[str]) -> DataFrame:
    return df.withColumn(target, F.array(*[as_column(e) for e in expressions]))


def json_parse(
    df: DataFrame, column: str, schema: str, target: str, corrupt: str | None = None
) -> DataFrame:
    """Parse JSON text with a DDL schema; malformed text gives null fields.

    ``corrupt`` names a column that receives the text that did not parse.
    """
    if corrupt is None:
        return df.withColumn(target, F.from_json(F.col(column), schema))
    parsed = F.from_json(
        F.col(column),
        f"{schema}, {corrupt} STRING",
        {"columnNameOfCorruptRecord": corrupt, "mode": "PERMISSIVE"},
    )
    return (
        df.withColumn("__parsed", parsed)
        .withColumn(corrupt, F.col("__parsed")[corrupt])
        .withColumn(target, F.col("__parsed").dropFields(corrupt))
        .drop("__parsed")
    )


def _is_map(df: DataFrame, column: str) -> bool:
    return isinstance(df.select(column).schema[0].dataType, MapType)


def explode(df: DataFrame, column: str, target: str, outer: bool = False) -> DataFrame:
    """One row per element; maps give ``<target>_key`` and ``<target>_value``.

    Rows with a null or empty collection are dropped unless ``outer``.
    """
    generate = F.explode_outer if outer else F.explode
    if _is_map(df, column):
        names = [f"{target}_key", f"{target}_value"]
    else:
        names = [target]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*kept, generate(F.col(column)).alias(*names))


def posexplode(
    df: DataFrame, column: str, target: str, position: str = "pos", outer: bool = False
) -> DataFrame:
    """Like :func:`explode`, with the element's 0-based position."""
    generate = F.posexplode_outer if outer else F.posexplode
    if _is_map(df, column):
        names = [position, f"{target}_key", f"{target}_value"]
    else:
        names = [position, target]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*kept, generate(F.col(column)).alias(*names))
