"""Column profiles of whole tables, and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, MapType, NumericType, StructType

# The metrics two profiles are compared by.
COMPARED = ("count", "null_count", "distinct_count", "min", "max")


def _comparable(column: Column, data_type: DataType) -> Column:
    return F.to_json(column) if isinstance(data_type, MapType) else column


def _chosen(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return sorted(columns or df.columns)


def profile(
    df: DataFrame,
    columns: Sequence[str] = (),
    include_sensitive: bool = True,
    approx: bool = False,
) -> DataFrame:
    """One row per column: row count, nulls, distinct non-null values, and for numbers min,
    max, mean and population stddev.

    All but exact distinct counts come from one aggregate that is combined in every task. For
    exact ones the columns are turned into rows of column and value, and equal ones are
    combined before the one shuffle of them, whatever the number of columns; a value that
    half of the rows have is one row a task. ``approx=True`` uses a sketch in the first
    aggregate instead, as the column ``distinct_exact`` tells. ``include_sensitive=False``
    leaves the value-bearing metrics out.
    """
    names = _chosen(df, columns)
    if not names:
        raise ValueError("nothing to profile")
    types = {f.name: f.dataType for f in df.schema.fields}
    parts: list[Column] = [F.count(F.lit(1)).alias("__n")]
    rows: list[Column] = []
    for i, name in enumerate(names):
        column, numeric = F.col(f"`{name}`"), isinstance(types[name], NumericType)
        parts.append(F.count(column).alias(f"__p{i}"))
        if approx:
            parts.append(F.approx_count_distinct(_comparable(column, types[name])).alias(f"__d{i}"))
        if numeric and include_sensitive:
            parts += [
                F.min(column).cast("double").alias(f"__min{i}"),
                F.max(column).cast("double").alias(f"__max{i}"),
                F.avg(column).cast("double").alias(f"__avg{i}"),
                F.stddev_pop(column).alias(f"__std{i}"),
            ]
        fields = [
            F.lit(name).alias("column"),
            F.col("__n").alias("count"),
            (F.col("__n") - F.col(f"__p{i}")).alias("null_count"),
            (F.col(f"__d{i}") if approx else F.lit(None).cast("long")).alias("distinct_count"),
            F.lit(not approx).alias("distinct_exact"),
        ]
        if include_sensitive:
            for metric, prefix in (("min", "min"), ("max", "max"), ("mean", "avg"), ("stddev", "std")):
                held = F.col(f"__{prefix}{i}") if numeric else F.lit(None).cast("double")
                fields.append(held.alias(metric))
        rows.append(F.struct(*fields))
    told = df.agg(*parts).select(F.inline(F.array(*rows)))
    if approx:
        return told
    # two small tables: a row per column each
    distinct = _values(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("__distinct"))
    met = told.join(distinct, "column", "left").withColumn("distinct_count", F.coalesce("__distinct", F.lit(0).cast("long")))
    return met.select(told.columns)


def _values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column, value, count``: how often each non-null value occurs, as a text that tells values apart."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(name: str) -> Column:
        column, kind = F.col(f"`{name}`"), types[name]
        if isinstance(kind, FloatType | DoubleType):
            column = column + F.lit(0).cast(kind)  # there is one zero
        elif isinstance(kind, BinaryType):
            return F.base64(column)
        elif isinstance(kind, ArrayType | MapType | StructType):
            return F.to_json(column, {"ignoreNullFields": "false"})
        return column.cast("string")

    pairs = F.array(*[F.struct(F.lit(n).alias("column"), text(n).alias("value")) for n in names])
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, columns: Sequence[str] = (), top: int = 5) -> DataFrame:
    """The most frequent values of the columns that are not numbers, by count and then
    value, as text: ``(column, rank, value, count)``.

    Values are counted before and after one shuffle by (column, value); Spark then
    keeps ``top`` rows per column in each task before they meet.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in _chosen(df, columns) if not isinstance(types[n], NumericType)]
    if not names:
        raise ValueError("there are no columns with other values than numbers")
    counts = _values(df, names)
    by_count = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    ranked = counts.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= top)
    return ranked.select("column", "rank", "value", "count")


def profile_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str] = ("column",)
) -> DataFrame:
    """Two profiles compared metric by metric: ``(keys.., metric, status, reason, before,
    after, delta, relative_delta)``.

    A column on one side only, or a metric that is null or not finite, has the status
    ``insufficient_data``; the relative delta is null where the value before is 0.
    """
    keys = list(keys)
    sides = ("before", "after")

    def marked(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in COMPARED], F.lit(side).alias("__side"))

    # the two sides of a column meet in one row, which then gives a row per metric
    wide = marked(before, "before").unionByName(marked(after, "after")).groupBy(*keys).agg(
        *[F.max(F.when(F.col("__side") == s, F.col(m))).alias(f"__{s}_{m}") for s in sides for m in COMPARED],
        sum((F.max((F.col("__side") == s).cast("int")) for s in sides), F.lit(0)).alias("__sides"),
    )
    metrics = [F.struct(F.lit(m).alias("metric"), *[F.col(f"__{s}_{m}").alias(s) for s in sides]) for m in COMPARED]
    met = wide.select(*keys, "__sides", F.inline(F.array(*metrics)))

    def usable(name: str) -> Column:
        c = F.col(name)
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))

    one_sided = F.col("__sides") < 2
    valid = ~one_sided & usable("before") & usable("after")
    delta = F.when(valid, F.col("after") - F.col("before"))
    return met.select(
        *keys,
        "metric",
        F.when(valid, "ok").otherwise("insufficient_data").alias("status"),
        F.when(one_sided, "column_added_or_removed").alias("reason"),
        "before",
        "after",
        delta.alias("delta"),
        F.when(F.col("before") != 0, delta / F.col("before")).alias("relative_delta"),
    )
