"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeops.session import scratch

# Every octave of magnitude is cut into this many buckets, so that a group has a few
# hundred at most for integers, whatever its size.
_STEPS = 16
# A bucket that holds a rank is cut into this many parts once more.
_FINE = 1024


def _bucket(value: Column) -> Column:
    """An integer that never decreases as the value grows."""
    size = F.floor(F.log2(F.abs(value.cast("double")) + 1) * _STEPS).cast("int")
    return F.when(value < 0, -size - 1).otherwise(size)


def _narrowed(counted: DataFrame, group: list[str], cell: Column, targets: DataFrame | None, wanted: Column | None) -> DataFrame:
    """The cells that hold a rank: ``group.., __cell, __from, __ranks, __low, __high``; at most one row per group and rank.

    ``targets`` has the ranks of each group and the number of values before it; without it
    groups begin at 0 and ``wanted`` makes the ranks from ``n``.
    """
    histogram = counted.groupBy(*group, cell.alias("__cell")).agg(
        F.sum("__c").alias("__bc"), F.min("__v").alias("__low"), F.max("__v").alias("__high")
    )
    whole = Window.partitionBy(*group)
    up_to = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = histogram.withColumn("n", F.sum("__bc").over(whole)).withColumn("__to", F.sum("__bc").over(up_to))
    if targets is None:
        placed = placed.withColumns({"__begin": F.lit(0).cast("long"), "__asked": wanted})
    else:
        placed = placed.join(targets.select(*group, F.col("__from").alias("__begin"), F.col("__ranks").alias("__asked")), group)
    upto = F.col("__begin") + F.col("__to")
    before = upto - F.col("__bc")
    inside = F.filter("__asked", lambda r: (r["rank"] > before) & (r["rank"] <= upto))
    held = placed.select(*group, "__cell", before.alias("__from"), inside.alias("__ranks"), "__low", "__high")
    return held.where(F.size("__ranks") > 0)


def _stored(df: DataFrame) -> DataFrame:
    """The same rows from a scratch folder, so that their size is known where a join is planned."""
    folder = scratch(df.sparkSession, "quantiles")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], count: str | None = None
) -> DataFrame:
    """One row per group with the value at each requested rank. Keys must not be null.

    ``ranks`` maps an output name to a 1-based rank written over the column ``n``,
    the number of non-null values in the group, and the keys; a null rank asks for nothing.

    The input is read three times, each time combined before a shuffle, and is not shuffled
    itself while the cells of all groups are small enough for Spark to broadcast: keep in files
    what is costly to make. A histogram over buckets of magnitude tells which bucket holds each
    rank, a second one over ``_FINE`` equal cuts of that bucket's values which part of it; only
    the distinct values of that part, each counted once, are put in order. Buckets and parts, at
    most one row per group and rank, are kept in scratch folders. ``count`` names a column that
    tells how often a row's value is there.
    """
    keys = list(keys)
    often = F.lit(1).cast("long") if count is None else F.col(count)
    counted = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), often.alias("__c"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()])
    # never null, so that joins need no filter that would make it once more
    coarse = F.coalesce(_bucket(F.col("__v")), F.lit(0))
    buckets = _stored(_narrowed(counted, keys, coarse, None, wanted).withColumnRenamed("__cell", "__b"))
    part = [*keys, "__b"]
    span = F.col("__high").cast("double") - F.col("__low").cast("double")
    share = (F.col("__v").cast("double") - F.col("__low").cast("double")) / span
    fine = F.when(span > 0, F.floor(share * (_FINE - 1))).otherwise(F.lit(0)).cast("int")
    inner = counted.withColumn("__b", coarse).join(buckets.select(*part, "__low", "__high"), part).withColumn("__f", fine)
    cells = _stored(_narrowed(inner.drop("__low", "__high"), part, F.col("__f"), buckets, None).withColumnRenamed("__cell", "__f"))
    cell = [*part, "__f"]
    distinct = inner.join(cells.select(*cell), cell).groupBy(*cell, "__v").agg(F.sum("__c").alias("__c"))
    running = Window.partitionBy(*cell).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = distinct.join(cells.select(*cell, "__from", "__ranks"), cell)
    placed = ordered.withColumn("__upto", F.col("__from") + F.sum("__c").over(running))
    hit = F.filter("__ranks", lambda r: (r["rank"] <= F.col("__upto")) & (r["rank"] > F.col("__upto") - F.col("__c")))
    hits = placed.select(*keys, "__v", F.explode(hit).alias("__r"))
    return hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__r.name") == name, F.col("__v"))).alias(name) for name in ranks]
    )
