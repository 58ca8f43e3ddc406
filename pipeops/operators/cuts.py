"""Cutting a table along a whole sort order into chunks of about equal size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipeops.functions import sort_directions

#: About how many sampled rows cuts are chosen from: what reaches the driver, whatever the input holds.
SAMPLE = 20_000
#: Rows a chunk should hold, and the most chunks that are cut (each has a few dozen sampled rows).
ROWS_PER_CHUNK, MOST_CHUNKS = 25_000, 512


def row_hash(df: DataFrame) -> Column:
    """A number from all columns that can be hashed, which orders rows that are else equal."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if not _unhashable(f.dataType)]
    return F.xxhash64(*plain) if plain else F.lit(0)


def _unhashable(kind: T.DataType) -> bool:
    text = kind.simpleString()
    return "map<" in text or "variant" in text


def _cuttable(column: Column, kind: T.DataType) -> Column | None:
    """The column in a form with the same order whose text gives the value back, if there is one."""
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    kept = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)
    return column if isinstance(kind, kept) else None


def chunk_number(
    df: DataFrame, order: Sequence, partition_by: Sequence[Column] = (), chunks: int | None = None, rows_per_chunk: int = ROWS_PER_CHUNK
) -> Column:
    """An expression that numbers chunks along ``order`` (names, ``"x DESC"`` texts or tuples) inside partitions.

    Cuts are taken from a uniform sample of about ``SAMPLE`` rows over a hash of the partition
    and the whole tuple, so many equal first values are cut by the next ones, a large partition
    is cut and small ones stay whole; rows equal in the tuple share a chunk (the tuple ends
    before a column of a type that holds others, if any). Counting and sampling are two jobs
    over the order's columns when the plan is made; the cuts are then constants of the plan,
    so a recomputed task numbers its rows as before.
    """
    keys = [(F.xxhash64(*partition_by), False, False)] if partition_by else []
    directions = sort_directions(order)
    kinds = [f.dataType for f in df.select(*[c.alias(f"f{j}") for j, (c, _, _) in enumerate(directions)]).schema]
    for (column, down, last), kind in zip(directions, kinds, strict=True):
        form = _cuttable(column, kind)
        if form is None:
            break
        keys.append((form, down, last))
    if not keys:
        return F.lit(0)
    fields = [c.alias(f"f{j}") for j, (c, _, _) in enumerate(keys)]
    count = df.count()
    wanted = min(MOST_CHUNKS, chunks or -(-count // rows_per_chunk))
    if wanted <= 1 or not count:
        return F.lit(0)
    drawn = df.select(*fields).where(F.rand(7) < SAMPLE / count)
    ordered = drawn.orderBy(*[_sorted(F.col(f"f{j}"), down, last) for j, (_, down, last) in enumerate(keys)])
    rows = ordered.select(*[F.col(f"f{j}").cast("string") for j in range(len(keys))]).collect()
    cuts = sorted({len(rows) * i // wanted for i in range(1, wanted)} - {0})
    bounds = list(dict.fromkeys(tuple(rows[i - 1]) for i in cuts))
    if not bounds:
        return F.lit(0)
    kinds = [f.dataType for f in df.select(*fields).schema]
    listed = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(f"b{j}") for j, (v, kind) in enumerate(zip(b, kinds, strict=True))]) for b in bounds])

    def past(bound: Column) -> Column:
        """Whether the row comes after the bound."""
        after = F.lit(False)
        for j in reversed(range(len(keys))):
            column, down, last = keys[j]
            value = bound[f"b{j}"]
            more = (column < value) if down else (column > value)
            differs = F.when(column.isNull(), F.lit(last)).when(value.isNull(), F.lit(not last)).otherwise(more)
            after = F.when(column.eqNullSafe(value), after).otherwise(differs)
        return after

    # a binary search: the number of bounds before the row
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(at + step <= len(bounds), F.when(past(F.get(listed, at + step - 1)), at + step).otherwise(at)).otherwise(at),
    )


def _sorted(column: Column, descending: bool, nulls_last: bool) -> Column:
    if descending:
        return column.desc_nulls_last() if nulls_last else column.desc_nulls_first()
    return column.asc_nulls_last() if nulls_last else column.asc_nulls_first()
