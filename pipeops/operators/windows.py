"""Window expressions, plain and split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pipeops.functions import as_column, key_struct, sort_directions, sort_keys

from .cuts import ROWS_PER_CHUNK, chunk_number, row_hash

_EDGES = {
    "unbounded preceding": Window.unboundedPreceding,
    "unbounded following": Window.unboundedFollowing,
    "current row": Window.currentRow,
}


def _edge(value: object) -> int:
    return _EDGES[value.lower()] if isinstance(value, str) else int(value)


def window(
    df: DataFrame,
    target: str,
    expression: str | Column,
    partition_by: Sequence[str] = (),
    order_by: Sequence = (),
    frame: tuple | None = None,
) -> DataFrame:
    """Add ``expression OVER (PARTITION BY .. ORDER BY .. frame)`` (batch only).

    ``frame`` is ``("rows" | "range", low, high)``, the edges being numbers or
    ``"unbounded preceding"``, ``"current row"``, ``"unbounded following"``.

    Spark runs one partition value in one task. Where a value may hold a large
    share of the rows, use :func:`split_window`; for an aggregate over whole
    partitions it is chosen here already: without order and frame the aggregate
    is computed with partial sums and joined back.
    """
    if not target:
        raise ValueError("a window needs a target column")
    if not order_by and frame is None and _plain_aggregate(expression):
        return _whole_partition(df, target, expression, list(partition_by))
    spec = Window.partitionBy(*[as_column(c) for c in partition_by])
    if order_by:
        spec = spec.orderBy(*sort_keys(order_by))
    if frame is not None:
        kind, low, high = frame
        if kind not in ("rows", "range"):
            raise ValueError("a frame is of kind rows or range")
        edges = (_edge(low), _edge(high))
        spec = spec.rowsBetween(*edges) if kind == "rows" else spec.rangeBetween(*edges)
    return df.withColumn(target, as_column(expression).over(spec))


def _plain_aggregate(expression: str | Column) -> bool:
    """Aggregates that combine from parts and ignore the order of rows."""
    if not isinstance(expression, str):
        return False
    name = expression.strip().lower().partition("(")[0].strip()
    return name in ("count", "sum", "avg", "mean", "min", "max") and "distinct" not in expression.lower()


def _whole_partition(
    df: DataFrame, target: str, expression: str, keys: Sequence[str]
) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in df.columns if c != target]
    if not keys:
        total = df.agg(as_column(expression).alias(target))
        # One row: the broadcast cannot grow with the data.
        return df.select(*kept).crossJoin(F.broadcast(total))
    keyed = df.withColumn("__key", key_struct([as_column(k) for k in keys]))
    totals = keyed.groupBy("__key").agg(as_column(expression).alias("__total"))
    joined = keyed.join(totals, "__key")
    return joined.select(*kept, F.col("__total").alias(target))


RANKINGS = ("row_number", "place", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
RUNNING = ("count", "sum", "min", "max", "avg")
OFFSETS = ("lag", "lead")
#: Functions that do not see whether rows are equal in the order.
TIE_BLIND = ("row_number", "place", "ntile", "lag", "lead")


def split_window(
    df: DataFrame,
    target: str,
    function: str,
    order_by: Sequence,
    argument: str | None = None,
    partition_by: Sequence[str] = (),
    split_by: str | Column | None = None,
    splits: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """A window function whose partitions may be of any size; see :func:`split_windows`.

    ``buckets`` is the argument of ``ntile``.
    """
    extra = buckets if function == "ntile" else argument
    return split_windows(df, {target: (function, extra)}, order_by, partition_by, split_by, splits)


def split_windows(
    df: DataFrame,
    targets: Mapping[str, tuple[str, str | int | None]],
    order_by: Sequence,
    partition_by: Sequence[str] = (),
    split_by: str | Column | None = None,
    splits: int | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Window functions over partitions of any size, even the whole table.

    The table is cut along partition keys and the whole order into chunks. The functions run
    inside the chunks, in as many tasks as there are chunks; one summary row per chunk and key
    then carries what the chunks before it hold. Results are the same as :func:`window`
    gives. All targets share the shuffle, the sort and the summary.

    ``targets`` maps a column name to a function and its argument: ``row_number, place`` (the
    same as a long), ``rank, dense_rank, percent_rank, cume_dist`` (none), ``ntile`` (number of
    buckets), ``count, sum, min, max, avg`` up to the current row and its ties, or ``lag,
    lead`` by one row (an expression). :func:`pipeops.operators.split_frame` has the other frames.

    Cuts come from a sample (see :func:`pipeops.operators.cuts.chunk_number`), as many as
    ``splits`` says or the size of the table asks for. Where no function sees ties, rows equal
    in the order are cut as well, by a hash of the row; else they share a chunk. ``split_by``
    spares the sample: an expression that never decreases in sort order, such as
    ``date_trunc('day', ts)``; equal order values must fall in one chunk.
    """
    if not order_by:
        raise ValueError("a split window needs an order")
    plans = [_Split(i, *spec) for i, spec in enumerate(targets.values())]
    keys = [as_column(k) for k in partition_by]
    work = df
    if split_by is not None:
        chunk = as_column(split_by)
    else:
        if all(plan.function in TIE_BLIND for plan in plans):
            work, order_by = df.withColumn("__tie", row_hash(df)), [*order_by, "__tie"]
        chunk = chunk_number(work, order_by, keys, splits, rows_per_chunk)
    order = sort_keys(order_by)

    # Rows, chunk summaries and what is carried over all meet on one key, so the rows
    # are shuffled once.
    work = work.withColumn("__key", key_struct([*keys, chunk]))
    for plan in plans:
        if plan.needs_argument:
            work = work.withColumn(plan.name("arg"), as_column(plan.argument))
    inside = Window.partitionBy("__key").orderBy(*order)
    place = F.col(f"__key.k{len(keys)}")
    whole = Window.partitionBy(*[F.col(f"__key.k{i}") for i in range(len(keys))])
    chunks = whole.orderBy(place.asc_nulls_first())

    rows = work.select("*", *[c for plan in plans for c in plan.local(inside)])
    joined = rows
    counted = [plan for plan in plans if plan.function not in OFFSETS]
    if counted:
        tie = F.struct(*[_order_value(spec) for spec in order_by])
        parts = [F.count(F.lit(1)).alias("__rows"), *[c for p in counted for c in p.summary(tie)]]
        summary = work.groupBy("__key").agg(*parts)
        carry = summary.select("__key", *[c for p in counted for c in p.carried(whole, chunks)])
        joined = joined.join(carry, "__key")
    for plan in plans:
        if plan.function in OFFSETS:
            # One row per chunk: the value that the neighbouring chunk needs.
            edges = rows.where(F.col(plan.name("far"))).select("__key", plan.name("arg"))
            beyond = plan.step(plan.name("arg")).over(chunks).alias(plan.name("beyond"))
            joined = joined.join(edges.select("__key", beyond), "__key")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in targets]
    return joined.select(
        *kept, *[plan.result().alias(target) for target, plan in zip(targets, plans, strict=True)]
    )


def _order_value(spec: object) -> Column:
    return spec if isinstance(spec, Column) else sort_directions([spec])[0][0]


class _Split:
    """How one function is put together from its chunks. Column names end in its number."""

    def __init__(self, number: int, function: str, argument: str | int | None = None) -> None:
        if function not in RANKINGS + RUNNING + OFFSETS:
            raise ValueError(f"a split window does not know {function!r}")
        self.number, self.function, self.argument = number, function, argument
        self.needs_argument = function in RUNNING + OFFSETS
        if argument is None and (self.needs_argument or function == "ntile"):
            raise ValueError(f"{function} needs an argument")

    def name(self, part: str) -> str:
        return f"__{part}{self.number}"

    def _col(self, part: str) -> Column:
        return F.col(self.name(part))

    def _is(self, *functions: str) -> bool:
        return self.function in functions

    def step(self, column: str) -> Column:
        return F.lag(column) if self._is("lag") else F.lead(column)

    def local(self, inside: WindowSpec) -> list[Column]:
        """What the function gives inside a chunk."""
        made: dict[str, Column] = {}
        if self._is("row_number", "place", "ntile"):
            made["local"] = F.row_number().over(inside)
        elif self._is("rank", "percent_rank"):
            made["local"] = F.rank().over(inside)
        elif self._is("dense_rank"):
            made["local"] = F.dense_rank().over(inside)
        elif self._is("cume_dist"):
            made["local"] = F.count(F.lit(1)).over(inside)
        elif self._is("min", "max"):
            made["local"] = self._extreme(self.name("arg")).over(inside)
        elif self._is("lag", "lead"):
            first = F.row_number().over(inside) == 1
            last = F.lead(F.lit(False), 1, True).over(inside)
            made["edge"], made["far"] = (first, last) if self._is("lag") else (last, first)
            made["near"] = self.step(self.name("arg")).over(inside)
        if self._is("sum", "avg"):
            made["local_sum"] = F.sum(self.name("arg")).over(inside)
        if self._is("count", "avg"):
            made["local_count"] = F.count(self.name("arg")).over(inside)
        return [column.alias(self.name(part)) for part, column in made.items()]

    def _extreme(self, column: str) -> Column:
        return F.min(column) if self._is("min") else F.max(column)

    def summary(self, tie: Column) -> list[Column]:
        """Aggregates of a whole chunk."""
        made: dict[str, Column] = {}
        if self._is("dense_rank"):
            made["ties"] = F.count_distinct(tie)
        if self._is("sum", "avg"):
            made["sum"] = F.sum(self.name("arg"))
        if self._is("count", "avg"):
            made["count"] = F.count(self.name("arg"))
        if self._is("min", "max"):
            made["extreme"] = self._extreme(self.name("arg"))
        return [column.alias(self.name(part)) for part, column in made.items()]

    def carried(self, whole: WindowSpec, chunks: WindowSpec) -> list[Column]:
        """What the chunks before a chunk hold, over the chunk summaries."""
        before = chunks.rowsBetween(Window.unboundedPreceding, -1)
        made: dict[str, Column] = {}
        if self._is(*RANKINGS):
            rows = self.name("ties") if self._is("dense_rank") else "__rows"
            made["before"] = F.coalesce(F.sum(rows).over(before), F.lit(0))
            made["total"] = F.sum("__rows").over(whole)
        if self._is("sum", "avg"):
            made["sum_before"] = F.sum(self.name("sum")).over(before)
        if self._is("count", "avg"):
            made["count_before"] = F.coalesce(F.sum(self.name("count")).over(before), F.lit(0))
        if self._is("min", "max"):
            made["before"] = self._extreme(self.name("extreme")).over(before)
        return [column.alias(self.name(part)) for part, column in made.items()]

    def result(self) -> Column:
        if self._is("lag", "lead"):
            return F.when(self._col("edge"), self._col("beyond")).otherwise(self._col("near"))
        if self._is("min", "max"):
            pick = F.least if self._is("min") else F.greatest
            return pick(self._col("local"), self._col("before"))
        if self._is("count"):
            return self._col("local_count") + self._col("count_before")
        if self._is("sum", "avg"):
            here, before = self._col("local_sum"), self._col("sum_before")
            # Null while no value has come yet.
            total = F.coalesce(here + before, here, before)
            if self._is("sum"):
                return total
            return F.try_divide(total, self._col("local_count") + self._col("count_before"))
        position, rows = self._col("local") + self._col("before"), self._col("total")
        if self._is("percent_rank"):
            share = (position - 1) / (rows - 1).cast("double")
            return F.when(rows > 1, share).otherwise(F.lit(0.0))
        if self._is("cume_dist"):
            return position / rows.cast("double")
        if self._is("ntile"):
            # The first `more` buckets hold one row more than the others.
            size, more = F.floor(rows / self.argument), rows % self.argument
            past = position - 1 - more * (size + 1)
            bucket = F.when(past < 0, F.floor((position - 1) / (size + 1))).otherwise(
                more + F.floor(past / F.greatest(size, F.lit(1)))
            )
            return (bucket + 1).cast("int")
        return position if self._is("place") else position.cast("int")
