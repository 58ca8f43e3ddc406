"""Window frames and value functions over partitions of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeops.functions import as_column, key_struct, sort_directions

from .cuts import ROWS_PER_CHUNK
from .windows import split_windows

#: Functions of a frame that has an open side: they are put together from chunk to chunk.
RUNNING = ("count", "sum", "avg", "min", "max", "first_value", "last_value", "nth_value")
OFFSETS = ("lag", "lead")
_OPEN = {"unbounded preceding", "unbounded following"}
_SWAPPED = {"first_value": "last_value", "last_value": "first_value"}


def places(
    df: DataFrame, order_by: Sequence, target: str = "place", partition_by: Sequence = (), splits: int | None = None, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Each row's place, from 1, in the order of its partition or of the whole table, as a long.

    Chunks of the order are counted, and the counts before a chunk are what its rows' own
    numbers start from: the place of a sorted result without one task that sees all rows.
    Rows that are equal in the order are placed by a hash of the row.
    """
    return split_windows(df, {target: ("place", None)}, order_by, partition_by, splits=splits, rows_per_chunk=rows_per_chunk)


def split_frame(
    df: DataFrame,
    target: str,
    function: str | Column,
    order_by: Sequence,
    argument: str | Column | None = None,
    partition_by: Sequence = (),
    frame: tuple = ("rows", "unbounded preceding", "current row"),
    offset: int = 1,
    default: object = None,
    ignore_nulls: bool = False,
    splits: int | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """A frame or value function over partitions of any size, equal to :func:`window`.

    ``function`` is one of ``count, sum, avg, min, max, first_value, last_value, nth_value``
    (of ``argument``; ``offset`` is the n of ``nth_value``; the values may skip nulls), ``lag``
    or ``lead`` by ``offset`` rows with a ``default``, or, in a frame bounded on both sides, any
    aggregate as an expression or Column (no ``argument``).

    ``frame`` is given as for :func:`window`. Over rows, a row's place in its partition is
    found first (:func:`places`) and places are cut into chunks of ``rows_per_chunk``:

    * a bounded frame reaches a known number of rows into the chunks beside its own, and those
      rows are copied there (a halo), so that Spark's window sees all it needs in one chunk;
    * a frame open to one side adds what the chunks before its own hold, one summary row each.

    A bounded range over a single numeric order column is cut by value into buckets as wide as
    the frame, so a row is copied to the one bucket beside its own that can reach it. A range
    open to one side is a running aggregate over rows and, beside them, one question per row
    placed at its frame's edge. Rows with a null order value see each other.
    """
    kind, low, high = frame
    if kind not in ("rows", "range"):
        raise ValueError("a frame is of kind rows or range")
    low, high = _edge(low), _edge(high)
    named = isinstance(function, str) and function in RUNNING + OFFSETS
    if named and argument is None:
        raise ValueError(f"{function} needs an argument")
    if isinstance(function, str) and function in OFFSETS:
        kind, low, high = "rows", *((-offset, -offset) if function == "lag" else (offset, offset))
    if low is None and high is None and not named:
        raise ValueError("an expression needs a frame bounded on both sides")
    if (low is None) != (high is None) and not named:
        raise ValueError("an expression needs a frame bounded on both sides")
    keys = [as_column(k) for k in partition_by]
    value = as_column(argument) if argument is not None else F.lit(None)
    work = df.withColumn("__arg", value).withColumn("__part", key_struct(keys or [F.lit(0)]))
    if kind == "range":
        made = _range(work, function, order_by, low, high, ignore_nulls, offset, splits, rows_per_chunk)
    else:
        made = _rows(work, function, order_by, low, high, offset, default, ignore_nulls, splits, rows_per_chunk)
    return made.select(*[F.col(f"`{c}`") for c in df.columns if c != target], F.col("__result").alias(target))


def _edge(value: object) -> int | None:
    """An offset in rows or values; None where the frame is open."""
    if isinstance(value, str):
        if value.lower() in _OPEN:
            return None
        if value.lower() != "current row":
            raise ValueError(f"unknown edge {value!r}")
        return 0
    if abs(int(value)) >= 1 << 62:  # Window.unboundedPreceding and -Following
        return None
    return int(value)


def _over(function: str | Column, frame, offset: int, ignore_nulls: bool, default: object = None) -> Column:
    """The function of a window that holds every row its frames need."""
    arg = F.col("__arg")
    if not isinstance(function, str) or function not in RUNNING + OFFSETS:
        return as_column(function).over(frame)
    if function in ("lag", "lead"):
        return (F.lag if function == "lag" else F.lead)(arg, offset, default).over(frame)
    if function == "first_value":
        return F.first(arg, ignore_nulls).over(frame)
    if function == "last_value":
        return F.last(arg, ignore_nulls).over(frame)
    if function == "nth_value":
        return F.nth_value(arg, offset, ignore_nulls).over(frame)
    return getattr(F, function)(arg).over(frame)


def _rows(work, function, order_by, low, high, offset, default, ignore_nulls, splits, size) -> DataFrame:
    if low is not None and high is not None and low > high:
        raise ValueError("a frame's low edge is above its high edge")
    if function == "nth_value" and (low is None or high is None):
        if ignore_nulls:
            raise ValueError("nth_value skips nulls in bounded frames only")
        if low is not None:
            # the nth row of a frame that is open at its end lies within n rows of its beginning
            high = low + offset - 1 if low >= 0 else offset - 1
    if low is not None and high is None:
        # a frame open to its end is one open to its beginning in the order turned round
        turned = [(c, "asc" if down else "desc", "first" if last else "last") for c, down, last in sort_directions(order_by)]
        return _rows(work, _SWAPPED.get(function, function), turned, None, -low, offset, default, ignore_nulls, splits, size)
    placed = places(work, order_by, "__place", ["__part"], splits, size)
    if low is None and high is None:
        return _whole(placed, function, offset, ignore_nulls)
    if low is not None:
        return _halo(placed, function, low, high, offset, default, ignore_nulls, max(size, abs(low), abs(high)))
    return _prefixed(placed, function, high, offset, ignore_nulls, max(size, abs(high)))


def _copied(placed: DataFrame, first: Column, last: Column, own: Column) -> DataFrame:
    """Rows sent to all chunks from ``first`` to ``last``; ``__own`` in the one they belong to."""
    return placed.withColumn("__chunk", F.explode(F.sequence(first, last))).withColumn("__own", F.col("__chunk") == own)


def _halo(placed, function, low, high, offset, default, ignore_nulls, size) -> DataFrame:
    at = F.col("__place") - 1
    own = F.floor(at / size)
    first = F.greatest(F.lit(0).cast("long"), F.least(own, F.floor((at - high) / size)))
    # a chunk past the partition's end has no row of its own and gives none
    last = F.greatest(own, F.floor((at - low) / size))
    sent = _copied(placed, first, last, own)
    inside = Window.partitionBy("__part", "__chunk").orderBy("__place")
    frame = inside if function in OFFSETS else inside.rowsBetween(low, high)
    return sent.withColumn("__result", _over(function, frame, offset, ignore_nulls, default)).where("__own")


def _parts(function: str, offset: int, ignore_nulls: bool) -> list[tuple[str, Column]]:
    """Aggregates of a stretch of rows that can be put together, as ``(how, aggregate)``."""
    arg = F.col("__arg")
    if function == "count":
        return [("add", F.count(arg))]
    if function == "sum":
        return [("add", F.sum(arg))]
    if function == "avg":
        return [("add", F.sum(arg)), ("add", F.count(arg))]
    if function in ("min", "max"):
        return [(function, getattr(F, function)(arg))]
    # a struct tells a null value from no row
    held = F.struct(arg.alias("v"))
    if ignore_nulls:
        held = F.when(arg.isNotNull(), held)
    if function == "nth_value":
        held = F.when(F.col("__place") == offset, held)
    ranked = F.struct(F.col("__place").alias("p"), held.alias("h"))
    chosen = F.when(held.isNotNull(), ranked)
    # places decide, as rows of a group come in any order
    return [("last", F.max_by(chosen, F.when(chosen.isNotNull(), F.col("__place"))))] if function == "last_value" else [("first", F.min_by(chosen, F.when(chosen.isNotNull(), F.col("__place"))))]


def _joined(how: str, before: Column, here: Column) -> Column:
    if how == "add":
        return F.coalesce(before + here, here, before)
    if how in ("min", "max"):
        return (F.least if how == "min" else F.greatest)(before, here)
    return F.coalesce(here, before) if how == "last" else F.coalesce(before, here)


def _finished(function: str, parts: list[Column]) -> Column:
    if function == "avg":
        return F.try_divide(parts[0], parts[1])
    if function == "count":
        return F.coalesce(parts[0], F.lit(0).cast("long"))
    if function in ("first_value", "last_value", "nth_value"):
        return parts[0]["h"]["v"]
    return parts[0]


def _prefixed(placed, function, high, offset, ignore_nulls, size) -> DataFrame:
    """Frames from the partition's beginning to ``high`` rows past the current one."""
    at = F.col("__place") - 1
    own = F.floor(at / size)
    # an edge before the current row may lie in the chunk before, which is then read whole
    back = 1 if high < 0 else 0
    first = F.greatest(F.lit(0).cast("long"), F.least(own, F.floor((at - max(high, 0)) / size)))
    sent = _copied(placed, first, own + back, own)
    parts = _parts(function, offset, ignore_nulls)
    frame = Window.partitionBy("__part", "__chunk").orderBy("__place").rowsBetween(Window.unboundedPreceding, high)
    local = sent.select("*", *[part.over(frame).alias(f"__here{i}") for i, (_, part) in enumerate(parts)]).where("__own")
    sums = placed.withColumn("__chunk", own).groupBy("__part", "__chunk").agg(*[part.alias(f"__sum{i}") for i, (_, part) in enumerate(parts)])
    earlier = Window.partitionBy("__part").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1 - back)
    carried = sums.select("__part", "__chunk", *[_carried(how, F.col(f"__sum{i}")).over(earlier).alias(f"__before{i}") for i, (how, _) in enumerate(parts)])
    both = local.join(carried, ["__part", "__chunk"])
    whole = [_joined(how, F.col(f"__before{i}"), F.col(f"__here{i}")) for i, (how, _) in enumerate(parts)]
    return both.withColumn("__result", _finished(function, whole))


def _carried(how: str, part: Column) -> Column:
    if how == "add":
        return F.sum(part)
    if how in ("min", "max"):
        return (F.min if how == "min" else F.max)(part)
    return (F.last if how == "last" else F.first)(part, True)


def _whole(placed, function, offset, ignore_nulls) -> DataFrame:
    """One value for a whole partition."""
    parts = _parts(function, offset, ignore_nulls)
    totals = placed.groupBy("__part").agg(*[part.alias(f"__sum{i}") for i, (_, part) in enumerate(parts)])
    result = _finished(function, [F.col(f"__sum{i}") for i in range(len(parts))])
    return placed.join(totals.select("__part", result.alias("__result")), "__part")


def _range(work, function, order_by, low, high, ignore_nulls, offset, splits, size) -> DataFrame:
    if len(order_by) != 1:
        raise ValueError("a range needs a single order column")
    [(column, descending, nulls_last)] = sort_directions(order_by)
    # along a descending order, following values are smaller: the same frame over negated values
    along = -column if descending else column
    work = work.withColumn("__at", along)
    if low is None or high is None:
        return _open_range(work, function, low, high, nulls_last, splits, size)
    if low > high:
        raise ValueError("a frame's low edge is above its high edge")
    width = max(1, high - low)
    own = F.floor(F.col("__at") / width)
    first = F.coalesce(F.least(own, F.floor((F.col("__at") - high) / width)), F.lit(0).cast("long"))
    last = F.coalesce(F.greatest(own, F.floor((F.col("__at") - low) / width)), F.lit(0).cast("long"))
    # null order values are a group of their own, which no number can equal
    sent = work.withColumn("__chunk", F.explode(F.sequence(first, last))).withColumn("__own", F.col("__chunk").eqNullSafe(F.coalesce(own, F.lit(0).cast("long"))))
    inside = Window.partitionBy("__part", "__chunk", F.isnull("__at")).orderBy("__at").rangeBetween(low, high)
    return sent.withColumn("__result", _over(function, inside, offset, ignore_nulls)).where("__own")


def _open_range(work, function, low, high, nulls_last, splits, size) -> DataFrame:
    """Ranges open to one side or both, of count, sum, avg, min and max."""
    if function not in ("count", "sum", "avg", "min", "max"):
        raise ValueError("a range open to one side takes count, sum, avg, min or max; use rows for values")
    if low is None and high is None:
        parts = _parts(function, 0, False)
        totals = work.groupBy("__part").agg(*[part.alias(f"__sum{i}") for i, (_, part) in enumerate(parts)])
        return work.join(totals.select("__part", _finished(function, [F.col(f"__sum{i}") for i in range(len(parts))]).alias("__result")), "__part")
    turned = high is None
    edge = F.col("__at") + (low if turned else high)
    asked = work.withColumn("__edge", edge).withColumn("__arg", F.lit(None).cast(work.schema["__arg"].dataType)).withColumn("__asks", F.lit(True))
    # turned round, nulls change sides too
    last = nulls_last != turned
    rows = work.withColumn("__edge", F.col("__at")).withColumn("__asks", F.lit(False))
    order = [("__edge", "desc" if turned else "asc", "last" if last else "first")]
    run = split_windows(rows.unionByName(asked), {"__result": (function, "__arg")}, order, ["__part"], splits=splits, rows_per_chunk=size)
    return run.where("__asks")
