"""Joins on any boolean condition over the aliases ``left`` and ``right``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeops.functions import as_column

_KINDS = {
    "inner": "inner",
    "left": "left",
    "left_outer": "left",
    "right": "right",
    "right_outer": "right",
    "full": "full",
    "outer": "full",
    "full_outer": "full",
    "left_semi": "left_semi",
    "semi": "left_semi",
    "left_anti": "left_anti",
    "anti": "left_anti",
    "cross": "cross",
}


def output_names(left: DataFrame, right: DataFrame) -> list[tuple[str, str]]:
    """Right columns with their names in the result: a name the left side has
    already taken gets the prefix ``right_``.
    """
    taken = set(left.columns)
    named = []
    for column in right.columns:
        name = column
        while name in taken:
            name = f"right_{name}"
        taken.add(name)
        named.append((column, name))
    return named


def join(
    left: DataFrame,
    right: DataFrame,
    condition: str | Column | None = None,
    how: str = "inner",
    split_full: bool = True,
) -> DataFrame:
    """Join two DataFrames; the condition names columns as ``left.x`` and ``right.y``.

    Which side is broadcast is left to Spark, which looks at sizes. Adaptive
    execution splits a hot key of an inner, left, right, semi or anti join over
    several tasks but cannot do so for a full join. So a batch full join is
    written as the left join plus the right rows without a partner, each of which
    can be split. ``split_full=False`` keeps the single full join, which reads
    both sides once.
    """
    kind = _KINDS.get(how)
    if kind is None:
        raise ValueError(f"unknown join type {how!r}")
    if kind != "cross" and condition is None:
        raise ValueError("a join condition is required unless the join is a cross join")
    lhs, rhs = left.alias("left"), right.alias("right")
    if kind in ("left_semi", "left_anti"):
        return lhs.join(rhs, as_column(condition), kind).select("left.*")

    from_left = [F.col(f"left.`{c}`").alias(c) for c in left.columns]
    names = output_names(left, right)
    from_right = [F.col(f"right.`{c}`").alias(name) for c, name in names]
    if kind == "cross":
        return lhs.crossJoin(rhs).select(*from_left, *from_right)
    on = as_column(condition)
    streaming = left.isStreaming or right.isStreaming
    if kind == "full" and split_full and not streaming:
        matched = lhs.join(rhs, on, "left").select(*from_left, *from_right)
        blanks = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields]
        unmatched = rhs.join(lhs, on, "left_anti").select(*blanks, *from_right)
        return matched.unionAll(unmatched)
    return lhs.join(rhs, on, kind).select(*from_left, *from_right)
