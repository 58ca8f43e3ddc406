"""Row predicates shared by the quality checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the two built-in rules.
NOT_NULL = ("not_null", "not null")
NON_EMPTY = ("non_empty", "not_empty")


def predicate(condition: str | Column, column: str | None = None) -> Column:
    """A never-null boolean: TRUE where the rule holds, FALSE where it is false or null.

    ``non_empty`` compares the text form, so it also works on columns that are
    not strings.
    """
    if isinstance(condition, Column):
        return F.coalesce(condition, F.lit(False))
    text = condition.strip()
    if not text:
        raise ValueError("a rule needs a condition")
    if text.lower() in NOT_NULL + NON_EMPTY:
        if not column:
            raise ValueError(f"rule {text!r} needs a column")
        held = F.col(column).isNotNull()
        if text.lower() in NON_EMPTY:
            held = held & (F.col(column).cast("string") != "")
        return F.coalesce(held, F.lit(False))
    return F.coalesce(F.expr(text), F.lit(False))
