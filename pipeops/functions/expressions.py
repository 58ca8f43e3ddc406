"""Turning configuration values (SQL text, tuples, dicts) into Columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIRECTION = re.compile(
    r"^(?P<expr>.+?)(?:\s+(?P<dir>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?\s*$",
    re.IGNORECASE | re.DOTALL,
)


def as_column(value: str | Column) -> Column:
    """SQL text becomes an expression; a Column is used as it is."""
    if isinstance(value, Column):
        return value
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"expected a SQL expression, got {value!r}")
    return F.expr(value)


def named_column(value: str | Column | Mapping[str, str]) -> Column:
    """Like :func:`as_column`, and ``{"expression": .., "alias": ..}`` names the result."""
    if isinstance(value, Mapping):
        return as_column(value["expression"]).alias(value["alias"])
    return as_column(value)


def sort_direction(spec: str | tuple) -> tuple[Column, bool, bool]:
    """The expression of ``"x DESC NULLS LAST"`` or ``("x", "desc")``, whether it descends, and whether nulls come last.

    ``F.expr("x DESC")`` would read DESC as an alias and sort ascending, so the
    trailing words are taken off here.
    """
    if isinstance(spec, Column):
        raise ValueError("give order keys as text or tuples")
    if isinstance(spec, tuple):
        expression, direction, nulls = (*spec, None, None)[:3]
    else:
        match = _DIRECTION.match(spec.strip())
        if match is None:
            raise ValueError("an empty sort expression")
        expression, direction, nulls = match["expr"], match["dir"], match["nulls"]
    descending = (direction or "asc").lower() == "desc"
    # Spark's own defaults: nulls first ascending, nulls last descending.
    last = (nulls or ("last" if descending else "first")).lower() == "last"
    return as_column(expression), descending, last


def sort_directions(specs: Iterable) -> list[tuple[Column, bool, bool]]:
    return [sort_direction(spec) for spec in specs]


def sort_key(spec: str | Column | tuple) -> Column:
    """``"x DESC NULLS LAST"``, ``("x", "desc")`` or a Column, as an ordering Column."""
    if isinstance(spec, Column):
        return spec
    column, descending, last = sort_direction(spec)
    if descending:
        return column.desc_nulls_last() if last else column.desc_nulls_first()
    return column.asc_nulls_last() if last else column.asc_nulls_first()


def key_struct(columns: Iterable[str | Column]) -> Column:
    """Several columns as one key that is never null and in which nulls are equal.

    Grouping, windows and joins by this one column share a partitioning; a join on
    ``<=>`` of the columns would shuffle both sides once more.
    """
    parts = [F.col(f"`{c}`") if isinstance(c, str) else c for c in columns]
    return F.struct(*[part.alias(f"k{i}") for i, part in enumerate(parts)])


def sort_keys(specs: Iterable) -> list[Column]:
    return [sort_key(spec) for spec in specs]
