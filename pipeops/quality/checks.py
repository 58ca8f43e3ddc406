"""Data-quality checks over whole tables.

Every check gives one row ``(check_id, type, status, checked, failed, actual,
expected)`` with status ``passed``, ``failed`` or ``deferred``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pipeops.functions import key_struct, predicate
from pipeops.observe.profiles import profile

ACTIONS = ("warn", "drop", "fail")
RESULT = ("check_id", "type", "status", "checked", "failed", "actual", "expected")


def _result(
    check_id: str,
    kind: str,
    failing: Column,
    checked: Column,
    failed: Column,
    actual: Column,
    expected: str,
) -> Column:
    """The result row as a struct."""
    return F.struct(
        F.lit(check_id).alias("check_id"),
        F.lit(kind).alias("type"),
        F.when(failing, "failed").otherwise("passed").alias("status"),
        checked.cast("long").alias("checked"),
        failed.cast("long").alias("failed"),
        actual.cast("double").alias("actual"),
        F.lit(expected).alias("expected"),
    )


def _need(check: Mapping, name: str) -> object:
    value = check.get("config", {}).get(name)
    if value in (None, "", []):
        raise ValueError(f"check {check.get('id')!r} needs {name}")
    return value


def check_columns(df: DataFrame, checks: Sequence[Mapping]) -> DataFrame:
    """All row-level checks of one table in a single aggregate over one scan.

    ``checks`` are dicts ``{"id", "type", "config"}`` of the types
    ``column_rule(column, condition)``, ``null_rate(column, maxRate)``,
    ``row_count_range(minimum, maximum)`` and ``quarantine_split(condition, column)``.
    """
    total = F.col("__rows")
    sums: list[Column] = []
    results: list[Column] = []
    for i, check in enumerate(checks):
        kind, config, bad = check["type"], check.get("config", {}), F.col(f"__bad{i}")
        if kind in ("column_rule", "quarantine_split"):
            condition = str(_need(check, "condition"))
            held = predicate(condition, config.get("column"))
            sums.append(F.count_if(~held).alias(f"__bad{i}"))
            results.append(_result(check["id"], kind, bad > 0, total, bad, bad, condition))
        elif kind == "null_rate":
            limit = float(config.get("maxRate") or 0.0)
            sums.append(F.count_if(F.col(str(_need(check, "column"))).isNull()).alias(f"__bad{i}"))
            rate = F.when(total > 0, bad / total).otherwise(F.lit(0.0))
            results.append(_result(check["id"], kind, rate > limit, total, bad, rate, f"<= {limit}"))
        elif kind == "row_count_range":
            low, high = int(config.get("minimum") or 0), config.get("maximum")
            outside = total < low
            if high is not None:
                outside = outside | (total > int(high))
            expected = f"{low}..{'' if high is None else int(high)}"
            results.append(
                _result(check["id"], kind, outside, total, outside.cast("long"), total, expected)
            )
        else:
            raise ValueError(f"{kind} is not a row-level check")
    counted = df.agg(F.count(F.lit(1)).alias("__rows"), *sums)
    return counted.select(F.inline(F.array(*results)))


def apply_column_rule(
    df: DataFrame,
    condition: str | Column,
    column: str | None = None,
    action: str = "warn",
    seen: Observation | str = "column_rule",
) -> DataFrame:
    """Act on a rule inside the data flow, for batches and streams: ``warn`` passes all
    rows on, ``drop`` leaves out those that break it, ``fail`` makes the query fail.

    A warning is an observed metric: ``checked`` and ``failed`` come out under ``seen``
    when the query ends, to an :class:`Observation` or to listeners and progress reports.
    """
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {', '.join(ACTIONS)}")
    held = predicate(condition, column)
    if action == "warn":
        return _counted(df, seen, held)
    if action == "drop":
        return df.where(held)
    message = F.lit(f"rule failed: {condition if isinstance(condition, str) else 'expression'}")
    return df.where(F.when(held, True).otherwise(F.raise_error(message).cast("boolean")))


def _counted(df: DataFrame, seen: Observation | str, held: Column) -> DataFrame:
    return df.observe(seen, F.count(F.lit(1)).alias("checked"), F.count_if(~held).alias("failed"))


def observe_rule(
    df: DataFrame, name: str, condition: str | Column, column: str | None = None
) -> tuple[DataFrame, Observation]:
    """Count rows and rule breaks while the data passes through to some other action."""
    seen = Observation(name)
    held = predicate(condition, column)
    return _counted(df, seen, held), seen


def uniqueness_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys seen more than once, with their row counts; nulls equal each other.

    Rows are counted per key before the shuffle, so a hot key costs one row per task.
    """
    if not columns:
        raise ValueError("uniqueness needs key columns")
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    return counts.where("copies > 1")


def uniqueness(df: DataFrame, check_id: str, columns: Sequence[str]) -> DataFrame:
    """``failed`` and ``actual`` are the number of keys seen more than once."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    totals = counts.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count_if(F.col("copies") > 1).alias("bad"),
    )
    bad = F.col("bad")
    row = _result(check_id, "uniqueness", bad > 0, F.col("rows"), bad, bad, ",".join(columns))
    return totals.select(F.inline(F.array(row)))


def schema_contract(
    df: DataFrame, check_id: str, expected: Sequence[Mapping[str, str]]
) -> DataFrame:
    """Column names against the expected ones, in any order. Types and nested fields are
    compared by :func:`pipeops.observe.schema_diff`. Needs no scan but the row count.
    """
    names = sorted(str(f["name"]) for f in expected if f.get("name"))
    wrong = set(names) ^ set(df.columns)
    failing = F.lit(names != sorted(df.columns))
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    row = _result(
        check_id,
        "schema_contract",
        failing,
        F.col("rows"),
        F.lit(len(wrong)),
        F.lit(len(df.columns)),
        ",".join(names),
    )
    return counted.select(F.inline(F.array(row)))


def _key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    keyed = df.select(key_struct(columns).alias("__key"))
    return keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("copies"))


def referential_missing(
    df: DataFrame, reference: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Keys absent from the reference, with the rows that carry them; null matches null.

    Both sides are folded to distinct keys before they meet, so hot keys do not matter.
    """
    if not columns:
        raise ValueError("a referential check needs key columns")
    known = reference.select(key_struct(columns).alias("__key")).distinct()
    missing = _key_counts(df, columns).join(known, "__key", "left_anti")
    return missing.select(
        *[F.col(f"__key.k{i}").alias(c) for i, c in enumerate(columns)], "copies"
    )


def referential(
    df: DataFrame,
    reference: DataFrame | None,
    check_id: str,
    columns: Sequence[str],
    sample_fraction: float | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Rows whose key the reference lacks. Without a reference the check is deferred.

    Checks every row unless ``sample_fraction`` asks for a sample.
    """
    if sample_fraction is not None:
        df = df.sample(False, sample_fraction, seed)
    expected = ",".join(columns)
    if reference is None:
        counted = df.agg(F.count(F.lit(1)).alias("rows"))
        row = _result(
            check_id, "referential_sample", F.lit(False), F.col("rows"), F.lit(0), F.lit(None), expected
        )
        deferred = counted.select(F.inline(F.array(row)))
        return deferred.withColumn("status", F.lit("deferred"))
    # One pass: mark known keys on a left join against the distinct reference keys.
    known = reference.select(key_struct(columns).alias("__key")).distinct()
    known = known.withColumn("__known", F.lit(True))
    marked = _key_counts(df, columns).join(known, "__key", "left")
    totals = marked.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("__known").isNull(), F.col("copies"))), F.lit(0)).alias("bad"),
    )
    bad = F.col("bad")
    row = _result(check_id, "referential_sample", bad > 0, F.col("rows"), bad, bad, expected)
    return totals.select(F.inline(F.array(row)))


def profile_probe(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """A profile of the named columns, or of all."""
    return profile(df, columns)


class Split(NamedTuple):
    accepted: DataFrame
    quarantine: DataFrame


def quarantine_split(
    df: DataFrame, condition: str | Column, column: str | None = None
) -> Split:
    """Rows that meet the condition, and all others (false or null). Each row is in one."""
    held = predicate(condition, column)
    return Split(df.where(held), df.where(~held))
