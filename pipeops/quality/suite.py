"""Running a list of checks over named tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import check_columns, referential, schema_contract, uniqueness

# When a check is meant to run.
MODES = ("preview", "post-run", "scheduled")
ROW_LEVEL = ("column_rule", "null_rate", "row_count_range", "quarantine_split")


def _validated(checks: Sequence[Mapping], mode: str | None) -> list[Mapping]:
    if mode is not None and mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    for check in checks:
        if not isinstance(check.get("id"), str) or not isinstance(check.get("type"), str):
            raise ValueError("each check needs an id and a type")
        if check.get("mode", "preview") not in MODES:
            raise ValueError(f"check {check['id']}: mode must be one of {', '.join(MODES)}")
    return [c for c in checks if mode is None or c.get("mode", "preview") == mode]


def run_suite(
    tables: Mapping[str, DataFrame], checks: Sequence[Mapping], mode: str | None = None
) -> DataFrame:
    """One result row per check.

    A check is ``{"id", "type", "table", "config", "mode"}``; the table may be left
    out when there is only one. All row-level checks of a table share one scan;
    key checks need their own. ``referential_sample`` names its reference table in
    ``config["reference"]``.
    """
    chosen = _validated(checks, mode)
    if not chosen:
        raise ValueError("no checks to run")
    only = next(iter(tables)) if len(tables) == 1 else None
    by_table: dict[str, list[Mapping]] = {}
    for check in chosen:
        by_table.setdefault(check.get("table") or only, []).append(check)
    parts: list[DataFrame] = []
    for name, group in by_table.items():
        if name not in tables:
            raise ValueError(f"no table {name!r} for check {group[0]['id']}")
        df = tables[name]
        rows = [c for c in group if c["type"] in ROW_LEVEL]
        if rows:
            parts.append(check_columns(df, rows))
        parts += [_key_check(df, c, tables) for c in group if c["type"] not in ROW_LEVEL]
    return reduce(DataFrame.unionByName, parts)


def _key_check(df: DataFrame, check: Mapping, tables: Mapping[str, DataFrame]) -> DataFrame:
    config = check.get("config", {})
    if check["type"] == "uniqueness":
        return uniqueness(df, check["id"], config["columns"])
    if check["type"] == "schema_contract":
        return schema_contract(df, check["id"], config["schema"])
    if check["type"] == "referential_sample":
        return referential(
            df,
            tables.get(config.get("reference")),
            check["id"],
            config["columns"],
            config.get("sampleFraction"),
            config.get("seed"),
        )
    raise ValueError(f"unknown check type {check['type']!r}")


def suite_status(results: DataFrame) -> DataFrame:
    """One row: failed if any check failed; deferred checks do not fail a suite."""
    failed = F.count_if(F.col("status") == "failed")
    return results.agg(
        F.when(failed > 0, "failed").otherwise("passed").alias("status"),
        F.count(F.lit(1)).alias("checks"),
        failed.alias("failed"),
    )
