"""Refreshing a list of datasets, incrementally or from scratch."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pipeops.files import committed

from .datasets import materialized_view, streaming_table, temporary_view

KINDS = ("materialized_view", "streaming_table", "temporary_view")


@dataclass(frozen=True)
class Dataset:
    """A named result and the function that builds it from the session."""

    name: str
    kind: str
    build: Callable[[SparkSession], DataFrame]

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")


def refresh(
    spark: SparkSession,
    datasets: Sequence[Dataset],
    root: str,
    selected: Collection[str] | None = None,
    full: Collection[str] = (),
    full_all: bool = False,
) -> list[str]:
    """Bring datasets up to date, in the order given, and return their names.

    Materialized views are recomputed. Streaming tables take in new input only,
    unless they are named in ``full`` (or ``full_all`` is set): then the table is
    built again from all input, in a new folder with a new checkpoint.
    """
    known = {d.name for d in datasets}
    if len(known) < len(datasets):
        raise ValueError("dataset names must be unique")
    unknown = (set(selected or ()) | set(full)) - known
    if unknown:
        raise ValueError(f"unknown datasets: {', '.join(sorted(unknown))}")
    wanted = known if selected is None and not full else set(selected or ()) | set(full)
    if full_all:
        wanted = known
    done = []
    for dataset in datasets:
        if dataset.name not in wanted:
            continue
        df = dataset.build(spark)
        if dataset.kind == "temporary_view":
            temporary_view(df, dataset.name)
        elif dataset.kind == "materialized_view":
            materialized_view(df, dataset.name, f"{root}/{dataset.name}/table")
        else:
            _refresh_stream(spark, dataset, df, root, full_all or dataset.name in full)
        done.append(dataset.name)
    return done


def _refresh_stream(
    spark: SparkSession, dataset: Dataset, df: DataFrame, root: str, anew: bool
) -> None:
    home = f"{root}/{dataset.name}"
    generations = committed(spark, f"{home}/generations", "generation")
    current = generations[-1] if generations else 0
    number = current + 1 if anew and generations else current
    home_table, checkpoint = f"{home}/tables/{number}", f"{home}/checkpoints/{number}"
    if number == current:
        streaming_table(df, dataset.name, checkpoint, home_table)
    else:
        # The new generation is built under a passing name; only when it is complete does
        # the dataset's own name move to it, so a failure leaves the old one in place.
        passing = f"{dataset.name}__{number}"
        spark.sql(f"DROP TABLE IF EXISTS {passing}")
        streaming_table(df, passing, checkpoint, home_table)
        spark.sql(f"DROP TABLE IF EXISTS {passing}")
        spark.sql(f"DROP TABLE IF EXISTS {dataset.name}")
        streaming_table(df, dataset.name, checkpoint, home_table)
    if number != current or not generations:
        # A marker per generation, written last, so that a new session finds the current one.
        marker = spark.range(1).selectExpr(f"{number} AS generation")
        marker.write.mode("overwrite").parquet(f"{home}/generations/generation={number}")
