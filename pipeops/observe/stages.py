"""Stage metrics and skew from Spark event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeops.functions import exact_quantiles
from pipeops.session import scratch

# The JSON names Spark writes, only those needed here.
_EVENT = """
  `Event` STRING,
  `Stage ID` BIGINT,
  `Stage Attempt ID` BIGINT,
  `Stage Info` STRUCT<`Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT, `Stage Name`: STRING>,
  `Task Info` STRUCT<`Launch Time`: BIGINT, `Finish Time`: BIGINT>,
  `Task Metrics` STRUCT<
    `Executor Run Time`: BIGINT,
    `Executor CPU Time`: BIGINT,
    `JVM GC Time`: BIGINT,
    `Memory Bytes Spilled`: BIGINT,
    `Disk Bytes Spilled`: BIGINT,
    `Shuffle Read Metrics`: STRUCT<`Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT>,
    `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>,
    `Input Metrics`: STRUCT<`Bytes Read`: BIGINT>,
    `Output Metrics`: STRUCT<`Bytes Written`: BIGINT>>
"""
_TASK_END = "SparkListenerTaskEnd"
_STAGE_SUBMITTED = "SparkListenerStageSubmitted"

# Metrics whose whole distribution is reported.
SPREAD = ("duration_ms", "input_bytes", "shuffle_read_bytes", "shuffle_write_bytes")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Event-log lines ``(app, value)`` of all files below a folder, compressed or not.

    The application is taken from the log's file or folder name.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    app = F.regexp_extract(
        F.col("_metadata.file_path"), r".*[/=_]((?:app|application|local)-[\w-]+)", 1
    )
    return lines.select(app.alias("app"), "value")


def _records(lines: DataFrame, value: str, merge_attempts: bool) -> DataFrame:
    """One narrow row per finished task, and one per submitted stage (with its name).

    A line is parsed once, and only if it speaks of one of the two. It is parsed in a generator,
    below which no filter on what was parsed is pushed: there it would parse the line again.
    """
    text = F.col(value)
    wanted = F.contains(text, F.lit(_TASK_END)) | F.contains(text, F.lit(_STAGE_SUBMITTED))
    app = F.coalesce(F.col("app"), F.lit("")) if "app" in lines.columns else F.lit("")
    events = (
        lines.where(wanted)
        .select(app.alias("app"), F.inline_outer(F.array(F.from_json(text, _EVENT))))
        .where(F.col("Event").isin(_TASK_END, _STAGE_SUBMITTED))
    )
    attempt = F.lit(0).cast("long")
    if not merge_attempts:
        attempt = F.coalesce("Stage Attempt ID", F.col("`Stage Info`.`Stage Attempt ID`"), attempt)
    stage = F.coalesce("Stage ID", F.col("`Stage Info`.`Stage ID`"), F.lit(-1))
    name = F.when(
        F.col("Event") == _STAGE_SUBMITTED,
        F.coalesce(F.col("`Stage Info`.`Stage Name`"), F.lit("")),
    )
    metrics = "`Task Metrics`"

    def number(path: str) -> Column:
        return F.coalesce(F.col(path), F.lit(0))

    duration = F.greatest(
        F.lit(0), number("`Task Info`.`Finish Time`") - number("`Task Info`.`Launch Time`")
    )
    run_time = number(f"{metrics}.`Executor Run Time`")
    return events.select(
        "app",
        stage.alias("stage_id"),
        attempt.alias("attempt"),
        name.alias("name"),
        duration.alias("duration_ms"),
        F.greatest(F.lit(0), duration - run_time).alias("scheduler_delay_ms"),
        (
            number(f"{metrics}.`Shuffle Read Metrics`.`Remote Bytes Read`")
            + number(f"{metrics}.`Shuffle Read Metrics`.`Local Bytes Read`")
        ).alias("shuffle_read_bytes"),
        number(f"{metrics}.`Shuffle Write Metrics`.`Shuffle Bytes Written`").alias("shuffle_write_bytes"),
        number(f"{metrics}.`Input Metrics`.`Bytes Read`").alias("input_bytes"),
        number(f"{metrics}.`Output Metrics`.`Bytes Written`").alias("output_bytes"),
        number(f"{metrics}.`Memory Bytes Spilled`").alias("memory_bytes_spilled"),
        number(f"{metrics}.`Disk Bytes Spilled`").alias("disk_bytes_spilled"),
        number(f"{metrics}.`Executor CPU Time`").alias("executor_cpu_time_ns"),
        number(f"{metrics}.`JVM GC Time`").alias("gc_time_ms"),
    )


def stage_summary(
    lines: DataFrame,
    moderate: float = 2.0,
    severe: float = 5.0,
    merge_attempts: bool = False,
    value: str = "value",
    store: str | None = None,
) -> DataFrame:
    """One row per application, stage and attempt from event-log lines.

    Sums, the spread of task times and bytes, and a skew score: the longest task
    over the median task. ``merge_attempts`` puts a stage's attempts together.
    Stage ids repeat between applications, so lines should carry a column ``app``.

    A line is parsed once and the parsed tasks, a few per cent of the log, are kept in a folder:
    sums, maxima, names and quantiles are made from there, and only sums and counts are shuffled.
    Quantiles are exact without gathering a stage in one task. ``store`` names a new folder,
    shared by the cluster, for use by other queries; without it a scratch folder is taken.
    """
    if not 1.0 <= moderate < severe:
        raise ValueError("thresholds must satisfy 1 <= moderate < severe")
    records = _records(lines, value, merge_attempts)
    folder = scratch(lines.sparkSession, "tasks") if store is None else store
    records.write.parquet(folder)
    records = lines.sparkSession.read.schema(records.schema).parquet(folder)
    keys = ["app", "stage_id", "attempt"]

    sums = [c for c in records.columns if c not in (*keys, "name", "duration_ms")]
    # the name is a key here: a maximum of texts would have every task sorted
    parts = records.groupBy(*keys, "name").agg(
        F.count(F.lit(1)).alias("task_count"),
        *[F.sum(m).alias(m) for m in sums],
        *[F.max(m).alias(f"max_{m}") for m in SPREAD],
    )

    def of_tasks(column: str) -> Column:
        return F.when(F.col("name").isNull(), F.col(column))

    totals = parts.groupBy(*keys).agg(
        *[F.sum(of_tasks(c)).alias(c) for c in ("task_count", *sums)],
        *[F.max(of_tasks(f"max_{m}")).alias(f"max_{m}") for m in SPREAD],
        F.max("name").alias("name"),
    )
    # a metric goes by its place
    one = [F.struct(F.lit(i).alias("metric"), F.col(m).alias("v")) for i, m in enumerate(SPREAD)]
    n = F.col("n")
    quantiles = exact_quantiles(
        records.where("name IS NULL").select(*keys, F.inline(F.array(*one))),
        [*keys, "metric"],
        "v",
        {"low": F.floor((n + 1) / 2), "high": F.ceil((n + 1) / 2), "p95": F.ceil(n * 0.95)},
    )
    spread: list[Column] = []
    for i, m in enumerate(SPREAD):
        mine = F.col("metric") == i
        middle = (F.col("low") + F.col("high")) / 2
        spread.append(F.max(F.when(mine, middle)).alias(f"median_{m}"))
        spread.append(F.max(F.when(mine, F.col("p95"))).alias(f"p95_{m}"))
    # Each side has one row per stage and attempt. A stage may have no tasks yet.
    stages = totals.join(quantiles.groupBy(*keys).agg(*spread), keys, "left").na.fill(0)
    median = F.col("median_duration_ms")
    skew = F.when(median > 0, F.round(F.col("max_duration_ms") / median, 2)).otherwise(F.lit(0.0))
    # The three verdicts.
    verdict = (
        F.when(skew >= severe, "severe skew")
        .when(skew >= moderate, "moderate skew")
        .otherwise("balanced/unknown")
    )
    return stages.select(
        *keys,
        F.coalesce("name", F.lit("")).alias("name"),
        "task_count",
        median.alias("median_task_ms"),
        F.col("max_duration_ms").alias("max_task_ms"),
        F.col("p95_duration_ms").alias("p95_task_ms"),
        skew.alias("skew_score"),
        *sums,
        *[f"{q}_{m}" for m in SPREAD[1:] for q in ("median", "p95", "max")],
        verdict.alias("diagnostic"),
    )
