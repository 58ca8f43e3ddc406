"""Comparing runs: any number of run pairs at once, as joins on run and stage ids.

``pairs`` has the columns ``left_run`` and ``right_run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeops.operators.ordering import dealt

from .profiles import profile_diff
from .schemas import schema_changes, schema_fingerprint

PAIR = ("left_run", "right_run")


def run_deltas(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Durations in seconds and what else differs between the two runs of each pair.

    ``runs(run_id, started_at, finished_at, status, mode, code_hash)``; a duration is
    null while a run has not both started and finished. A pair of which a run is not known
    stays, with ``available = false`` and nothing compared.
    """
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )) / 1_000_000
    facts = runs.select("run_id", seconds.alias("seconds"), "status", "mode", "code_hash", F.lit(True).alias("known"))

    def side(name: str) -> DataFrame:
        return facts.select(
            F.col("run_id").alias(f"{name}_run"),
            *[F.col(c).alias(f"{name}_{c}") for c in facts.columns if c != "run_id"],
        )

    both = pairs.select(*PAIR).join(side("left"), "left_run", "left").join(side("right"), "right_run", "left")
    known = F.col("left_known").isNotNull() & F.col("right_known").isNotNull()

    def differs(name: str):
        return F.when(known, ~F.col(f"left_{name}").eqNullSafe(F.col(f"right_{name}")))

    return both.select(
        *PAIR,
        "left_seconds",
        "right_seconds",
        (F.col("right_seconds") - F.col("left_seconds")).alias("delta_seconds"),
        differs("status").alias("status_changed"),
        differs("mode").alias("mode_changed"),
        differs("code_hash").alias("code_changed"),
        known.alias("available"),
    )


def _of_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of each pair's runs, marked by side. A run may be in many pairs."""
    sides = pairs.select(
        *PAIR,
        F.inline(
            F.array(
                F.struct(F.col("left_run").alias("run_id"), F.lit("left").alias("side")),
                F.struct(F.col("right_run").alias("run_id"), F.lit("right").alias("side")),
            )
        ),
    )
    return dealt(df, ["run_id"]).join(dealt(sides, ["run_id"]), "run_id")


def stage_deltas(
    stages: DataFrame,
    pairs: DataFrame,
    metrics: tuple[str, ...] = ("shuffle_read_bytes", "shuffle_write_bytes"),
) -> DataFrame:
    """Per pair and stage, right minus left for each metric; a stage that one run lacks
    counts as 0 there. Pairs of which one run has no stages at all are marked
    ``available = false``; a pair without any stage has one row that says so, with a null stage.
    """
    rows = _of_pairs(stages, pairs)
    left, right = F.col("side") == "left", F.col("side") == "right"
    parts = []
    for m in metrics:
        value = F.coalesce(F.col(m), F.lit(0))
        parts.append(F.sum(F.when(left, value).otherwise(F.lit(0))).alias(f"left_{m}"))
        parts.append(F.sum(F.when(right, value).otherwise(F.lit(0))).alias(f"right_{m}"))
        parts.append(F.sum(F.when(right, value).otherwise(-value)).alias(f"{m}_delta"))
    compared = rows.groupBy(*PAIR, "stage_id").agg(
        *parts, F.max(left).alias("in_left"), F.max(right).alias("in_right")
    )
    # From the stages already folded: one small row per pair.
    seen = compared.groupBy(*PAIR).agg(
        (F.max("in_left") & F.max("in_right")).alias("available")
    )
    silent = pairs.select(*PAIR).distinct().join(seen, list(PAIR), "left_anti").withColumn("available", F.lit(False))
    return compared.join(seen, list(PAIR)).unionByName(silent, allowMissingColumns=True)


def problem_changes(problems: DataFrame, pairs: DataFrame) -> DataFrame:
    """Messages that only the right run (``added``) or only the left (``removed``) has.

    ``problems(run_id, message)``; a null message counts as empty.
    """
    rows = _of_pairs(problems, pairs).withColumn("message", F.coalesce("message", F.lit("")))
    met = dealt(rows, [*PAIR, "message"]).groupBy(*PAIR, "message").agg(
        F.max(F.col("side") == "left").alias("l"), F.max(F.col("side") == "right").alias("r")
    )
    return met.where("l <> r").select(
        *PAIR, F.when(F.col("r"), "added").otherwise("removed").alias("change"), "message"
    )


def node_snapshots(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """The snapshots of both runs of each pair, matched per node.

    ``snapshots(run_id, node_id, schema, profile)``: the schema as an array of fields, the
    profile as an array of column profiles; either may be null. One row per pair and node of
    either run: ``before_schema, after_schema, before_fingerprint, after_fingerprint,
    schema_available, schema_reason`` and ``before_profile, after_profile,
    profile_available, profile_reason``.
    """
    rows = _of_pairs(snapshots, pairs)
    parts = [
        F.first(F.when(F.col("side") == side, F.col(what)), ignorenulls=True).alias(f"{when}_{what}")
        for what in ("schema", "profile")
        for side, when in (("left", "before"), ("right", "after"))
    ]
    # a node has one row a side, which grouping before the shuffle would sort for nothing
    met = dealt(rows, [*PAIR, "node_id"]).groupBy(*PAIR, "node_id").agg(*parts)
    for what, reason in (("schema", "schema missing"), ("profile", "profile metrics missing")):
        there = F.col(f"before_{what}").isNotNull() & F.col(f"after_{what}").isNotNull()
        met = met.withColumns({f"{what}_available": there, f"{what}_reason": F.when(~there, reason)})
    return met.withColumns({f"{when}_fingerprint": F.when(F.col("schema_available"), schema_fingerprint(f"{when}_schema")) for when in ("before", "after")})


def node_schema_diffs(matched: DataFrame) -> DataFrame:
    """What changed in the schema of each node, from :func:`node_snapshots`.

    One row per changed field, and one without a path for a node whose schemas are missing
    (``available = false``, with the reason) or alike. Fingerprints are compared first: only
    schemas that differ are taken apart. Row by row; nothing is shuffled.
    """
    keys = [*PAIR, "node_id"]
    facts = [F.col("schema_available").alias("available"), F.col("schema_reason").alias("reason"), "before_fingerprint", "after_fingerprint"]
    named = matched.select(*keys, *facts, "before_schema", "after_schema")
    carried = [*keys, "available", "reason", "before_fingerprint", "after_fingerprint"]
    changes = schema_changes(named.where("available AND before_fingerprint <> after_fingerprint"), carried, "before_schema", "after_schema")
    same = named.where("NOT available OR before_fingerprint = after_fingerprint").select(*carried)
    return changes.unionByName(same, allowMissingColumns=True)


def node_profile_diffs(matched: DataFrame) -> DataFrame:
    """The profile of each node compared metric by metric (see :func:`profile_diff`), from :func:`node_snapshots`.

    A node without both profiles has one row: ``available = false`` and the reason.
    """
    keys = [*PAIR, "node_id"]

    def columns(when: str) -> DataFrame:
        return matched.where("profile_available").select(*keys, F.inline(f"{when}_profile"))

    compared = profile_diff(columns("before"), columns("after"), [*keys, "column"]).withColumn("available", F.lit(True))
    missing = matched.where("NOT profile_available").select(*keys, F.col("profile_available").alias("available"), F.col("profile_reason").alias("reason"))
    return compared.unionByName(missing, allowMissingColumns=True)
