"""Observability. Logs, plans, runs and snapshots are derived from the tables by
Spark, row by row, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeops import observe, plans, sources
from pipeops import operators as ops
from pipeops.session import scratch

from . import plan_texts
from .quality_queries import _profile, _rounded
from .registry import query, table

# Profiles.

_LINE_COLUMNS = {"l_quantity": True, "l_discount": True, "l_returnflag": False, "l_suppkey": True}


@query(
    "d1_profile",
    " UNION ALL ".join(_profile(c, "lineitem", numeric) for c, numeric in _LINE_COLUMNS.items()),
)
def d1_profile(spark, sf):
    return _rounded(observe.profile(table(spark, sf, "lineitem"), list(_LINE_COLUMNS)))


def _counts_only(column):
    return f"""SELECT '{column}' AS "column", count(*) AS count, count(*) - count({column}) AS null_count,
                 count(DISTINCT {column}) AS distinct_count, true AS distinct_exact FROM orders"""


@query("d1_profile_insensitive", f"{_counts_only('o_custkey')} UNION ALL {_counts_only('o_orderdate')}")
def d1_profile_insensitive(spark, sf):
    return observe.profile(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"], include_sensitive=False)


@query("d1_profile_approx")
def d1_profile_approx(spark, sf):
    """All columns with distinct sketches; compared with exact counts in the tests."""
    return observe.profile(table(spark, sf, "lineitem"), approx=True)


def _top(column):
    return f"""SELECT '{column}' AS "column", CAST(rank AS INT) AS rank, value, count FROM (
                 SELECT {column} AS value, count(*) AS count,
                        row_number() OVER (ORDER BY count(*) DESC, {column}) AS rank
                 FROM part WHERE {column} IS NOT NULL GROUP BY {column}) WHERE rank <= 5"""


@query("d1_top_values", " UNION ALL ".join(_top(c) for c in ("p_name", "p_brand", "p_type")))
def d1_top_values(spark, sf):
    return observe.top_values(table(spark, sf, "part"), top=5)


_BEFORE = "(SELECT l_quantity, l_tax, l_linenumber FROM lineitem WHERE l_returnflag = 'R')"
_AFTER = "(SELECT l_quantity, l_tax, l_discount FROM lineitem WHERE l_returnflag <> 'R')"


def _diff(column, metric, expression):
    b, a = (f"(SELECT CAST({expression} AS DOUBLE) FROM {s})" for s in (_BEFORE, _AFTER))
    return f"""SELECT '{column}' AS "column", '{metric}' AS metric, 'ok' AS status, NULL AS reason,
                 {b} AS before, {a} AS after, round({a} - {b}, 6) AS delta,
                 round(CASE WHEN {b} <> 0 THEN ({a} - {b}) / {b} END, 6) AS relative_delta"""


def _one_sided(column, metric, expression, before):
    value = f"(SELECT CAST({expression} AS DOUBLE) FROM {_BEFORE if before else _AFTER})"
    return f"""SELECT '{column}', '{metric}', 'insufficient_data', 'column_added_or_removed',
                 {value if before else 'NULL'}, {'NULL' if before else value}, NULL, NULL"""


_METRICS = {
    "count": "count(*)",
    "null_count": "count(*) - count({c})",
    "distinct_count": "count(DISTINCT {c})",
    "min": "min({c})",
    "max": "max({c})",
}


@query(
    "d2_profile_diff",
    " UNION ALL ".join(
        [_diff(c, m, e.format(c=c)) for c in ("l_quantity", "l_tax") for m, e in _METRICS.items()]
        + [_one_sided("l_linenumber", m, e.format(c="l_linenumber"), True) for m, e in _METRICS.items()]
        + [_one_sided("l_discount", m, e.format(c="l_discount"), False) for m, e in _METRICS.items()]
    ),
)
def d2_profile_diff(spark, sf):
    lines = table(spark, sf, "lineitem")
    before = lines.where("l_returnflag = 'R'").select("l_quantity", "l_tax", "l_linenumber")
    after = lines.where("l_returnflag <> 'R'").select("l_quantity", "l_tax", "l_discount")
    diff = observe.profile_diff(observe.profile(before), observe.profile(after))
    return diff.withColumns({"delta": F.round("delta", 6), "relative_delta": F.round("relative_delta", 6)})


# Each order is a run of its customer's node, with a schema that depends on the order.


def _snapshots(spark, sf):
    """(run_id, node_id, created_at, schema): 'amount' changes type with the status, and
    'label' is there only for urgent orders.
    """
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id",
        "o_custkey AS node_id",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
        """filter(array(
             named_struct('name', 'id', 'type', 'bigint', 'nullable', false),
             named_struct('name', 'amount', 'type', CASE o_orderstatus WHEN 'F' THEN 'double' ELSE 'decimal(18,2)' END,
                          'nullable', o_totalprice > 200000),
             CASE WHEN o_orderpriority = '1-URGENT'
                  THEN named_struct('name', 'label', 'type', 'string', 'nullable', true) END),
           f -> f IS NOT NULL) AS schema""",
    )


def _history(spark, sf):
    """Each snapshot with the one before it, however many runs a node has."""
    return ops.split_window(
        _snapshots(spark, sf),
        "before",
        "lag",
        ["created_at", "run_id"],
        "schema",
        ["node_id"],
        split_by="date_trunc('day', created_at)",
    )


_HISTORY = """(
  SELECT o_orderkey AS run_id, o_custkey AS node_id, o_orderstatus = 'F' AS dbl, o_totalprice > 200000 AS nul,
         o_orderpriority = '1-URGENT' AS lab, o_orderdate AS created_at,
         lag(o_orderstatus = 'F') OVER w AS was_dbl, lag(o_totalprice > 200000) OVER w AS was_nul,
         lag(o_orderpriority = '1-URGENT') OVER w AS was_lab
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""

_TYPE = "CASE WHEN {} THEN 'double' ELSE 'decimal(18,2)' END"


@query(
    "d3_schema_diff",
    f"""SELECT run_id, 'amount' AS path, CASE WHEN dbl <> was_dbl THEN 'type_changed' ELSE 'nullability_changed' END AS kind,
               {_TYPE.format('was_dbl')} AS before_type, {_TYPE.format('dbl')} AS after_type, dbl <> was_dbl AS breaking
        FROM {_HISTORY} WHERE dbl <> was_dbl OR nul <> was_nul
        UNION ALL SELECT run_id, 'label', 'added', NULL, 'string', false FROM {_HISTORY} WHERE lab AND NOT was_lab
        UNION ALL SELECT run_id, 'label', 'removed', 'string', NULL, true FROM {_HISTORY} WHERE NOT lab AND was_lab""",
)
def d3_schema_diff(spark, sf):
    """Every run against the previous run of its node."""
    changes = observe.schema_changes(_history(spark, sf), ["run_id"], "before", "schema")
    return changes.select("run_id", "path", "kind", "before_type", "after_type", "breaking")


@query(
    "d3_schema_contract",
    f"""SELECT run_id, CASE WHEN n = 0 THEN 'passed' ELSE 'blocked' END AS status, n AS breaking FROM (
          SELECT run_id, CAST(dbl <> was_dbl AS BIGINT) + CAST(lab <> was_lab AS BIGINT) AS n
          FROM {_HISTORY} WHERE dbl <> was_dbl OR nul <> was_nul OR lab <> was_lab)""",
)
def d3_schema_contract(spark, sf):
    """Added fields are not allowed here. The snapshots go through fields tables."""
    history = _history(spark, sf).where("before IS NOT NULL")
    diff = observe.schema_diff(
        observe.snapshot_fields(history, ["run_id"], "before"),
        observe.snapshot_fields(history, ["run_id"], "schema"),
        ["run_id"],
    )
    return observe.schema_contract_status(diff, ["run_id"], "block", allow_added=False)


_JSON_FIELD = """'{{"name":"{name}","type":"' || {type} || '","nullable":' || {nullable} || '}}'"""
_FINGERPRINT = (
    "sha256('[' || "
    + _JSON_FIELD.format(name="amount", type="CASE WHEN o_orderstatus = 'F' THEN 'double' ELSE 'decimal(18,2)' END",
                         nullable="CASE WHEN o_totalprice > 200000 THEN 'true' ELSE 'false' END")
    + " || ',' || "
    + _JSON_FIELD.format(name="id", type="'bigint'", nullable="'false'")
    + " || CASE WHEN o_orderpriority = '1-URGENT' THEN ',' || "
    + _JSON_FIELD.format(name="label", type="'string'", nullable="'true'")
    + " ELSE '' END || ']')"
)


@query("d4_schema_fingerprint", f"SELECT o_orderkey AS run_id, {_FINGERPRINT} AS fingerprint FROM orders")
def d4_schema_fingerprint(spark, sf):
    return _snapshots(spark, sf).select("run_id", observe.schema_fingerprint("schema").alias("fingerprint"))


@query(
    "d5_schema_timeline",
    f"""SELECT run_id, node_id, coalesce(lab AND NOT was_lab, false) AS gained, coalesce(was_lab AND NOT lab, false) AS lost,
               coalesce(dbl <> was_dbl, false) AS retyped,
               coalesce(dbl <> was_dbl, false) OR coalesce(was_lab AND NOT lab, false) AS changed
        FROM {_HISTORY}""",
)
def d5_schema_timeline(spark, sf):
    snapshots = _snapshots(spark, sf)
    runs = table(spark, sf, "orders").selectExpr("o_orderkey AS run_id", "CAST(o_orderdate AS TIMESTAMP) AS created_at")
    timeline = observe.schema_timeline(runs, snapshots.drop("created_at"))
    return timeline.selectExpr(
        "run_id",
        "node_id",
        "array_contains(added, 'label') AS gained",
        "array_contains(removed, 'label') AS lost",
        "array_contains(type_changed, 'amount') AS retyped",
        "changed",
    )


# Each line item is the end of a task; the line number is the stage, the return flag the
# application, the line status the attempt. Nations are submitted stages of application R,
# most of them without tasks.


def event_log(spark, sf):
    # Lines are put in order of their folder before they are texts, which are several times as
    # wide; the folder of nulls goes by its name here, as the writer takes no nullable order.
    application = F.coalesce(F.concat(F.lit("app-"), "l_returnflag"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    lines = table(spark, sf, "lineitem").withColumn("application", application).sortWithinPartitions("application")

    def struct(**fields):
        return F.struct(*[F.expr(e).alias(n.replace("_", " ")) for n, e in fields.items()])

    metrics = F.struct(
        F.expr("CAST(l_extendedprice AS BIGINT) - 10 * l_linenumber").alias("Executor Run Time"),
        F.expr("l_partkey * 1000").alias("Executor CPU Time"),
        F.col("l_linenumber").cast("long").alias("JVM GC Time"),
        F.expr("CAST(l_quantity AS BIGINT)").alias("Memory Bytes Spilled"),
        F.lit(0).alias("Disk Bytes Spilled"),
        struct(Remote_Bytes_Read="l_partkey", Local_Bytes_Read="CAST(l_quantity AS BIGINT)").alias("Shuffle Read Metrics"),
        struct(Shuffle_Bytes_Written="l_orderkey").alias("Shuffle Write Metrics"),
        struct(Bytes_Read="l_partkey * l_linenumber").alias("Input Metrics"),
        struct(Bytes_Written="l_suppkey").alias("Output Metrics"),
    )
    times = struct(
        Launch_Time="1000", Finish_Time="1000 + CAST(l_extendedprice AS BIGINT)"
    )
    ends = lines.select(
        "application",
        F.to_json(
            F.struct(
                F.lit("SparkListenerTaskEnd").alias("Event"),
                F.col("l_linenumber").alias("Stage ID"),
                F.expr("CAST(l_linestatus = 'F' AS INT)").alias("Stage Attempt ID"),
                times.alias("Task Info"),
                metrics.alias("Task Metrics"),
            )
        ).alias("value"),
    )
    stage = F.struct(
        F.col("n_nationkey").alias("Stage ID"),
        F.lit(0).alias("Stage Attempt ID"),
        F.col("n_name").alias("Stage Name"),
    )
    submitted = table(spark, sf, "nation").select(
        F.lit("app-R").alias("application"),
        F.to_json(F.struct(F.lit("SparkListenerStageSubmitted").alias("Event"), stage.alias("Stage Info"))).alias("value"),
    )
    folder = scratch(spark, "event-log")
    for part in (ends, submitted):  # one after the other, as a union has no order
        # compressed by a fast codec, as Spark writes its own logs
        part.write.mode("append").partitionBy("application").text(folder, compression="lz4")
    return observe.read_event_log(spark, folder)


_STAGE_COLUMNS = """max_task_ms p95_task_ms scheduler_delay_ms shuffle_read_bytes shuffle_write_bytes input_bytes
  output_bytes memory_bytes_spilled disk_bytes_spilled executor_cpu_time_ns gc_time_ms median_input_bytes
  p95_input_bytes max_input_bytes median_shuffle_read_bytes p95_shuffle_read_bytes max_shuffle_read_bytes
  median_shuffle_write_bytes p95_shuffle_write_bytes max_shuffle_write_bytes""".split()


def _stage_oracle(attempt):
    def rank(column, place):
        return f"max(CASE WHEN {column}_rn = {place} THEN {column} END)"

    numbered = ", ".join(
        f"row_number() OVER (PARTITION BY app, stage_id, attempt ORDER BY {c}) AS {c}_rn" for c in ("dur", "input", "rd", "wr")
    )
    spread = ", ".join(
        f"({rank(c, '(n + 1) // 2')} + {rank(c, '(n + 2) // 2')}) / 2 AS median_{name}, "
        f"{rank(c, 'ceil(n * 0.95)')} AS p95_{name}, max({c}) AS max_{name}"
        for c, name in (("input", "input_bytes"), ("rd", "shuffle_read_bytes"), ("wr", "shuffle_write_bytes"))
    )
    return f"""
      WITH tasks AS (
        SELECT l_returnflag AS app, CAST(l_linenumber AS BIGINT) AS stage_id, {attempt} AS attempt,
               CAST(trunc(l_extendedprice) AS BIGINT) AS dur, l_linenumber AS line, l_partkey * 1000 AS cpu,
               CAST(l_quantity AS BIGINT) AS mem, l_partkey + CAST(l_quantity AS BIGINT) AS rd, l_orderkey AS wr,
               l_partkey * l_linenumber AS input, l_suppkey AS output FROM lineitem),
      ranked AS (SELECT *, count(*) OVER (PARTITION BY app, stage_id, attempt) AS n, {numbered} FROM tasks),
      stages AS (
        SELECT app, stage_id, attempt, count(*) AS task_count,
               ({rank('dur', '(n + 1) // 2')} + {rank('dur', '(n + 2) // 2')}) / 2 AS median_task_ms,
               max(dur) AS max_task_ms, {rank('dur', 'ceil(n * 0.95)')} AS p95_task_ms,
               CAST(sum(least(10 * line, dur)) AS BIGINT) AS scheduler_delay_ms, CAST(sum(rd) AS BIGINT) AS shuffle_read_bytes,
               CAST(sum(wr) AS BIGINT) AS shuffle_write_bytes, CAST(sum(input) AS BIGINT) AS input_bytes,
               CAST(sum(output) AS BIGINT) AS output_bytes, CAST(sum(mem) AS BIGINT) AS memory_bytes_spilled,
               0::BIGINT AS disk_bytes_spilled, CAST(sum(cpu) AS BIGINT) AS executor_cpu_time_ns,
               CAST(sum(line) AS BIGINT) AS gc_time_ms, {spread}
        FROM ranked GROUP BY app, stage_id, attempt),
      named AS (
        SELECT * REPLACE ('app-' || app AS app, coalesce(task_count, 0) AS task_count, coalesce(median_task_ms, 0) AS median_task_ms),
               coalesce(n_name, '') AS name
        FROM stages FULL JOIN (SELECT 'R' AS app, CAST(n_nationkey AS BIGINT) AS stage_id, 0 AS attempt, n_name FROM nation)
        USING (app, stage_id, attempt)),
      scored AS (
        SELECT *, CASE WHEN median_task_ms > 0 THEN round(max_task_ms / median_task_ms, 2) ELSE 0 END AS skew_score FROM named)
      SELECT app, stage_id, CAST(attempt AS BIGINT) AS attempt, name, task_count, median_task_ms, skew_score,
             {', '.join(f'coalesce({c}, 0) AS {c}' for c in _STAGE_COLUMNS)},
             CASE WHEN skew_score >= 3 THEN 'severe skew' WHEN skew_score >= 1.9 THEN 'moderate skew'
                  ELSE 'balanced/unknown' END AS diagnostic
      FROM scored"""


@query("d6_stage_summary", _stage_oracle("CAST(l_linestatus = 'F' AS INT)"))
def d6_stage_summary(spark, sf):
    log = event_log(spark, sf)
    return observe.stage_summary(log, moderate=1.9, severe=3.0, store=scratch(spark, "tasks"))


@query("d6_stage_summary_merged", _stage_oracle("0"))
def d6_stage_summary_merged(spark, sf):
    """All attempts of a stage together."""
    return observe.stage_summary(event_log(spark, sf), moderate=1.9, severe=3.0, merge_attempts=True)


# Each event is a progress report of its user's query, under one of the three names.


def progress_log(spark, sf):
    progress = F.struct(
        F.concat(F.lit("query-"), F.col("user_id")).alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("event_id").alias("batchId"),
        F.expr("CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)").alias("numInputRows"),
        F.col("value").alias("inputRowsPerSecond"),
        (F.col("value") * 2).alias("processedRowsPerSecond"),
        F.struct(F.date_format("ts", "yyyy-MM-dd").alias("watermark")).alias("eventTime"),
        F.array(
            F.struct(
                F.lit("stateStoreSave").alias("operatorName"),
                F.col("event_id").alias("numRowsTotal"),
                F.col("user_id").alias("numRowsUpdated"),
                (F.col("event_id") * 100).alias("memoryUsedBytes"),
            )
        ).alias("stateOperators"),
    )
    name = F.expr(
        """CASE event_type
             WHEN 'click' THEN 'org.apache.spark.sql.streaming.StreamingQueryListener$QueryProgressEvent'
             WHEN 'view' THEN 'SparkListenerStreamingQueryProgress' END"""
    )
    lower = F.expr("CASE WHEN event_type = 'purchase' THEN 'query_progress' END")
    place = F.expr("CASE WHEN event_type = 'error' THEN concat('/checkpoints/', user_id) END")
    whole = F.struct(
        name.alias("Event"), lower.alias("event"), place.alias("checkpointLocation"), progress.alias("progress")
    )
    folder = scratch(spark, "progress-log")
    table(spark, sf, "events").select(F.to_json(whole).alias("value")).write.text(folder)
    return sources.read_file(spark, folder, "text")


_REPORTS = "(SELECT * FROM events WHERE event_type IN ('click', 'view', 'purchase'))"


@query(
    "d7_streaming_progress",
    f"""SELECT 'query-' || user_id AS query_id, count(*) AS batches, max(event_id) AS batch_id,
               CAST(regexp_extract(arg_max(props, event_id), '[0-9]+') AS BIGINT) AS num_input_rows,
               arg_max(value, event_id) AS input_rows_per_second, 2 * arg_max(value, event_id) AS processed_rows_per_second,
               strftime(arg_max(ts, event_id), '%Y-%m-%d') AS watermark
        FROM {_REPORTS} GROUP BY user_id""",
)
def d7_streaming_progress(spark, sf):
    """The latest report of every query (event ids follow time)."""
    latest = observe.streaming_progress(progress_log(spark, sf)).latest
    return latest.select(
        "query_id",
        "batches",
        "batch_id",
        "num_input_rows",
        "input_rows_per_second",
        "processed_rows_per_second",
        "watermark",
    )


@query(
    "d7_streaming_state",
    f"""SELECT 'query-' || user_id AS query_id, event_id AS batch_id, 'stateStoreSave' AS operator,
               event_id AS num_rows_total, user_id AS num_rows_updated, event_id * 100 AS memory_used_bytes FROM {_REPORTS}""",
)
def d7_streaming_state(spark, sf):
    return observe.streaming_progress(progress_log(spark, sf)).state.drop("timestamp")


@query(
    "d7_streaming_checkpoints",
    "SELECT DISTINCT '/checkpoints/' || user_id AS checkpoint FROM events WHERE event_type = 'error'",
)
def d7_streaming_checkpoints(spark, sf):
    return observe.streaming_progress(progress_log(spark, sf)).checkpoints


# Each order is a run, compared with the customer's next order; its lines are the stages.


def _pairs(spark, sf):
    nexts = ops.split_window(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
        "right_run",
        "lead",
        ["o_orderdate", "o_orderkey"],
        "o_orderkey",
        ["o_custkey"],
        split_by="year(o_orderdate)",
    )
    return nexts.where("right_run IS NOT NULL").selectExpr("o_orderkey AS left_run", "right_run")


_PAIRS = """(SELECT * FROM (
    SELECT o_orderkey AS left_run, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS right_run
    FROM orders) WHERE right_run IS NOT NULL) p"""


@query(
    "d8_run_deltas",
    f"""SELECT left_run, right_run, floor(l.o_totalprice) AS left_seconds, floor(r.o_totalprice) AS right_seconds,
               floor(r.o_totalprice) - floor(l.o_totalprice) AS delta_seconds, l.o_orderstatus <> r.o_orderstatus AS status_changed,
               l.o_orderpriority <> r.o_orderpriority AS mode_changed, l.o_custkey <> r.o_custkey AS code_changed, true AS available
        FROM {_PAIRS} JOIN orders l ON l.o_orderkey = left_run JOIN orders r ON r.o_orderkey = right_run""",
)
def d8_run_deltas(spark, sf):
    runs = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id",
        "CAST(o_orderdate AS TIMESTAMP) AS started_at",
        "timestamp_seconds(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + CAST(o_totalprice AS BIGINT)) AS finished_at",
        "o_orderstatus AS status",
        "o_orderpriority AS mode",
        "o_custkey AS code_hash",
    )
    return observe.run_deltas(runs, _pairs(spark, sf))


@query(
    "d8_stage_deltas",
    f"""WITH s AS (SELECT l_orderkey AS run, l_linenumber AS stage_id, sum(l_partkey) AS rd, sum(l_suppkey) AS wr
                   FROM lineitem GROUP BY ALL),
             keys AS (SELECT left_run, right_run, stage_id FROM {_PAIRS} JOIN s ON run IN (left_run, right_run) GROUP BY ALL)
        SELECT left_run, right_run, k.stage_id,
               CAST(coalesce(r.rd, 0) - coalesce(l.rd, 0) AS BIGINT) AS shuffle_read_bytes_delta,
               CAST(coalesce(r.wr, 0) - coalesce(l.wr, 0) AS BIGINT) AS shuffle_write_bytes_delta,
               left_run IN (SELECT run FROM s) AND right_run IN (SELECT run FROM s) AS available
        FROM keys k LEFT JOIN s l ON l.run = left_run AND l.stage_id = k.stage_id
        LEFT JOIN s r ON r.run = right_run AND r.stage_id = k.stage_id
        UNION ALL SELECT left_run, right_run, NULL, NULL, NULL, false FROM {_PAIRS}
        WHERE left_run NOT IN (SELECT run FROM s) AND right_run NOT IN (SELECT run FROM s)""",
)
def d8_stage_deltas(spark, sf):
    stages = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS run_id",
        "l_linenumber AS stage_id",
        "l_partkey AS shuffle_read_bytes",
        "l_suppkey AS shuffle_write_bytes",
    )
    return observe.stage_deltas(stages, _pairs(spark, sf)).select(
        "left_run", "right_run", "stage_id", "shuffle_read_bytes_delta", "shuffle_write_bytes_delta", "available"
    )


@query(
    "d8_problem_changes",
    f"""WITH m AS (SELECT DISTINCT l_orderkey AS run, l_returnflag || ' of supplier ' || l_suppkey AS message FROM lineitem)
        SELECT left_run, right_run, 'added' AS change, message FROM {_PAIRS} JOIN m ON run = right_run
        WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.run = left_run AND o.message = m.message)
        UNION ALL
        SELECT left_run, right_run, 'removed', message FROM {_PAIRS} JOIN m ON run = left_run
        WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.run = right_run AND o.message = m.message)""",
)
def d8_problem_changes(spark, sf):
    problems = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS run_id", "concat(l_returnflag, ' of supplier ', l_suppkey) AS message"
    )
    return observe.problem_changes(problems, _pairs(spark, sf))


# Nodes of a run: the numbers of an order's lines. A line's flags decide which fields its node has and their types.

_NODE_FACTS = """(SELECT l_orderkey AS run_id, l_linenumber AS node_id, min(l_returnflag) AS flag, max(l_linestatus) AS status, count(*) AS n,
                         min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY ALL)"""


def _node_snapshots(spark, sf):
    facts = ops.dealt(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node_id")).agg(
        F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")
    )
    return facts.selectExpr(
        "run_id",
        "node_id",
        """CASE WHEN low < 48 THEN array_compact(array(named_struct('name', 'id', 'type', 'long', 'nullable', false),
             named_struct('name', 'state', 'type', CASE status WHEN 'F' THEN 'string' ELSE 'int' END, 'nullable', true),
             CASE WHEN flag = 'R' THEN named_struct('name', 'returned', 'type', 'boolean', 'nullable', true) END)) END AS schema""",
        """CASE WHEN high > 2 THEN array(named_struct('column', 'quantity', 'count', n, 'null_count', 0L, 'distinct_count', n, 'min', low, 'max', high)) END AS profile""",
    )


_NODES_MET = f"""met AS (
      SELECT left_run, right_run, node_id, b.low < 48 AS b_has, a.low < 48 AS a_has, b.high > 2 AS b_prof, a.high > 2 AS a_prof,
             b.flag = 'R' AS b_ret, a.flag = 'R' AS a_ret, CASE b.status WHEN 'F' THEN 'string' ELSE 'int' END AS b_type,
             CASE a.status WHEN 'F' THEN 'string' ELSE 'int' END AS a_type, b.n AS b_n, a.n AS a_n, b.low AS b_low, a.low AS a_low, b.high AS b_high, a.high AS a_high
      FROM (SELECT left_run, right_run, node_id FROM {_PAIRS} JOIN {_NODE_FACTS} f ON run_id IN (left_run, right_run) GROUP BY ALL)
      LEFT JOIN (SELECT run_id AS left_run, * EXCLUDE (run_id) FROM {_NODE_FACTS} x) b USING (left_run, node_id)
      LEFT JOIN (SELECT run_id AS right_run, * EXCLUDE (run_id) FROM {_NODE_FACTS} y) a USING (right_run, node_id))"""


@query(
    "d8_node_schema_diffs",
    f"""WITH {_NODES_MET}, told AS (SELECT *, coalesce(b_has, false) AND coalesce(a_has, false) AS ok FROM met)
        SELECT left_run, right_run, node_id, true AS available, NULL AS reason, 'state' AS path, 'type_changed' AS kind,
               b_type AS before_type, a_type AS after_type, true AS breaking FROM told WHERE ok AND b_type <> a_type
        UNION ALL SELECT left_run, right_run, node_id, true, NULL, 'returned', 'added', NULL, 'boolean', false FROM told WHERE ok AND a_ret AND NOT b_ret
        UNION ALL SELECT left_run, right_run, node_id, true, NULL, 'returned', 'removed', 'boolean', NULL, true FROM told WHERE ok AND b_ret AND NOT a_ret
        UNION ALL SELECT left_run, right_run, node_id, true, NULL, NULL, NULL, NULL, NULL, NULL FROM told WHERE ok AND b_type = a_type AND a_ret = b_ret
        UNION ALL SELECT left_run, right_run, node_id, false, 'schema missing', NULL, NULL, NULL, NULL, NULL FROM told WHERE NOT ok""",
)
def d8_node_schema_diffs(spark, sf):
    diffs = observe.node_schema_diffs(observe.node_snapshots(_node_snapshots(spark, sf), _pairs(spark, sf)))
    return diffs.select(
        "left_run", "right_run", "node_id", "available", "reason", "path", "kind", "before_type", "after_type", "breaking"
    )


@query(
    "d8_node_profile_diffs",
    f"""WITH {_NODES_MET}, told AS (SELECT *, coalesce(b_prof, false) AND coalesce(a_prof, false) AS ok FROM met),
             metrics AS (SELECT * FROM (VALUES ('count'), ('null_count'), ('distinct_count'), ('min'), ('max')) m(metric)),
             valued AS (SELECT left_run, right_run, node_id, metric,
                 CAST(CASE metric WHEN 'null_count' THEN 0 WHEN 'min' THEN b_low WHEN 'max' THEN b_high ELSE b_n END AS DOUBLE) AS before,
                 CAST(CASE metric WHEN 'null_count' THEN 0 WHEN 'min' THEN a_low WHEN 'max' THEN a_high ELSE a_n END AS DOUBLE) AS after FROM told, metrics WHERE ok)
        SELECT left_run, right_run, node_id, true AS available, NULL AS reason, metric, 'ok' AS status, before, after, after - before AS delta FROM valued
        UNION ALL SELECT left_run, right_run, node_id, false, 'profile metrics missing', NULL, NULL, NULL, NULL, NULL FROM told WHERE NOT ok""",
)
def d8_node_profile_diffs(spark, sf):
    diffs = observe.node_profile_diffs(observe.node_snapshots(_node_snapshots(spark, sf), _pairs(spark, sf)))
    return diffs.select("left_run", "right_run", "node_id", "available", "reason", "metric", "status", "before", "after", "delta")


# Suppliers are nodes with line ranges, events are log lines naming a code line.

_RANGES = """(SELECT s_suppkey AS node_id, 'transformations/generated.py' AS file, CAST(1 + 3 * s_nationkey AS INT) AS start_line,
                CAST(1 + 3 * s_nationkey + abs(round(s_acctbal / 500)) AS INT) AS end_line FROM supplier)"""
_LOG_LINES = """(SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INT) AS n, event_type IN ('error', 'click') AS speaks FROM events)"""


@query(
    "d9_attribute_log_lines",
    f"""SELECT event_id, CASE WHEN speaks THEN n END AS generated_line, node_id, start_line, end_line
        FROM {_LOG_LINES} LEFT JOIN {_RANGES} ON speaks AND n BETWEEN start_line AND end_line
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY end_line - start_line, start_line, node_id) = 1""",
)
def d9_attribute_log_lines(spark, sf):
    source_map = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS node_id",
        "'transformations/generated.py' AS file",
        "CAST(1 + 3 * s_nationkey AS INT) AS start_line",
        "CAST(1 + 3 * s_nationkey + abs(round(s_acctbal / 500)) AS INT) AS end_line",
    )
    k = "regexp_extract(props, '[0-9]+', 0)"
    lines = table(spark, sf, "events").selectExpr(
        "event_id",
        f"""CASE event_type
              WHEN 'error' THEN concat('  File "transformations/generated.py", line ', {k}, ', in <module>')
              WHEN 'click' THEN concat('at generated.py:', {k})
              ELSE concat('step ', {k}, ' done') END AS text""",
    )
    found = observe.attribute_log_lines(lines, source_map)
    return found.select("event_id", "generated_line", "node_id", "start_line", "end_line")


# Whole document texts, with an error report appended that depends on the document.

_CLASSES = """CASE source WHEN 'src1' THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' WHEN 'src2' THEN 'TABLE_OR_VIEW_NOT_FOUND'
              WHEN 'src3' THEN 'OUT_OF_MEMORY_ERROR' WHEN 'src4' THEN 'AMBIGUOUS_REFERENCE' ELSE '' END"""
_REPORT = """concat(text, CASE lang WHEN 'en' THEN ' Java heap space: executor OOM' WHEN 'fr' THEN ' pod is in ImagePullBackOff'
              WHEN 'de' THEN ' No suitable driver; cannot list pods' ELSE ' bad checkpoint; operation not supported' END)"""


def _diagnoses():
    from pipeops.observe import DEFAULT_RULES

    parts = []
    for rule in DEFAULT_RULES:
        tests = []
        if rule.class_pattern:
            tests.append(f"regexp_matches(cls, '{rule.class_pattern}')")
        if rule.text_pattern:
            tests.append(f"regexp_matches(msg, '{rule.text_pattern}')")
        parts.append(
            f"SELECT doc_id, '{rule.rule_id}' AS rule_id, 'DIAG-' || upper(replace('{rule.rule_id}', '.', '-')) AS code, '{rule.severity}' AS severity, "
            f"'{rule.cause}' AS probable_cause FROM d WHERE {' AND '.join(tests)}"
        )
    return f"WITH d AS (SELECT doc_id, {_CLASSES} AS cls, {_REPORT} AS msg FROM documents) " + " UNION ALL ".join(parts)


@query("d10_diagnose", _diagnoses())
def d10_diagnose(spark, sf):
    logs = table(spark, sf, "documents").selectExpr("doc_id", f"{_CLASSES} AS cls", f"{_REPORT} AS msg")
    return observe.diagnose(logs, "msg", "cls").select("doc_id", "rule_id", "code", "severity", "probable_cause")


# The retail flow, traced.


def _traced(spark, sf):
    orders = observe.Trace.start(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"),
        ["o_orderkey"],
        "orders",
    )
    known = table(spark, sf, "customer").selectExpr("if(c_custkey % 4 = 0, -c_custkey, c_custkey) AS c_custkey", "c_mktsegment")
    customers = observe.Trace.start(known, ["c_custkey"], "customers")
    finished = orders.filter("o_orderstatus = 'F'", "finished").derive("half", "o_totalprice / 2")
    return finished.join(customers, "left.o_custkey = right.c_custkey", name="with_customer")


def _totals(spark, sf):
    return _traced(spark, sf).aggregate(
        ["c_mktsegment"], [{"expression": "count(*)", "alias": "orders"}], "by_segment"
    )


_TRACE = """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
                 r AS (SELECT * REPLACE (CASE WHEN c_custkey % 4 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey) FROM customer),
                 j AS (SELECT * FROM f JOIN r ON o_custkey = c_custkey)"""


@query(
    "d11_trace_report",
    f"""{_TRACE}, n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM f) AS f,
                              (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM j) AS j,
                              (SELECT count(DISTINCT c_mktsegment) FROM j) AS g)
        SELECT 0 AS ordinal, 'orders' AS step, 'source' AS type, 0 AS rows_in, o AS rows_out, 'known' AS status FROM n
        UNION ALL SELECT 1, 'finished', 'filter', o, f, 'known' FROM n
        UNION ALL SELECT 2, 'derive', 'derive', f, f, 'known' FROM n
        UNION ALL SELECT 3, 'customers', 'source', 0, r, 'known' FROM n
        UNION ALL SELECT 4, 'with_customer', 'join', f + r, j, 'known' FROM n
        UNION ALL SELECT 5, 'by_segment', 'aggregate', j, g, 'known' FROM n""",
)
def d11_trace_report(spark, sf):
    return _totals(spark, sf).report()


@query(
    "d11_trace_fates",
    f"""{_TRACE} SELECT 'orders:' || o_orderkey AS trace_id, 'finished' AS step, 'filter' AS type
                FROM orders WHERE o_orderstatus <> 'F'
        UNION ALL SELECT 'orders:' || o_orderkey, 'with_customer', 'join' FROM f
                  WHERE o_custkey NOT IN (SELECT c_custkey FROM r)
        UNION ALL SELECT 'customers:' || c_custkey, 'with_customer', 'join' FROM r
                  WHERE c_custkey NOT IN (SELECT o_custkey FROM f)""",
)
def d11_trace_fates(spark, sf):
    """Which step dropped which order or customer."""
    return _totals(spark, sf).fates()


@query(
    "d11_trace_join",
    f"""{_TRACE} SELECT o_orderkey, 'orders:' || o_orderkey || ',customers:' || c_custkey AS ids, false AS trace_overflow FROM j""",
)
def d11_trace_join(spark, sf):
    lineage = _traced(spark, sf).lineage()
    return lineage.selectExpr("o_orderkey", "array_join(trace_ids, ',') AS ids", "trace_overflow")


@query(
    "d11_trace_aggregate",
    f"""{_TRACE} SELECT 'by_segment:' || c_mktsegment AS group_id, 'orders:' || o_orderkey AS trace_id FROM j
        UNION ALL SELECT 'by_segment:' || c_mktsegment, 'customers:' || c_custkey FROM j""",
)
def d11_trace_aggregate(spark, sf):
    """Every row that went into each group."""
    return _totals(spark, sf).contributions().select("group_id", "trace_id")


@query(
    "d11_trace_explode",
    """SELECT 'vectors:' || vec_id AS id, CAST(i AS INT) AS trace_ordinal, CAST(embedding[i + 1] AS DOUBLE) AS x
       FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def d11_trace_explode(spark, sf):
    """Copies of a row keep its id and get an ordinal."""
    vectors = observe.Trace.start(table(spark, sf, "embeddings"), ["vec_id"], "vectors")
    lineage = vectors.explode("embedding", "x").lineage()
    return lineage.selectExpr("trace_ids[0] AS id", "trace_ordinal", "CAST(x AS DOUBLE) AS x")


# Secrets in texts and in JSON.

_MASK = "***REDACTED***"
_ASSIGNMENT = r"(?i)(token|password|secret)=([^;\s,&]+)"
_CREDENTIAL = r"(?i)(bearer\s+|(?:token|password|secret|api[_-]?key)\s*[=:]\s*)[^\s,;]+"


def _redacted_sql(text):
    first = f"regexp_replace({text}, '{_ASSIGNMENT}', '\\1={_MASK}', 'g')"
    return f"regexp_replace({first}, '{_CREDENTIAL}', '\\1{_MASK}', 'g')"


_NAMES = {"customer_name": "Customer#000000007", "plain_word": "therouou"}


@query(
    "d12_redact_documents",
    f"""SELECT doc_id, {_redacted_sql(f"replace(text, 'therouou', '{_MASK}')")} AS text,
               CASE WHEN contains(text, 'therouou') THEN 'plain_word' ELSE '' END AS matched FROM documents""",
)
def d12_redact_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    df = observe.redact(docs, ["text"], _NAMES, matched="matched")
    return df.withColumn("matched", F.array_join("matched", ","))


@query("d12_redact_pages", f"SELECT page_id, {_redacted_sql('html')} AS html FROM pages")
def d12_redact_pages(spark, sf):
    return observe.redact(table(spark, sf, "pages").select("page_id", "html"), ["html"])


@query("d12_redact_conversations", f"SELECT conv_id, turn, {_redacted_sql('text')} AS text FROM conversations")
def d12_redact_conversations(spark, sf):
    return observe.redact(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["text"])


@query(
    "d12_redaction_counts",
    f"""SELECT 'text' AS "column", 'pattern' AS kind, 'assignment' AS name,
               CAST(sum(len(regexp_extract_all(text, '{_ASSIGNMENT}'))) AS BIGINT) AS matches,
               count(*) FILTER (WHERE regexp_matches(text, '{_ASSIGNMENT}')) AS rows FROM documents
        UNION ALL SELECT 'text', 'pattern', 'credential',
               CAST(sum(len(regexp_extract_all(text, '{_CREDENTIAL}'))) AS BIGINT),
               count(*) FILTER (WHERE regexp_matches(text, '{_CREDENTIAL}')) FROM documents
        UNION ALL SELECT 'text', 'secret', 'plain_word',
               CAST(sum(len(string_split(text, 'therouou')) - 1) AS BIGINT),
               count(*) FILTER (WHERE contains(text, 'therouou')) FROM documents""",
)
def d12_redaction_counts(spark, sf):
    return observe.redaction_counts(table(spark, sf, "documents"), ["text"], {"plain_word": "therouou"})


@query(
    "d12_redact_nested",
    f"""SELECT event_id, '{_MASK}' AS password, event_type AS kind, '{_MASK}' AS map_token,
               'k=' || regexp_extract(props, '[0-9]+') AS map_plain, 'bearer {_MASK}' AS header FROM events""",
)
def d12_redact_nested(spark, sf):
    """Strings under marked keys are masked whole, wherever they are."""
    k = "regexp_extract(props, '[0-9]+', 0)"
    df = table(spark, sf, "events").selectExpr(
        "event_id",
        f"""named_struct('db_password', concat('p', {k}), 'kind', event_type,
              'env', map('API_TOKEN', {k}, 'plain', concat('k=', {k})),
              'headers', array(concat('bearer ', {k}))) AS v""",
    )
    clean = observe.redact_value(F.col("v"), df.schema["v"].dataType)
    return df.withColumn("v", clean).selectExpr(
        "event_id",
        "v.db_password AS password",
        "v.kind",
        "v.env['API_TOKEN'] AS map_token",
        "v.env['plain'] AS map_plain",
        "v.headers[0] AS header",
    )


@query(
    "d13_secret_literals",
    """SELECT event_id, 'config.db.password' AS path, CAST(len(event_type) AS INT) AS value_length FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, 'config.sinks[1].api_key', CAST(len(CAST(user_id AS VARCHAR)) AS INT) FROM events
       UNION ALL SELECT event_id, 'config.token_list.private_key.secret', 4 FROM events WHERE event_type = 'click'""",
)
def d13_secret_literals(spark, sf):
    """Literals at several depths; references, empty strings and numbers do not count."""
    configs = table(spark, sf, "events").selectExpr(
        "event_id",
        """to_json(named_struct(
             'db', named_struct('password', CASE event_type WHEN 'error' THEN 'secret://DB' ELSE event_type END, 'port', 5432),
             'sinks', array(named_struct('api_key', '', 'name', 'a'), named_struct('api_key', CAST(user_id AS STRING), 'name', 'b')),
             'access_key', event_id,
             'token_list', CASE event_type WHEN 'click' THEN
                named_struct('private_key', named_struct('secret', 'abcd')) END)) AS config""",
    )
    return observe.secret_literals(configs, "config", ["event_id"])


# Each event is a captured plan; the second capture of a clicked one has another plan.

_TEXTS = (plan_texts.JOINED, plan_texts.WINDOWED, plan_texts.UNITED)
_QUOTED = ", ".join("'" + text.replace("'", "''") + "'" for text in _TEXTS)


#: The operator lines of each text, taken apart once in SQL.
_NODES = f"""nodes AS MATERIALIZED (
      SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY line) - 1 AS node_index, operator,
             CAST(len(branch) / 3 AS INT) AS depth, line, phase, raw,
             CASE WHEN ends_with(operator, 'Exchange') AND operator <> 'ReusedExchange' THEN regexp_replace(regexp_replace(
               substr(raw, strpos(raw, operator)), '#[0-9]+L?', '#?', 'g'), '\\b((?:plan_)?id)=#?[0-9]+', '\\1=?', 'g') END AS exchange FROM (
        SELECT *, regexp_extract(raw, '^((?:[: ]  )*(?:[:+]- )?)', 1) AS branch,
               regexp_extract(raw, '^(?:[: ]  )*(?:[:+]- )?(?:[*](?:[(][0-9]+[)])?[ ])?[''!]?([A-Z][A-Za-z0-9]*)(?:[ (\\[,]|$)', 1) AS operator,
               CASE headed WHEN '== Parsed Logical Plan ==' THEN 'parsed' WHEN '== Analyzed Logical Plan ==' THEN 'analyzed'
                 WHEN '== Optimized Logical Plan ==' THEN 'optimized' WHEN '== Physical Plan ==' THEN 'physical' END AS phase
        FROM (SELECT *, max(CASE WHEN raw LIKE '==%' THEN line END) OVER above AS heading,
                     max(CASE WHEN raw = '' THEN line END) OVER above AS blank,
                     max_by(raw, line) FILTER (WHERE raw LIKE '==%') OVER above AS headed
              FROM (SELECT text_id, unnest(range(1, len(lines) + 1)) AS line, rtrim(unnest(lines)) AS raw
                    FROM (SELECT i AS text_id, string_split([{_QUOTED}][i + 1], chr(10)) AS lines FROM range(3) t(i)))
              WINDOW above AS (PARTITION BY text_id ORDER BY line)))
      WHERE operator <> '' AND (blank IS NULL OR blank < heading) AND NOT (phase = 'analyzed' AND line = heading + 1))"""


def _plan_lines(shift: int) -> str:
    """SQL: the operator lines of every event's plan."""
    return f"""SELECT event_id, nodes.* FROM nodes JOIN events
               ON text_id = (event_id + CASE WHEN event_type = 'click' THEN {shift} ELSE 0 END) % 3"""


_STRATEGY = "CASE operator WHEN 'BroadcastHashJoin' THEN 'broadcast' WHEN 'SortMergeJoin' THEN 'sort_merge' END"
_PARTS = "CASE WHEN operator = 'Exchange' THEN CASE WHEN contains(raw, 'SinglePartition') THEN 1 ELSE TRY_CAST(regexp_extract(raw, '(?i)partitioning[(](?:.*, )?([0-9]+)[)]', 1) AS INT) END END"


def _plans(spark, sf, shift=0, together=False):
    texts = F.array(*map(F.lit, _TEXTS))
    at = (F.col("event_id") + F.when(F.col("event_type") == "click", shift).otherwise(0)) % 3 + 1
    events = table(spark, sf, "events").select("event_id", "event_type")
    # a text of a few hundred bytes has dozens of nodes: rows are dealt out before they grow, by
    # their key if two plans of an event are to meet
    events = ops.dealt(events, ["event_id"]) if together else ops.repartition(events, spark.sparkContext.defaultParallelism)
    return events.select("event_id", F.element_at(texts, at.cast("int")).alias("text"))


@query(
    "d14_plan_nodes",
    f"""WITH {_NODES} SELECT event_id, node_index, operator, depth, line, phase, {_STRATEGY} AS join_strategy, {_PARTS} AS partitioning, exchange,
              regexp_replace(regexp_replace(raw, '#[0-9]+L?', '#?', 'g'), '\\b((?:plan_)?id)=#?[0-9]+', '\\1=?', 'g') AS normalized
       FROM ({_plan_lines(0)})""",
)
def d14_plan_nodes(spark, sf):
    return plans.plan_nodes(_plans(spark, sf), ["event_id"]).drop("raw")


@query(
    "d14_plan_changes",
    f"""WITH {_NODES}, l AS (SELECT *, {_STRATEGY} AS s, {_PARTS} AS p FROM ({_plan_lines(0)})),
             r AS (SELECT *, {_STRATEGY} AS s, {_PARTS} AS p FROM ({_plan_lines(1)}))
       SELECT event_id, node_index, CASE WHEN l.operator IS NULL THEN 'add' WHEN r.operator IS NULL THEN 'remove'
                WHEN l.operator <> r.operator THEN 'replace' ELSE 'alter' END AS op,
              l.operator AS before_operator, r.operator AS after_operator,
              l.operator IS NOT NULL AND r.operator IS NOT NULL AND l.s IS DISTINCT FROM r.s AS join_strategy_changed,
              l.operator IS NOT NULL AND r.operator IS NOT NULL AND l.p IS DISTINCT FROM r.p AS partitioning_changed,
              l.operator IS NOT NULL AND r.operator IS NOT NULL AND l.exchange IS DISTINCT FROM r.exchange AS exchange_changed
       FROM l FULL JOIN r USING (event_id, node_index)
       WHERE l.operator IS DISTINCT FROM r.operator OR l.phase IS DISTINCT FROM r.phase OR l.s IS DISTINCT FROM r.s
          OR l.p IS DISTINCT FROM r.p OR l.exchange IS DISTINCT FROM r.exchange""",
)
def d14_plan_changes(spark, sf):
    """The plan of every event against a second capture of it."""
    left = plans.plan_nodes(_plans(spark, sf, together=True), ["event_id"])
    right = plans.plan_nodes(_plans(spark, sf, 1, together=True), ["event_id"])
    return plans.plan_changes(left, right, ["event_id"], together=True).select(
        "event_id",
        "node_index",
        "op",
        "before_operator",
        "after_operator",
        "join_strategy_changed",
        "partitioning_changed",
        "exchange_changed",
    )


@query(
    "d14_plan_metric_changes",
    f"""WITH {_NODES} SELECT event_id, node_index, operator, '{{"ms":7,"rows":' || (event_id + node_index) || '}}' AS before_metrics,
              '{{"ms":7,"rows":' || (event_id + node_index + user_id % 3) || '}}' AS after_metrics
       FROM ({_plan_lines(0)}) JOIN events USING (event_id) WHERE user_id % 3 > 0 AND phase = 'physical'""",
)
def d14_plan_metric_changes(spark, sf):
    """The same plans run twice: what the nodes of the physical plan measured."""
    users = table(spark, sf, "events").select("event_id", "user_id")
    physical = plans.plan_nodes(_plans(spark, sf), ["event_id"]).where("phase = 'physical'")
    nodes = ops.dealt(physical, ["event_id"]).join(ops.dealt(users, ["event_id"]), "event_id")
    first, second = (
        nodes.withColumn("metrics", F.expr(f"map('rows', event_id + node_index + {more}, 'ms', 7L)")) for more in ("0", "user_id % 3")
    )
    changed = plans.plan_changes(first, second, ["event_id"]).where("metrics_changed")
    return changed.selectExpr("event_id", "node_index", "before_operator AS operator", "before_metrics", "after_metrics")


@query(
    "d14_plan_operator_changes",
    f"""WITH {_NODES}, l AS (SELECT DISTINCT event_id, operator FROM ({_plan_lines(0)})), r AS (SELECT DISTINCT event_id, operator FROM ({_plan_lines(1)}))
       SELECT event_id, operator, 'removed' AS change FROM l ANTI JOIN r USING (event_id, operator)
       UNION ALL SELECT event_id, operator, 'added' FROM r ANTI JOIN l USING (event_id, operator)""",
)
def d14_plan_operator_changes(spark, sf):
    left = plans.plan_nodes(_plans(spark, sf), ["event_id"])
    right = plans.plan_nodes(_plans(spark, sf, 1), ["event_id"])
    return plans.plan_operator_changes(left, right, ["event_id"])
