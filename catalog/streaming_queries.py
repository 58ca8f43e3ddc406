"""Event time and state. Each query runs a real stream over the table's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeops import operators as ops
from pipeops import sources, streaming
from pipeops.session import scratch

from .registry import query, table


def event_stream(spark, sf, **options):
    """The events as a stream with a time-zone timestamp, as a watermark needs it."""
    stream = sources.read_file(
        spark,
        sf,
        "parquet",
        streaming=True,
        schema=table(spark, sf, "events").schema,
        options={"pathGlobFilter": "events.parquet", **options},
    )
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _append(spark, df, label):
    home = scratch(spark, label)
    return streaming.drain(df, f"{home}/rows", f"{home}/checkpoint")


def _closed(spark, sf, label, build, rows=({},)):
    """All rows of an append stream: it runs over the events, and once more after closing rows."""
    home = scratch(spark, label)
    end = table(spark, sf, "events").agg(F.max("ts") + F.expr("INTERVAL 60 DAYS")).first()[0]
    for more in (False, True):
        events = event_stream(spark, sf)
        if more:
            streaming.close(spark, f"{home}/closing", events.schema, [{"ts": end, **row} for row in rows])
        df = build(streaming.with_closing_rows(events, f"{home}/closing"))
        out = streaming.drain(df, f"{home}/rows", f"{home}/checkpoint")
    return out


def _start(column="window.start"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("window_start")


_COUNTS = [
    {"expression": "count(*)", "alias": "n"},
    {"expression": "round(sum(value), 2)", "alias": "total"},
]


@query(
    "e1_watermark",
    """SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, total FROM (
         SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total
         FROM events GROUP BY ALL)
       WHERE day + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
)
def e1_watermark(spark, sf):
    """Append mode gives the windows that the watermark has closed."""
    df = streaming.watermark(event_stream(spark, sf), "ts", "1 hour")
    df = ops.aggregate(df, ["window(ts, '1 day')", "event_type"], _COUNTS)
    return _append(spark, df.select(_start(), "event_type", "n", "total"), "watermark")


@query(
    "e2_dedup_batch",
    """SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (
         PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def e2_dedup_batch(spark, sf):
    df = streaming.deduplicate_event_time(table(spark, sf, "events"), ["user_id", "event_type"], "ts")
    return df.select("user_id", "event_type", "event_id")


@query("e2_dedup_stream", "SELECT event_id, user_id, event_type FROM events")
def e2_dedup_stream(spark, sf):
    """Every event arrives twice and is kept once."""
    twice = event_stream(spark, sf).union(event_stream(spark, sf))
    df = streaming.deduplicate_event_time(twice, ["event_id"], "ts", "1 day")
    return _append(spark, df.select("event_id", "user_id", "event_type"), "dedup")


@query(
    "e3_tumbling_stream",
    """SELECT strftime(time_bucket(INTERVAL '2 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
              count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""",
)
def e3_tumbling_stream(spark, sf):
    """Append mode: a window comes out when the watermark has passed it, the last ones after a closing row."""

    def build(events):
        df = ops.aggregate(streaming.watermark(events, "ts", "1 hour"), ["window(ts, '2 hours')"], _COUNTS)
        return df.select(_start(), "n", "total")

    return _closed(spark, sf, "tumbling", build)


@query(
    "e3_sliding_stream",
    """SELECT strftime(time_bucket(INTERVAL '1 day', ts) + to_hours(12 * i), '%Y-%m-%d %H:%M:%S') AS window_start,
              count(*) AS n, round(sum(value), 2) AS total
       FROM events, range(-1, 2) s(i)
       WHERE ts >= time_bucket(INTERVAL '1 day', ts) + to_hours(12 * i)
         AND ts < time_bucket(INTERVAL '1 day', ts) + to_hours(12 * i) + INTERVAL '1 day'
       GROUP BY 1""",
)
def e3_sliding_stream(spark, sf):
    """Update mode: a micro-batch gives the windows it changed, which replace those before."""
    home = scratch(spark, "sliding")
    df = ops.aggregate(streaming.watermark(event_stream(spark, sf), "ts", "1 hour"), ["window(ts, '1 day', '12 hours')"], _COUNTS)
    return streaming.drain_updates(df.select(_start(), "n", "total"), ["window_start"], f"{home}/rows", f"{home}/checkpoint", buckets=4)


@query(
    "e3_session_stream",
    """WITH marked AS (
         SELECT user_id, ts, event_id,
                CASE WHEN ts <= lag(ts) OVER w + INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       numbered AS (
         SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM marked)
       SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM numbered GROUP BY user_id, s""",
)
def e3_session_stream(spark, sf):
    def build(events):
        df = ops.aggregate(
            streaming.watermark(events, "ts", "1 hour"),
            ["user_id", "session_window(ts, '1 hour')"],
            [{"expression": "count(*)", "alias": "n"}],
        )
        return df.select("user_id", F.unix_micros("session_window.start").alias("started"), "n")

    return _closed(spark, sf, "session", build)


def _customers(spark, sf):
    """All customers, every third under a number that no event has."""
    return table(spark, sf, "customer").selectExpr("if(c_custkey % 3 = 0, -c_custkey, c_custkey) AS c_custkey", "c_mktsegment")


_CUSTOMERS = "(SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, c_mktsegment FROM customer)"


def _register_static(how, sql_how):
    columns = "event_id, user_id" if how in ("left_semi", "left_anti") else "event_id, user_id, c_mktsegment"

    def run(spark, sf):
        events = event_stream(spark, sf).select("event_id", "user_id")
        df = ops.join(events, _customers(spark, sf), "left.user_id = right.c_custkey", how)
        return _append(spark, df.selectExpr(*columns.split(", ")), f"static-{how}")

    query(
        f"e4_stream_static_{how}",
        f"SELECT {columns} FROM events {sql_how} JOIN {_CUSTOMERS} ON user_id = c_custkey",
    )(run)


_register_static("inner", "INNER")
_register_static("left", "LEFT")
_register_static("left_semi", "SEMI")
_register_static("left_anti", "ANTI")


def _sides(events):
    events = streaming.watermark(events, "ts", "1 hour")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return buys, clicks


_NEAR = "left.user_id = right.user_id AND right.ts BETWEEN left.ts - INTERVAL '1 hour' AND left.ts"
_CLICKED = """SELECT b.event_id AS purchase, c.event_id AS click
       FROM (SELECT * FROM events WHERE event_type = 'purchase') b {how} JOIN (SELECT * FROM events WHERE event_type = 'click') c
       ON b.user_id = c.user_id AND c.ts BETWEEN b.ts - INTERVAL '1 hour' AND b.ts"""


@query("e4_stream_stream_inner", _CLICKED.format(how=""))
def e4_stream_stream_inner(spark, sf):
    """Purchases with the user's clicks in the hour before."""
    df = ops.join(*_sides(event_stream(spark, sf)), _NEAR, "inner")
    return _append(spark, df.selectExpr("event_id AS purchase", "right_event_id AS click"), "stream-stream")


@query("e4_stream_stream_left", _CLICKED.format(how="LEFT"))
def e4_stream_stream_left(spark, sf):
    """As above, with purchases without clicks; the last of them once closing rows have moved both watermarks."""

    def build(events):
        return ops.join(*_sides(events), _NEAR, "left").selectExpr("event_id AS purchase", "right_event_id AS click")

    return _closed(spark, sf, "stream-left", build, [{"event_type": "purchase"}, {"event_type": "click"}])
