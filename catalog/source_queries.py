"""Sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pipeops import operators as ops
from pipeops import outputs, sources
from pipeops.session import scratch

from .registry import query, table


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:8]}"


@query(
    "s1_table",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def s1_table(spark, sf):
    name = _name("orders_table")
    spark.catalog.createTable(name, path=f"{sf}/orders.parquet", source="parquet")
    return sources.read_table(spark, name).where("o_orderstatus = 'F'").select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "s2_file_parquet",
    """SELECT l_returnflag, count(*) AS row_count, round(sum(l_extendedprice), 2) AS price
       FROM lineitem WHERE l_quantity >= 25 GROUP BY l_returnflag""",
)
def s2_file_parquet(spark, sf):
    lines = sources.read_file(spark, f"{sf}/lineitem.parquet", "parquet")
    return ops.aggregate(
        ops.filter_rows(lines, "l_quantity >= 25"),
        ["l_returnflag"],
        [
            {"expression": "count(*)", "alias": "row_count"},
            {"expression": "round(sum(l_extendedprice), 2)", "alias": "price"},
        ],
    )


_ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _round_trip(spark, sf, format, **options):
    path = scratch(spark, f"orders-{format}")
    plain = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    plain.write.format(format).options(**options).save(path)
    return sources.read_file(spark, path, format, options=options, schema=_ORDERS)


@query("s2_file_csv", _ORDERS_SQL)
def s2_file_csv(spark, sf):
    return _round_trip(spark, sf, "csv", header="true")


@query("s2_file_json", _ORDERS_SQL)
def s2_file_json(spark, sf):
    return _round_trip(spark, sf, "json")


@query("s2_file_orc", _ORDERS_SQL)
def s2_file_orc(spark, sf):
    return _round_trip(spark, sf, "orc")


@query("s2_file_text", "SELECT c_name || '|' || c_mktsegment AS value FROM customer")
def s2_file_text(spark, sf):
    path = scratch(spark, "customer-text")
    lines = table(spark, sf, "customer").select(F.concat_ws("|", "c_name", "c_mktsegment").alias("value"))
    lines.write.text(path)
    return sources.read_file(spark, path, "text")


_PAYLOAD_SQL = """
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, props AS payload
  FROM events WHERE event_type <> 'view'"""


@query("s4_kafka_decode", _PAYLOAD_SQL)
def s4_kafka_decode(spark, sf):
    """Kafka's column layout over the event stream: views carry no value."""
    from pipeops.streaming import drain

    schema = table(spark, sf, "events").schema
    stream = sources.read_file(
        spark, sf, "parquet", streaming=True, schema=schema, options={"pathGlobFilter": "events.parquet"}
    )
    kafka = stream.select(
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.when(F.col("event_type") != "view", F.col("props").cast("binary")).alias("value"),
        F.lit("events").alias("topic"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    decoded = sources.decode_kafka(kafka)
    home = scratch(spark, "kafka")
    out = drain(decoded, f"{home}/rows", f"{home}/checkpoint")
    return out.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "payload")


# SQL queries, one per shape.

_SQL_SHAPES = {
    "cte": """
        WITH spend AS (
          SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey)
        SELECT c_mktsegment, count(*) AS customers, round(sum(total), 2) AS total
        FROM spend JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "scalar_subquery": """
        SELECT o_orderkey, o_totalprice FROM {orders}
        WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM {orders})""",
    "correlated_subquery": """
        SELECT p_partkey, p_brand FROM {part} AS p
        WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM {part} AS q WHERE q.p_brand = p.p_brand)""",
    "exists": """
        SELECT c_custkey FROM {customer} AS c WHERE EXISTS (
          SELECT 1 FROM {orders} AS o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
    "not_in": """
        SELECT s_suppkey FROM {supplier} WHERE s_suppkey NOT IN (
          SELECT l_suppkey FROM {lineitem} WHERE l_quantity = 50 AND l_discount = 0.1 AND l_returnflag = 'A' AND l_suppkey IS NOT NULL)""",
    "grouping_sets": """
        SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n
        FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""",
    "rollup": """
        SELECT l_returnflag, l_linestatus, count(*) AS n
        FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "cube": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n
        FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "having": """
        SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey HAVING count(*) > 30""",
    "window": """
        SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place
        FROM {orders}""",
    "set_operations": """
        (SELECT n_regionkey AS k FROM {nation} INTERSECT SELECT r_regionkey FROM {region})
        UNION ALL (SELECT c_nationkey FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier})""",
    "distinct_aggregate": """
        SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers,
               count(*) FILTER (WHERE l_discount > 0.05) AS discounted
        FROM {lineitem} GROUP BY l_returnflag""",
    "star_join": """
        SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey
        GROUP BY r_name, o_orderpriority""",
}

_TABLES = (
    "region nation customer supplier part orders lineitem events documents".split()
)


def _sql(spark, sf, text):
    used = {name: table(spark, sf, name) for name in _TABLES if f"{{{name}}}" in text}
    return sources.sql_query(spark, text, **used)


def _register_shape(shape, text, oracle=None):
    plain = text
    for name in _TABLES:
        plain = plain.replace(f"{{{name}}}", name)
    query(f"s5_sql_{shape}", oracle or plain)(lambda spark, sf: _sql(spark, sf, text))


for _shape, _text in _SQL_SHAPES.items():
    _register_shape(_shape, _text)

_register_shape(
    "pivot",
    """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM {lineitem})
       PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS open_qty, 'F' AS final_qty))""",
    """SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_qty,
              sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS final_qty
       FROM lineitem GROUP BY l_returnflag""",
)
_register_shape(
    "lateral_view",
    """SELECT lang, word, count(*) AS n FROM {documents}
       LATERAL VIEW explode(split(text, ' ')) w AS word GROUP BY lang, word""",
    """SELECT lang, word, count(*) AS n
       FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY lang, word""",
)


@query(
    "s6_dataset_reference",
    "SELECT o_orderpriority, count(*) AS row_count FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
)
def s6_dataset_reference(spark, sf):
    """A downstream dataset reads the stored upstream one."""
    name = _name("open_orders")
    open_orders = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    outputs.materialized_view(open_orders, name, scratch(spark, name))
    return ops.aggregate(sources.dataset_reference(spark, name), ["o_orderpriority"])


@query("s7_generic", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def s7_generic(spark, sf):
    df = sources.read_generic(spark, "parquet", {"path": f"{sf}/supplier.parquet"})
    return df.where("s_acctbal > 0").select("s_suppkey", "s_name")


@query("s7_python_source", "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority FROM orders")
def s7_python_source(spark, sf):
    """A registered Python data source, with a partition per row group."""
    sources.register(spark)
    df = sources.read_generic(spark, "row_groups", {"path": f"{sf}/orders.parquet"})
    return df.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")


@query("s7_python_stream", "SELECT event_id, ts, event_type, value FROM events WHERE value > 10")
def s7_python_stream(spark, sf):
    """The same source as a stream, written through its own sink and read back."""
    sources.register(spark)
    home = scratch(spark, "row-groups")
    events = sources.read_generic(spark, "row_groups", {"path": f"{sf}/events.parquet"}, streaming=True)
    kept = events.where("value > 10").select("event_id", "ts", "event_type", "value")
    running = outputs.external_sink(kept, _name("row_groups"), "row_groups", f"{home}/checkpoint", {"path": f"{home}/out"})
    running.awaitTermination()
    return sources.read_generic(spark, "row_groups", {"path": f"{home}/out"}, schema=kept.schema)


@query(
    "s8_custom_source",
    "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def s8_custom_source(spark, sf):
    def build(session):
        nation, region = table(session, sf, "nation"), table(session, sf, "region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name")

    return sources.custom_source(spark, build)


@query(
    "s9_parameter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000.50 AND o_orderdate >= DATE '1997-01-01'",
)
def s9_parameter(spark, sf):
    floor = sources.parameter(spark, "price_floor", "250000.50", "double")
    since = sources.parameter(spark, "since", "1997-01-01", "date")
    orders = sources.with_constants(table(spark, sf, "orders"), floor, since)
    kept = ops.filter_rows(orders, "o_totalprice >= price_floor AND o_orderdate >= since")
    return kept.select("o_orderkey", "o_totalprice")


@query("s10_constant", "SELECT c_custkey, 'retail' AS channel, CAST(7 AS BIGINT) AS version FROM customer")
def s10_constant(spark, sf):
    channel = sources.constant(spark, "channel", "retail")
    version = sources.constant(spark, "version", 7, "bigint")
    return sources.with_constants(table(spark, sf, "customer").select("c_custkey"), channel, version)
