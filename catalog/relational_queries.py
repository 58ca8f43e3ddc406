"""J, A, W, G, U, O and R: joins, aggregates, windows, sets, order and partitioning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pipeops import operators as ops
from pipeops.session import scratch

from .registry import query, table

# Joins of whole tables. Every third customer stands under a number that no order has, so that
# both sides have rows without a partner.


def _customers(spark, sf):
    return table(spark, sf, "customer").selectExpr("if(c_custkey % 3 = 0, -c_custkey, c_custkey) AS c_custkey", "c_mktsegment")


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey")


_CUSTOMERS = "(SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, c_mktsegment FROM customer) l"
_ORDERS = "(SELECT o_orderkey, o_custkey FROM orders) r"
_ON = "left.c_custkey = right.o_custkey"


def _register_join(name, how, sql_how):
    columns = "l.*" if how in ("left_semi", "left_anti") else "*"
    query(name, f"SELECT {columns} FROM {_CUSTOMERS} {sql_how} JOIN {_ORDERS} ON c_custkey = o_custkey")(
        lambda spark, sf: ops.join(_customers(spark, sf), _orders(spark, sf), _ON, how)
    )


_register_join("j1_inner_join", "inner", "INNER")
_register_join("j2_left_join", "left", "LEFT")
_register_join("j3_right_join", "right", "RIGHT")
_register_join("j4_full_join", "full", "FULL")
_register_join("j5_semi_join", "left_semi", "SEMI")
_register_join("j6_anti_join", "left_anti", "ANTI")


@query("j4_full_join_single", f"SELECT * FROM {_CUSTOMERS} FULL JOIN {_ORDERS} ON c_custkey = o_custkey")
def j4_full_join_single(spark, sf):
    return ops.join(_customers(spark, sf), _orders(spark, sf), _ON, "full", split_full=False)


@query("j7_cross_join", "SELECT c_custkey, r_name FROM customer CROSS JOIN region")
def j7_cross_join(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey")
    return ops.join(customers, table(spark, sf, "region").select("r_name"), how="cross")


@query(
    "j8_join_names",
    """SELECT a.o_orderkey AS key, a.o_totalprice AS price, l.l_orderkey AS right_key, l.l_extendedprice AS right_price
       FROM orders a JOIN lineitem l ON a.o_orderkey = l.l_orderkey AND l.l_extendedprice > a.o_totalprice / 2""",
)
def j8_join_names(spark, sf):
    """Clashing names, and an equality with a further comparison."""
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS key", "o_totalprice AS price")
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS key", "l_extendedprice AS price")
    return ops.join(orders, lines, "left.key = right.key AND right.price > left.price / 2")


@query(
    "j1_retail_flow",
    """SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment""",
)
def j1_retail_flow(spark, sf):
    """Read, filter, join, aggregate, sort: the smallest whole flow."""
    finished = ops.filter_rows(table(spark, sf, "orders"), "o_orderstatus = 'F'")
    joined = ops.join(finished, table(spark, sf, "customer"), "left.o_custkey = right.c_custkey")
    totals = ops.aggregate(
        joined,
        ["c_mktsegment"],
        [
            {"expression": "count(*)", "alias": "orders"},
            {"expression": "round(sum(o_totalprice), 2)", "alias": "revenue"},
        ],
    )
    return ops.sort(totals, ["revenue DESC", "c_mktsegment"])


# Aggregates.


@query(
    "a1_aggregate",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
              round(sum(l_extendedprice), 2) AS sum_base_price,
              round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
              round(avg(l_quantity), 9) AS avg_qty, round(avg(l_discount), 9) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def a1_aggregate(spark, sf):
    shipped = ops.filter_rows(table(spark, sf, "lineitem"), "l_shipdate <= DATE '1998-09-02'")
    return ops.aggregate(
        shipped,
        ["l_returnflag", "l_linestatus"],
        [
            {"expression": "sum(l_quantity)", "alias": "sum_qty"},
            {"expression": "round(sum(l_extendedprice), 2)", "alias": "sum_base_price"},
            {"expression": "round(sum(l_extendedprice * (1 - l_discount)), 4)", "alias": "sum_disc_price"},
            {"expression": "round(avg(l_quantity), 9)", "alias": "avg_qty"},
            {"expression": "round(avg(l_discount), 9)", "alias": "avg_disc"},
            {"expression": "count(*)", "alias": "count_order"},
        ],
    )


@query(
    "a1_aggregate_expression_key",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, count(*) AS row_count
       FROM orders GROUP BY year(o_orderdate)""",
)
def a1_aggregate_expression_key(spark, sf):
    key = {"expression": "CAST(year(o_orderdate) AS BIGINT)", "alias": "order_year"}
    return ops.aggregate(table(spark, sf, "orders"), [key])


@query(
    "a2_global_aggregate",
    "SELECT count(*) AS rows, min(l_shipdate) = max(l_shipdate) AS one_day, max(l_extendedprice) AS top FROM lineitem",
)
def a2_global_aggregate(spark, sf):
    return ops.aggregate(
        table(spark, sf, "lineitem"),
        [],
        [
            {"expression": "count(*)", "alias": "rows"},
            {"expression": "min(l_shipdate) = max(l_shipdate)", "alias": "one_day"},
            {"expression": "max(l_extendedprice)", "alias": "top"},
        ],
    )


@query(
    "a3_aggregate_forms",
    """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers,
              count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
              arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest,
              len(list_distinct(list(o_orderstatus))) AS states,
              round(stddev_pop(o_totalprice), 4) AS spread
       FROM orders GROUP BY o_orderpriority""",
)
def a3_aggregate_forms(spark, sf):
    return ops.aggregate(
        table(spark, sf, "orders"),
        ["o_orderpriority"],
        [
            {"expression": "count(DISTINCT o_custkey)", "alias": "customers"},
            {"expression": "count(*) FILTER (WHERE o_orderstatus = 'F')", "alias": "finished"},
            {"expression": "max_by(o_orderkey, struct(o_totalprice, o_orderkey))", "alias": "dearest"},
            {"expression": "CAST(size(collect_set(o_orderstatus)) AS BIGINT)", "alias": "states"},
            {"expression": "round(stddev_pop(o_totalprice), 4)", "alias": "spread"},
        ],
    )


@query("a3_approximate")
def a3_approximate(spark, sf):
    """Sketches; their answers are checked against exact ones with a tolerance in the tests."""
    return ops.aggregate(
        table(spark, sf, "lineitem"),
        ["l_returnflag"],
        [
            {"expression": "approx_count_distinct(l_orderkey)", "alias": "orders"},
            {"expression": "percentile_approx(l_extendedprice, 0.5)", "alias": "median_price"},
        ],
    )


@query(
    "a4_tumbling_window",
    """SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
              count(*) AS n, round(sum(value), 2) AS total
       FROM events GROUP BY time_bucket(INTERVAL '6 hours', ts), event_type""",
)
def a4_tumbling_window(spark, sf):
    df = ops.aggregate(
        table(spark, sf, "events"),
        ["window(ts, '6 hours')", "event_type"],
        [{"expression": "count(*)", "alias": "n"}, {"expression": "round(sum(value), 2)", "alias": "total"}],
    )
    start = F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")
    return df.select(start.alias("window_start"), "event_type", "n", "total")


@query(
    "a4_sliding_window",
    """SELECT strftime(time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * i), '%Y-%m-%d %H:%M:%S') AS window_start,
              count(*) AS n
       FROM events, range(2) s(i) GROUP BY 1""",
)
def a4_sliding_window(spark, sf):
    df = ops.aggregate(
        table(spark, sf, "events"),
        ["window(ts, '12 hours', '6 hours')"],
        [{"expression": "count(*)", "alias": "n"}],
    )
    return df.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


_SESSIONS = """
  WITH marked AS (
    SELECT user_id, ts, value,
           CASE WHEN ts <= lag(ts) OVER w + INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
  SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL '2 hours') AS ended,
         count(*) AS events, round(sum(value), 2) AS total
  FROM numbered GROUP BY user_id, s"""


def _micros(column):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("a4_session_window", _SESSIONS)
def a4_session_window(spark, sf):
    df = ops.aggregate(
        table(spark, sf, "events"),
        ["user_id", "session_window(ts, '2 hours')"],
        [{"expression": "count(*)", "alias": "events"}, {"expression": "round(sum(value), 2)", "alias": "total"}],
    )
    return df.select(
        "user_id",
        _micros("session_window.start").alias("started"),
        _micros("session_window.end").alias("ended"),
        "events",
        "total",
    )


@query("a4_session_aggregate", _SESSIONS)
def a4_session_aggregate(spark, sf):
    """The same sessions, built so that a hot user is spread over tasks."""
    df = ops.session_aggregate(
        table(spark, sf, "events"), ["user_id"], "ts", "2 hours", {"events": "1", "total": "value"}
    )
    return df.select(
        "user_id",
        _micros("session_start").alias("started"),
        _micros("session_end").alias("ended"),
        "events",
        F.round("total", 2).alias("total"),
    )


# Windows: (name, expression, partition, order, frame, SQL).

_BY_CUSTOMER = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_WINDOWS = {
    "row_number": ("row_number()", None, None),
    "rank": ("rank()", ["o_orderstatus"], "PARTITION BY o_custkey ORDER BY o_orderstatus"),
    "dense_rank": ("dense_rank()", ["o_orderstatus"], "PARTITION BY o_custkey ORDER BY o_orderstatus"),
    "percent_rank": ("percent_rank()", None, None),
    "ntile": ("ntile(3)", None, None),
    "lag": ("lag(o_totalprice, 1, 0.0D)", None, None),
    "lead": ("lead(o_totalprice, 2)", None, None),
    "first_value": ("first_value(o_orderkey)", None, None),
    "last_value": ("last_value(o_orderkey)", None, None),
    "nth_value": ("nth_value(o_orderkey, 2)", None, None),
    "running_sum": ("sum(o_totalprice)", None, None),
}


def _register_window(name, expression, order, over):
    over = over or _BY_CUSTOMER
    sql = expression.replace("0.0D", "0.0")
    rounded = name == "running_sum"
    value = f"round({sql} OVER ({over}), 2)" if rounded else f"{sql} OVER ({over})"
    if name in ("row_number", "rank", "dense_rank", "ntile"):
        value = f"CAST({value} AS INT)"

    def run(spark, sf):
        df = ops.window(
            table(spark, sf, "orders"), "w", expression, ["o_custkey"], order or ["o_orderdate", "o_orderkey"]
        )
        return df.select("o_orderkey", (F.round("w", 2) if rounded else F.col("w")).alias("w"))

    query(f"w1_window_{name}", f"SELECT o_orderkey, {value} AS w FROM orders")(run)


for _name, (_expression, _order, _over) in _WINDOWS.items():
    _register_window(_name, _expression, _order, _over)


@query(
    "w1_window_rows_frame",
    f"""SELECT o_orderkey, round(avg(o_totalprice) OVER ({_BY_CUSTOMER.replace('o_orderdate,', 'o_orderdate DESC,')}
              ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS w FROM orders""",
)
def w1_window_rows_frame(spark, sf):
    df = ops.window(
        table(spark, sf, "orders"),
        "w",
        "avg(o_totalprice)",
        ["o_custkey"],
        ["o_orderdate DESC", "o_orderkey"],
        ("rows", -2, 1),
    )
    return df.select("o_orderkey", F.round("w", 4).alias("w"))


@query(
    "w1_window_range_frame",
    """SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size
              RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS w FROM part""",
)
def w1_window_range_frame(spark, sf):
    df = ops.window(
        table(spark, sf, "part"), "w", "count(*)", ["p_brand"], ["p_size"], ("range", -5, "current row")
    )
    return df.select("p_partkey", "w")


@query(
    "w1_window_whole_partition",
    """SELECT l_orderkey, l_linenumber, l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey) AS share
       FROM lineitem""",
)
def w1_window_whole_partition(spark, sf):
    df = ops.window(table(spark, sf, "lineitem"), "total", "sum(l_quantity)", ["l_suppkey"])
    return df.selectExpr("l_orderkey", "l_linenumber", "l_quantity / total AS share")


@query(
    "w1_window_whole_table",
    "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (), 9) AS off FROM customer",
)
def w1_window_whole_table(spark, sf):
    df = ops.window(table(spark, sf, "customer"), "mean_balance", "avg(c_acctbal)")
    return df.selectExpr("c_custkey", "round(c_acctbal - mean_balance, 9) AS off")


# Split windows run over partitions of any size; here over whole tables or few large groups.

_GLOBAL = "ORDER BY o_totalprice DESC, o_orderkey"
_SPLIT = {
    "row_number": ("row_number()", None, None),
    "percent_rank": ("percent_rank()", None, None),
    "cume_dist": ("cume_dist()", None, None),
    "ntile": ("ntile(7)", None, 7),
    "lag": ("lag(o_custkey)", "o_custkey", None),
    "lead": ("lead(o_custkey)", "o_custkey", None),
    "count": ("count(o_custkey)", "o_custkey", None),
    "max": ("max(o_custkey)", "o_custkey", None),
    "min": ("min(o_custkey)", "o_custkey", None),
}


def _register_split(function, sql, argument, buckets):
    real = function in ("percent_rank", "cume_dist")
    value = f"{sql} OVER ({_GLOBAL})"
    if function in ("row_number", "ntile"):
        value = f"CAST({value} AS INT)"

    def run(spark, sf):
        df = ops.split_window(
            table(spark, sf, "orders"),
            "w",
            function,
            ["o_totalprice DESC", "o_orderkey"],
            argument,
            splits=16,
            buckets=buckets,
        )
        return df.select("o_orderkey", (F.round("w", 9) if real else F.col("w")).alias("w"))

    query(
        f"w1_split_window_{function}",
        f"SELECT o_orderkey, {f'round({value}, 9)' if real else value} AS w FROM orders",
    )(run)


for _name, (_sql, _argument, _buckets) in _SPLIT.items():
    _register_split(_name, _sql, _argument, _buckets)


@query(
    "w1_split_window_ranks",
    """SELECT l_orderkey, l_linenumber, l_partkey, 
              CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS INT) AS r,
              CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS INT) AS d FROM lineitem""",
)
def w1_split_window_ranks(spark, sf):
    """Three large groups cut by year; ties stay in one chunk."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate"
    )
    return ops.split_windows(
        lines,
        {"r": ("rank", None), "d": ("dense_rank", None)},
        ["l_shipdate"],
        ["l_returnflag"],
        "year(l_shipdate)",
    ).select("l_orderkey", "l_linenumber", "l_partkey", "r", "d")


@query(
    "w1_split_window_sums",
    """SELECT event_id, round(sum(value) OVER w, 2) AS running, round(avg(value) OVER w * count(value) OVER w, 2) AS again
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def w1_split_window_sums(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    df = ops.split_windows(
        df,
        {"running": ("sum", "value"), "mean": ("avg", "value"), "n": ("count", "value")},
        ["ts", "event_id"],
        ["event_type"],
        "date_trunc('day', ts)",
    )
    return df.selectExpr("event_id", "round(running, 2) AS running", "round(mean * n, 2) AS again")


# Frames, values and offsets over whole tables or few large groups, cut by place or by value.

_FRAMES = {
    "rows": ("orders", "o_orderkey", "avg", "o_totalprice", [], ["o_orderdate", "o_orderkey"], (-2, 1), 1),
    "rows_before": ("orders", "o_orderkey", "max", "o_totalprice", ["o_orderstatus"], ["o_orderdate", "o_orderkey"], ("unbounded preceding", -3), 1),
    "rows_after": ("orders", "o_orderkey", "min", "o_totalprice", ["o_orderpriority"], ["o_orderdate DESC", "o_orderkey"], (2, "unbounded following"), 1),
    "first_value": ("orders", "o_orderkey", "first_value", "o_custkey", [], ["o_orderdate", "o_orderkey"], (-700, -600), 1),
    "last_value": ("orders", "o_orderkey", "last_value", "o_custkey", ["o_orderstatus"], ["o_totalprice", "o_orderkey"], ("unbounded preceding", 5), 1),
    "nth_value": ("orders", "o_orderkey", "nth_value", "o_custkey", ["o_orderstatus"], ["o_totalprice", "o_orderkey"], ("unbounded preceding", "current row"), 40),
    "lag": ("orders", "o_orderkey", "lag", "o_custkey", [], ["o_totalprice DESC", "o_orderkey"], None, 25),
    "lead": ("orders", "o_orderkey", "lead", "o_custkey", ["o_orderstatus"], ["o_totalprice DESC", "o_orderkey"], None, 9000),
    "range": ("part", "p_partkey", "count", "p_partkey", ["p_brand"], ["p_size"], (-5, 2), 1),
    "range_before": ("part", "p_partkey", "max", "p_partkey", [], ["p_size"], ("unbounded preceding", 3), 1),
    "range_after": ("part", "p_partkey", "min", "p_partkey", ["p_brand"], ["p_size DESC"], (1, "unbounded following"), 1),
}


def _bound(edge):
    return edge if isinstance(edge, str) else f"{abs(edge)} {'PRECEDING' if edge < 0 else 'FOLLOWING'}"


def _register_frame(name, source, row, function, argument, keys, order, edges, offset):
    kind = "range" if name.startswith("range") else "rows"
    call = f"{function}({argument}{f', {offset}' if function in ('lag', 'lead', 'nth_value') else ''})"
    over = f"{'PARTITION BY ' + ', '.join(keys) if keys else ''} ORDER BY {', '.join(order)}"
    if edges:
        over += f" {kind} BETWEEN {_bound(edges[0])} AND {_bound(edges[1])}"
    value = f"{call} OVER ({over})"
    real = function == "avg"

    def run(spark, sf):
        frame = (kind, *edges) if edges else ("rows", 0, 0)
        df = ops.split_frame(table(spark, sf, source), "w", function, order, argument, keys, frame, offset, splits=16, rows_per_chunk=5_000)
        return df.select(row, (F.round("w", 4) if real else F.col("w")).alias("w"))

    query(f"w1_split_frame_{name}", f"SELECT {row}, {f'round({value}, 4)' if real else value} AS w FROM {source}")(run)


for _name, _spec in _FRAMES.items():
    _register_frame(_name, *_spec)


# Distinct rows.


@query("g1_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def g1_distinct(spark, sf):
    return ops.distinct(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"))


@query("g2_drop_duplicates", "SELECT DISTINCT p_brand, p_type FROM part")
def g2_drop_duplicates(spark, sf):
    return ops.drop_duplicates(table(spark, sf, "part"), ["p_brand", "p_type"]).select("p_brand", "p_type")


@query(
    "g2_drop_duplicates_ordered",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
)
def g2_drop_duplicates_ordered(spark, sf):
    df = ops.drop_duplicates(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate DESC", "o_orderkey"])
    return df.select("o_custkey", "o_orderkey", "o_totalprice")


# Set operations.


@query(
    "u1_union_by_name",
    """SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def u1_union_by_name(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_name AS name", "c_custkey AS k", "c_mktsegment AS segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_name AS name")
    return ops.union_by_name(customers, suppliers, allow_missing_columns=True)


@query("u2_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20")
def u2_intersect(spark, sf):
    sold = table(spark, sf, "lineitem").where("l_quantity > 45").selectExpr("l_partkey AS k")
    return ops.intersect(sold, table(spark, sf, "part").where("p_size < 20").selectExpr("p_partkey AS k"))


@query(
    "u3_except_all",
    """SELECT o_custkey AS k FROM orders WHERE o_orderstatus <> 'P'
       EXCEPT ALL SELECT c_custkey FROM customer WHERE c_acctbal > 0""",
)
def u3_except_all(spark, sf):
    buyers = table(spark, sf, "orders").where("o_orderstatus <> 'P'").selectExpr("o_custkey AS k")
    return ops.except_(buyers, table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS k"))


@query(
    "u3_except_distinct",
    "SELECT l_suppkey AS k FROM lineitem EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000",
)
def u3_except_distinct(spark, sf):
    used = table(spark, sf, "lineitem").selectExpr("l_suppkey AS k")
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").selectExpr("s_suppkey AS k")
    return ops.except_(used, rich, all=False)


@query("u4_union", "SELECT c_custkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def u4_union(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS balance")
    return ops.union(customers, table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"))


# Order, limit, partitioning. The oracle compares rows, so the sort shows its order in a column.


_O1 = """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (
              ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem"""


def _prices(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("o1_sort", _O1)
def o1_sort(spark, sf):
    """The sorted rows as they are written: files in order, rows in order in each, counted up to a place."""
    home = scratch(spark, "sorted")
    ops.sort(_prices(spark, sf), ["l_extendedprice DESC NULLS LAST"], spread_ties=["l_orderkey", "l_linenumber", "l_partkey"]).write.parquet(home)
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows = spark.read.parquet(home).select("*", F.regexp_extract(name, "part-([0-9]+)", 1).cast("int").alias("file"), row.alias("row"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file").count().select("file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return rows.join(counts, "file").select(*rows.columns[:4], (F.col("before") + F.col("row") + 1).alias("place"))


@query("o1_places", _O1)
def o1_places(spark, sf):
    """Each row's place without writing the sorted rows: counts of chunks turned into offsets."""
    return ops.places(_prices(spark, sf), ["l_extendedprice DESC NULLS LAST", "l_orderkey", "l_linenumber", "l_partkey"], splits=16)


@query(
    "o2_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def o2_limit(spark, sf):
    """A top-k report."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ops.limit(ops.sort(orders, [("o_totalprice", "desc"), "o_orderkey"]), 100)


@query("r1_repartition", "SELECT o_orderkey, o_custkey FROM orders")
def r1_repartition(spark, sf):
    return ops.repartition(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 16, ["o_custkey"])


@query("r2_coalesce", "SELECT s_suppkey, s_name FROM supplier")
def r2_coalesce(spark, sf):
    spread = ops.repartition(table(spark, sf, "supplier").select("s_suppkey", "s_name"), 8)
    return ops.coalesce(spread, 2)
