"""The plainest PySpark form of queries that the operators write differently, to time
against them (``BENCH_PLAIN=1 python bench.py``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import table

_BY_CUSTOMER = "PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey"


def _full_join(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("if(c_custkey % 3 = 0, -c_custkey, c_custkey) AS c_custkey", "c_mktsegment")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "full")


def _intersect(spark, sf):
    sold = table(spark, sf, "lineitem").where("l_quantity > 45").selectExpr("l_partkey AS k")
    return sold.intersect(table(spark, sf, "part").where("p_size < 20").selectExpr("p_partkey AS k"))


def _whole_partition(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey) AS share"
    )


def _row_number(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS w"
    )


def _ranks(spark, sf):
    over = "OVER (PARTITION BY l_returnflag ORDER BY l_shipdate)"
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", f"rank() {over} AS r", f"dense_rank() {over} AS d"
    )


def _sessions(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy("user_id", F.session_window("ts", "2 hours").alias("s"))
        .agg(F.count("*").alias("events"), F.sum("value").alias("total"))
        .select("user_id", "s.start", "s.end", "events", "total")
    )


def _latest(spark, sf):
    ranked = table(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderkey", "o_totalprice", f"row_number() OVER ({_BY_CUSTOMER}) AS rn"
    )
    return ranked.where("rn = 1").drop("rn")


def _rules(spark, sf):
    """One pass over the table per rule."""
    df = table(spark, sf, "customer").selectExpr(
        "*",
        "CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment",
        "CASE WHEN c_acctbal < -900 THEN '' ELSE c_name END AS label",
    )
    rules = ("segment IS NULL", "label IS NULL OR label = ''", "c_nationkey NOT BETWEEN 0 AND 24", "c_acctbal IS NULL")
    return reduce(DataFrame.unionAll, [df.agg(F.count("*"), F.count_if(F.expr(r))) for r in rules])


def _references(spark, sf):
    """Every row meets the reference keys."""
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id")
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    lost = labels.join(documents, "doc_id", "left_anti").agg(F.count("*").alias("n"))
    idle = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return lost.unionAll(idle.agg(F.count("*")))


PLAIN = {
    "j4_full_join": _full_join,
    "u2_intersect": _intersect,
    "w1_window_whole_partition": _whole_partition,
    "w1_split_window_row_number": _row_number,
    "w1_split_window_ranks": _ranks,
    "a4_session_aggregate": _sessions,
    "g2_drop_duplicates_ordered": _latest,
    "q1_column_rule": _rules,
    "q6_referential": _references,
}
