"""Q1-Q9: data-quality checks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeops import quality, streaming
from pipeops.session import scratch

from .registry import query, table
from .streaming_queries import event_stream

# Customers with gaps: debtors have no segment, and the poorest an empty name.
_GAPS = """(SELECT c_custkey, c_nationkey, c_acctbal,
              CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment,
              CASE WHEN c_acctbal < -900 THEN '' ELSE c_name END AS label FROM customer)"""


def _gaps(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        "CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment",
        "CASE WHEN c_acctbal < -900 THEN '' ELSE c_name END AS label",
    )


def _row(check_id, kind, bad, expected, source=_GAPS, actual=None, failing=None, failed=None):
    """Oracle text for one check row; ``bad`` is the predicate of a failing row."""
    failed = failed or f"count(*) FILTER (WHERE {bad})"
    return f"""SELECT '{check_id}' AS check_id, '{kind}' AS type,
                 CASE WHEN {failing or f'{failed} > 0'} THEN 'failed' ELSE 'passed' END AS status,
                 count(*) AS checked, CAST({failed} AS BIGINT) AS failed,
                 CAST({actual or failed} AS DOUBLE) AS actual, '{expected}' AS expected FROM {source}"""


_RULES = [
    {"id": "segment", "type": "column_rule", "config": {"column": "segment", "condition": "not_null"}},
    {"id": "label", "type": "column_rule", "config": {"column": "label", "condition": "non_empty"}},
    {"id": "nation", "type": "column_rule", "config": {"condition": "c_nationkey BETWEEN 0 AND 24"}},
    {"id": "balance", "type": "column_rule", "config": {"column": "c_acctbal", "condition": "non_empty"}},
]
_RULES_SQL = " UNION ALL ".join(
    [
        _row("segment", "column_rule", "segment IS NULL", "not_null"),
        _row("label", "column_rule", "label IS NULL OR label = ''", "non_empty"),
        _row("nation", "column_rule", "c_nationkey NOT BETWEEN 0 AND 24", "c_nationkey BETWEEN 0 AND 24"),
        _row("balance", "column_rule", "c_acctbal IS NULL", "non_empty"),
    ]
)


@query("q1_column_rule", _RULES_SQL)
def q1_column_rule(spark, sf):
    return quality.check_columns(_gaps(spark, sf), _RULES)


@query("q1_column_rule_drop", f"SELECT c_custkey, segment FROM {_GAPS} WHERE segment <> 'BUILDING'")
def q1_column_rule_drop(spark, sf):
    """A null segment makes the rule null, which counts as broken."""
    kept = quality.apply_column_rule(_gaps(spark, sf), "segment <> 'BUILDING'", action="drop")
    return kept.select("c_custkey", "segment")


@query("q1_column_rule_fail", "SELECT c_custkey FROM customer")
def q1_column_rule_fail(spark, sf):
    """The rule holds, so the query runs through; the tests cover a broken one."""
    return quality.apply_column_rule(_gaps(spark, sf), "c_custkey >= 0", action="fail").select("c_custkey")


@query("q1_column_rule_stream", "SELECT event_id FROM events WHERE value >= 10")
def q1_column_rule_stream(spark, sf):
    home = scratch(spark, "rule")
    kept = quality.apply_column_rule(event_stream(spark, sf), "value >= 10", action="drop").select("event_id")
    return streaming.drain(kept, f"{home}/rows", f"{home}/checkpoint")


_RATES = [
    {"id": "strict", "type": "null_rate", "config": {"column": "segment", "maxRate": 0.01}},
    {"id": "loose", "type": "null_rate", "config": {"column": "segment", "maxRate": 0.9}},
]


def _rate(check_id, limit):
    rate = "count(*) FILTER (WHERE segment IS NULL) / count(*)"
    return _row(check_id, "null_rate", "segment IS NULL", f"<= {limit}", actual=rate, failing=f"{rate} > {limit}")


@query("q2_null_rate", f"{_rate('strict', 0.01)} UNION ALL {_rate('loose', 0.9)}")
def q2_null_rate(spark, sf):
    return quality.check_columns(_gaps(spark, sf), _RATES)


def _unique(check_id, columns, source):
    grouped = f"(SELECT count(*) AS n FROM {source} GROUP BY {columns})"
    bad = "count(*) FILTER (WHERE n > 1)"
    return f"""SELECT '{check_id}' AS check_id, 'uniqueness' AS type,
                 CASE WHEN {bad} > 0 THEN 'failed' ELSE 'passed' END AS status,
                 CAST(sum(n) AS BIGINT) AS checked, {bad} AS failed, CAST({bad} AS DOUBLE) AS actual,
                 '{columns}' AS expected FROM {grouped}"""


@query(
    "q3_uniqueness",
    f"{_unique('order', 'o_orderkey', 'orders')} UNION ALL {_unique('line', 'l_orderkey,l_linenumber', 'lineitem')}",
)
def q3_uniqueness(spark, sf):
    orders = quality.uniqueness(table(spark, sf, "orders"), "order", ["o_orderkey"])
    lines = quality.uniqueness(table(spark, sf, "lineitem"), "line", ["l_orderkey", "l_linenumber"])
    return orders.unionByName(lines)


@query(
    "q3_uniqueness_duplicates",
    f"SELECT segment, label, count(*) AS copies FROM {_GAPS} GROUP BY segment, label HAVING count(*) > 1",
)
def q3_uniqueness_duplicates(spark, sf):
    """Nulls are equal to each other."""
    return quality.uniqueness_duplicates(_gaps(spark, sf), ["segment", "label"])


def _contract(check_id, status, failed, actual, expected, source):
    return f"""SELECT '{check_id}' AS check_id, 'schema_contract' AS type, '{status}' AS status,
                 count(*) AS checked, CAST({failed} AS BIGINT) AS failed,
                 CAST({actual} AS DOUBLE) AS actual, '{expected}' AS expected FROM {source}"""


@query(
    "q4_schema_contract",
    _contract("kept", "passed", 0, 2, "r_name,r_regionkey", "region")
    + " UNION ALL "
    + _contract("broken", "failed", 2, 3, "n_nationkey,n_regionkey,n_title", "nation"),
)
def q4_schema_contract(spark, sf):
    kept = quality.schema_contract(
        table(spark, sf, "region"), "kept", [{"name": "r_name"}, {"name": "r_regionkey"}]
    )
    broken = quality.schema_contract(
        table(spark, sf, "nation"),
        "broken",
        [{"name": "n_nationkey"}, {"name": "n_title"}, {"name": "n_regionkey"}],
    )
    return kept.unionByName(broken)


def _range(check_id, expected, outside):
    return _row(
        check_id,
        "row_count_range",
        "false",
        expected,
        source="lineitem",
        actual="count(*)",
        failing=outside,
        failed=f"CASE WHEN {outside} THEN 1 ELSE 0 END",
    )


@query(
    "q5_row_count_range",
    " UNION ALL ".join(
        [
            _range("some", "1..", "count(*) < 1"),
            _range("few", "0..100", "count(*) > 100"),
            _range("many", "1000000000..", "count(*) < 1000000000"),
        ]
    ),
)
def q5_row_count_range(spark, sf):
    return quality.check_columns(
        table(spark, sf, "lineitem"),
        [
            {"id": "some", "type": "row_count_range", "config": {"minimum": 1}},
            {"id": "few", "type": "row_count_range", "config": {"minimum": 0, "maximum": 100}},
            {"id": "many", "type": "row_count_range", "config": {"minimum": 1_000_000_000}},
        ],
    )


def _references(check_id, source, column, reference):
    return f"""SELECT '{check_id}' AS check_id, 'referential_sample' AS type,
                 CASE WHEN count(*) FILTER (WHERE lost) > 0 THEN 'failed' ELSE 'passed' END AS status,
                 count(*) AS checked, count(*) FILTER (WHERE lost) AS failed,
                 CAST(count(*) FILTER (WHERE lost) AS DOUBLE) AS actual, '{column}' AS expected
               FROM (SELECT s.{column} NOT IN (SELECT {column} FROM {reference}) AS lost FROM {source} s)"""


@query(
    "q6_referential",
    _references("documents", "labels", "doc_id", "documents")
    + " UNION ALL "
    + _references("buyers", "(SELECT c_custkey AS k FROM customer)", "k", "(SELECT o_custkey AS k FROM orders)"),
)
def q6_referential(spark, sf):
    labels = quality.referential(table(spark, sf, "labels"), table(spark, sf, "documents"), "documents", ["doc_id"])
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS k")
    buyers = table(spark, sf, "orders").selectExpr("o_custkey AS k")
    return labels.unionByName(quality.referential(customers, buyers, "buyers", ["k"]))


@query(
    "q6_referential_missing",
    """SELECT l_suppkey AS k, count(*) AS copies FROM lineitem
       WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey""",
)
def q6_referential_missing(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_suppkey AS k")
    solvent = table(spark, sf, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey AS k")
    return quality.referential_missing(lines, solvent, ["k"])


def _profile(column, source, numeric):
    numbers = (
        f"CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max, "
        f"round(avg({column}), 9) AS mean, round(stddev_pop({column}), 6) AS stddev"
        if numeric
        else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS stddev"
    )
    return f"""SELECT '{column}' AS "column", count(*) AS count, count(*) - count({column}) AS null_count,
                 count(DISTINCT {column}) AS distinct_count, true AS distinct_exact, {numbers} FROM {source}"""


def _rounded(df):
    return df.withColumns({"mean": F.round("mean", 9), "stddev": F.round("stddev", 6)})


@query(
    "q7_profile_probe",
    f"{_profile('c_acctbal', _GAPS, True)} UNION ALL {_profile('segment', _GAPS, False)}",
)
def q7_profile_probe(spark, sf):
    return _rounded(quality.profile_probe(_gaps(spark, sf), ["segment", "c_acctbal"]))


@query(
    "q8_quarantine_split",
    f"""SELECT CASE WHEN segment IS NOT NULL AND c_acctbal > 100 THEN 'accepted' ELSE 'quarantine' END AS side,
               c_custkey FROM {_GAPS}""",
)
def q8_quarantine_split(spark, sf):
    split = quality.quarantine_split(_gaps(spark, sf), "segment IS NOT NULL AND c_acctbal > 100")
    return split.accepted.select(F.lit("accepted").alias("side"), "c_custkey").unionByName(
        split.quarantine.select(F.lit("quarantine").alias("side"), "c_custkey")
    )


_SUITE = [
    {"id": "status", "type": "column_rule", "table": "orders", "config": {"condition": "o_orderstatus IN ('F', 'O')"}},
    {"id": "price", "type": "null_rate", "table": "orders", "config": {"column": "o_totalprice", "maxRate": 0}},
    {"id": "key", "type": "uniqueness", "table": "orders", "config": {"columns": ["o_orderkey"]}},
    {
        "id": "buyer",
        "type": "referential_sample",
        "table": "buyers",
        "config": {"columns": ["k"], "reference": "customers"},
    },
    {"id": "late", "type": "row_count_range", "table": "orders", "mode": "scheduled", "config": {"minimum": 1}},
]


def _suite(spark, sf, mode):
    orders = table(spark, sf, "orders")
    tables = {
        "orders": orders,
        "buyers": orders.selectExpr("o_custkey AS k"),
        "customers": table(spark, sf, "customer").selectExpr("c_custkey AS k"),
    }
    return quality.run_suite(tables, _SUITE, mode)


_SUITE_SQL = " UNION ALL ".join(
    [
        _row("status", "column_rule", "o_orderstatus NOT IN ('F', 'O')", "o_orderstatus IN (''F'', ''O'')", "orders"),
        _row("price", "null_rate", "o_totalprice IS NULL", "<= 0.0", "orders"),
        _unique("key", "o_orderkey", "orders"),
        _references("buyer", "(SELECT o_custkey AS k FROM orders)", "k", "(SELECT c_custkey AS k FROM customer)"),
    ]
)


@query("q9_suite", _SUITE_SQL)
def q9_suite(spark, sf):
    """The scheduled check does not run in preview mode."""
    return _suite(spark, sf, "preview")


@query("q9_suite_status", f"SELECT CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' ELSE 'passed' END AS status, count(*) AS checks, count(*) FILTER (WHERE status = 'failed') AS failed FROM ({_SUITE_SQL})")
def q9_suite_status(spark, sf):
    return quality.suite_status(_suite(spark, sf, "preview"))
