"""Skewed inputs, split operators against plain ones, and the shape of plans."""

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipeops import observe, outputs, quality
from pipeops import operators as ops
from pipeops.functions import exact_quantiles


def plan(df):
    return outputs.explain_text(df, "formatted")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def skewed(spark, n=4000):
    """One key holds a third of the rows, with runs of equal order values and nulls."""
    return spark.range(n).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS k",
        "CASE WHEN id % 17 = 0 THEN NULL ELSE (id * 7919) % 101 END AS x",
        "CAST((id * 31) % 13 AS DOUBLE) AS v",
    )


FUNCTIONS = {
    "row_number": ("row_number()", None),
    "rank": ("rank()", None),
    "dense_rank": ("dense_rank()", None),
    "percent_rank": ("percent_rank()", None),
    "cume_dist": ("cume_dist()", None),
    "ntile": ("ntile(7)", None),
    "count": ("count(v)", "v"),
    "sum": ("sum(v)", "v"),
    "min": ("min(v)", "v"),
    "max": ("max(v)", "v"),
    "avg": ("avg(v)", "v"),
    "lag": ("lag(v)", "v"),
    "lead": ("lead(v)", "v"),
}
NEED_TOTAL_ORDER = ("row_number", "ntile", "lag", "lead")


@pytest.mark.parametrize("function", FUNCTIONS)
@pytest.mark.parametrize("direction", ["", " DESC"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_split_window_equals_window(spark, function, direction, keys):
    df = skewed(spark)
    expression, argument = FUNCTIONS[function]
    order = [f"x{direction}"] + (["id"] if function in NEED_TOTAL_ORDER else [])
    plain = ops.window(df, "w", expression, keys, order)
    split = ops.split_window(df, "w", function, order, argument, keys, splits=9, buckets=7)

    def key(d):
        return rows(d.selectExpr("id", "round(w, 9) AS w"))

    assert key(split) == key(plain)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(
        st.tuples(st.integers(0, 2), st.integers(-(2**40), 2**40) | st.integers(-3, 3)), min_size=1, max_size=60
    )
)
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame(values, "k int, v long")
    n = F.col("n")
    ranks = {"low": F.floor((n + 1) / 2), "high": F.ceil((n + 1) / 2), "p95": F.ceil(n * 0.95)}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", ranks).collect()}
    for k in {k for k, _ in values}:
        group = sorted(v for g, v in values if g == k)
        assert (got[k]["low"], got[k]["high"]) == (statistics.median_low(group), statistics.median_high(group))
        assert got[k]["p95"] == group[-(-len(group) * 95 // 100) - 1]


def test_latest_per_key_cuts_before_the_shuffle(spark):
    text = plan(ops.latest_per_key(skewed(spark), ["k"], ["x DESC", "id"]))
    assert text.index("WindowGroupLimit") < text.index("Exchange")


def test_top_values_cut_before_the_shuffle(spark):
    df = skewed(spark).withColumn("k", F.col("k").cast("string"))
    assert "WindowGroupLimit" in plan(observe.top_values(df, ["k"]))


def test_row_level_checks_share_one_scan(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    checks = [
        {"id": c, "type": "null_rate", "config": {"column": c, "maxRate": 0}}
        for c in ("l_quantity", "l_tax", "l_discount")
    ]
    text = plan(quality.check_columns(lines, checks))
    assert text.count("Scan parquet") == 2  # once in the tree, once in its details
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double>" in text


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    df = ops.select(
        ops.filter_rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice > 1000"), ["o_orderkey"]
    )
    text = plan(df)
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_row_local_operators_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "token = abc", "== Physical Plan ==\nProject")], "id int, t string, p string")
    for result in (
        observe.redact(df, ["t"]),
        observe.diagnose(df, "t"),
        observe.secret_literals(df, "t", ["id"]),
        __import__("pipeops.plans", fromlist=["x"]).plan_nodes(df, ["id"], "p"),
    ):
        assert "Exchange" not in plan(result).split("(1)")[0]


def test_whole_partition_aggregate_has_no_window(spark):
    df = skewed(spark)
    out = ops.window(df, "total", "sum(v)", ["k"])
    assert "Window" not in plan(out)
    native = df.selectExpr("id", "k", "x", "v", "sum(v) OVER (PARTITION BY k) AS total")
    assert rows(out) == rows(native)


def test_hot_key_reference_check(spark):
    df = skewed(spark)
    known = spark.range(1, 30).selectExpr("id AS k")
    missing = quality.referential(df, known, "ref", ["k"]).first()
    expected = df.where("k = 0 OR k >= 30").count()
    assert (missing["failed"], missing["checked"]) == (expected, 4000)
