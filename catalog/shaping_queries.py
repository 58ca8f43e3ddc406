"""Filters, projections and column shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeops import operators as ops

from .registry import query, table


@query(
    "p1_filter",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount BETWEEN 0.03 AND 0.06",
)
def p1_filter(spark, sf):
    kept = ops.filter_rows(
        table(spark, sf, "lineitem"), "l_returnflag = 'R' AND l_discount BETWEEN 0.03 AND 0.06"
    )
    return kept.select("l_orderkey", "l_linenumber")


@query(
    "p2_select",
    "SELECT c_custkey, upper(c_mktsegment) AS segment, c_acctbal < 0 AS in_debt FROM customer",
)
def p2_select(spark, sf):
    return ops.select(
        table(spark, sf, "customer"),
        ["c_custkey", "upper(c_mktsegment) AS segment", {"expression": "c_acctbal < 0", "alias": "in_debt"}],
    )


@query("p2_select_star", "SELECT *, p_size * 2 AS twice FROM part")
def p2_select_star(spark, sf):
    return ops.select(table(spark, sf, "part"), ["*", "p_size * 2 AS twice"])


@query(
    "p3_derive",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
              CAST(floor(l_quantity / 10) AS BIGINT) AS l_quantity FROM lineitem""",
)
def p3_derive(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"
    )
    df = ops.derive(df, "net", "round(l_extendedprice * (1 - l_discount), 4)")
    df = ops.derive(df, "l_quantity", "CAST(floor(l_quantity / 10) AS BIGINT)")
    return ops.drop(df, ["l_extendedprice", "l_discount"])


@query("p4_sql_project", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders")
def p4_sql_project(spark, sf):
    return ops.sql_project(table(spark, sf, "orders"), "o_orderkey, o_totalprice / 2 AS half")


@query(
    "p4_sql_project_statement",
    "SELECT o_orderstatus, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus",
)
def p4_sql_project_statement(spark, sf):
    return ops.sql_project(
        table(spark, sf, "orders"),
        "SELECT o_orderstatus, max(o_totalprice) AS top FROM {input} GROUP BY o_orderstatus",
    )


@query(
    "p5_block",
    "SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 9) AS mean_balance FROM supplier GROUP BY s_nationkey",
)
def p5_block(spark, sf):
    def block(df):
        return df.groupBy("s_nationkey").agg(
            F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 9).alias("mean_balance")
        )

    return ops.custom(table(spark, sf, "supplier"), block)


@query(
    "p6_custom_code",
    """SELECT p_brand, p_type, CASE WHEN p_size BETWEEN 1 AND 15 THEN 'small'
              WHEN p_size BETWEEN 16 AND 35 THEN 'medium' ELSE 'large' END AS size_class
       FROM part WHERE p_name LIKE '%widget' OR p_type IN ('ECONOMY', 'PROMO')""",
)
def p6_custom_code(spark, sf):
    """Column methods of the custom-code vocabulary."""
    size = F.col("p_size")
    return ops.custom(
        table(spark, sf, "part"),
        lambda df: df.where(F.col("p_name").endswith("widget") | F.col("p_type").isin("ECONOMY", "PROMO")).select(
            "p_brand",
            "p_type",
            F.when(size.between(1, 15), "small")
            .when(size.between(16, 35), "medium")
            .otherwise("large")
            .alias("size_class"),
        ),
    )


@query("p7_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def p7_drop(spark, sf):
    return ops.drop(table(spark, sf, "customer"), ["c_name", "c_mktsegment", "no_such_column"])


@query("p8_rename", "SELECT s_suppkey AS s_nationkey, s_nationkey AS s_suppkey, s_name AS supplier FROM supplier")
def p8_rename(spark, sf):
    """A swap of two names and a plain rename."""
    df = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    return ops.rename(df, {"s_suppkey": "s_nationkey", "s_nationkey": "s_suppkey", "s_name": "supplier"})


@query("p9_cast", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS o_totalprice FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def p9_cast(spark, sf):
    return ops.cast(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "bigint")


@query("p9_cast_try", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 2) AS INT) AS code, TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS level FROM orders")
def p9_cast_try(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "substr(o_orderpriority, 1, 2) AS code", "substr(o_orderpriority, 1, 1) AS level"
    )
    return ops.cast(ops.cast(df, "code", "int", mode="try"), "level", "int")


@query("p10_reorder", "SELECT n_name, n_nationkey FROM nation")
def p10_reorder(spark, sf):
    return ops.reorder(table(spark, sf, "nation"), ["n_name", "n_nationkey"])


# A copy of the customers in which debtors have no balance and some segments are missing.
_GAPS = """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
                  CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment FROM customer"""


def _gaps(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance",
        "CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment",
    )


@query(
    "p11_fill_nulls",
    f"SELECT c_custkey, coalesce(balance, 0) AS balance, coalesce(segment, 'NONE') AS segment FROM ({_GAPS})",
)
def p11_fill_nulls(spark, sf):
    return ops.fill_nulls(_gaps(spark, sf), {"balance": 0, "segment": "NONE"})


@query("p12_drop_nulls_any", f"SELECT * FROM ({_GAPS}) WHERE balance IS NOT NULL AND segment IS NOT NULL")
def p12_drop_nulls_any(spark, sf):
    return ops.drop_nulls(_gaps(spark, sf))


@query("p12_drop_nulls_all", f"SELECT * FROM ({_GAPS}) WHERE balance IS NOT NULL OR segment IS NOT NULL")
def p12_drop_nulls_all(spark, sf):
    return ops.drop_nulls(_gaps(spark, sf), "all", ["balance", "segment"])


@query(
    "p13_replace",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus
       FROM orders""",
)
def p13_replace(spark, sf):
    """F goes to O and O goes on to P."""
    return ops.replace(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "O", "O": "P"}
    )


@query(
    "p13_replace_simultaneous",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus
       FROM orders""",
)
def p13_replace_simultaneous(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ops.replace(orders, "o_orderstatus", {"F": "O", "O": "P"}, chained=False)


@query(
    "p14_flatten_struct",
    "SELECT s_suppkey, s_name, s_nationkey, s_name AS place_s_name, s_acctbal AS balance FROM supplier",
)
def p14_flatten_struct(spark, sf):
    df = table(spark, sf, "supplier").selectExpr(
        "s_suppkey",
        "s_name",
        "s_nationkey",
        "named_struct('s_name', s_name, 'balance', s_acctbal) AS place",
    )
    return ops.flatten_struct(df, "place")


@query("p15_build_struct", "SELECT c_custkey, c_acctbal * 2 AS doubled, c_name AS label FROM customer")
def p15_build_struct(spark, sf):
    df = ops.build_struct(
        table(spark, sf, "customer"), "info", {"label": "c_name", "doubled": "c_acctbal * 2"}
    )
    return df.select("c_custkey", "info.doubled", "info.label")


@query(
    "p16_build_map",
    """SELECT p_partkey, p_brand AS brand, p_type AS kind, CAST(2 AS BIGINT) AS entries FROM part""",
)
def p16_build_map(spark, sf):
    df = ops.build_map(table(spark, sf, "part"), "tags", ["'brand'", "'kind'"], ["p_brand", "p_type"])
    return df.selectExpr(
        "p_partkey", "tags['brand'] AS brand", "tags['kind'] AS kind", "CAST(size(tags) AS BIGINT) AS entries"
    )


@query(
    "p17_build_array",
    "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS most, l_tax AS second FROM lineitem",
)
def p17_build_array(spark, sf):
    df = ops.build_array(table(spark, sf, "lineitem"), "rates", ["l_discount", "l_tax"])
    return df.selectExpr("l_orderkey", "l_linenumber", "array_max(rates) AS most", "rates[1] AS second")


_CLIPPED = "CASE WHEN event_type = 'error' THEN substr(props, 1, 4) ELSE props END"


@query(
    "p18_json_parse",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '[0-9]+') AS INT) END AS k FROM events",
)
def p18_json_parse(spark, sf):
    """Error events carry clipped JSON, which parses to null."""
    df = table(spark, sf, "events").selectExpr("event_id", f"{_CLIPPED} AS body")
    return ops.json_parse(df, "body", "k INT", "parsed").select("event_id", "parsed.k")


@query(
    "p18_json_parse_corrupt",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '[0-9]+') AS INT) END AS k,
              CASE WHEN event_type = 'error' THEN substr(props, 1, 4) END AS broken FROM events""",
)
def p18_json_parse_corrupt(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", f"{_CLIPPED} AS body")
    return ops.json_parse(df, "body", "k INT", "parsed", corrupt="broken").select(
        "event_id", "parsed.k", "broken"
    )


@query("p19_explode_array", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def p19_explode_array(spark, sf):
    df = ops.explode(table(spark, sf, "embeddings"), "embedding", "x")
    return df.selectExpr("vec_id", "CAST(x AS DOUBLE) AS x")


@query(
    "p19_explode_map",
    """SELECT o_orderkey, 'status' AS attr_key, o_orderstatus AS attr_value FROM orders
       UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders""",
)
def p19_explode_map(spark, sf):
    orders = table(spark, sf, "orders")
    df = ops.build_map(orders, "attrs", ["'status'", "'priority'"], ["o_orderstatus", "o_orderpriority"])
    return ops.explode(df, "attrs", "attr").select("o_orderkey", "attr_key", "attr_value")


@query(
    "p19_explode_outer",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE part END AS part
       FROM (SELECT c_custkey, c_acctbal, unnest(CASE WHEN c_acctbal < 0 THEN [''] ELSE string_split(c_name, '#') END) AS part
             FROM customer)""",
)
def p19_explode_outer(spark, sf):
    """Debtors have no list and keep one row."""
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_acctbal >= 0 THEN split(c_name, '#') END AS parts"
    )
    return ops.explode(df, "parts", "part", outer=True).select("c_custkey", "part")


@query(
    "p20_posexplode",
    """SELECT vec_id, CAST(i AS BIGINT) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x
       FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def p20_posexplode(spark, sf):
    df = ops.posexplode(table(spark, sf, "embeddings"), "embedding", "x")
    return df.selectExpr("vec_id", "CAST(pos AS BIGINT) AS pos", "CAST(x AS DOUBLE) AS x")


@query(
    "p20_posexplode_map",
    """SELECT s_suppkey, 0 AS slot, 'name' AS item_key, s_name AS item_value FROM supplier
       UNION ALL SELECT s_suppkey, 1, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier""",
)
def p20_posexplode_map(spark, sf):
    df = ops.build_map(
        table(spark, sf, "supplier"), "m", ["'name'", "'nation'"], ["s_name", "CAST(s_nationkey AS STRING)"]
    )
    return ops.posexplode(df, "m", "item", "slot").select("s_suppkey", "slot", "item_key", "item_value")
