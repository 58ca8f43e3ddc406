"""F: the scalar and aggregate functions named in the survey, group by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeops import operators as ops

from .registry import query, table


def _register(name, source, columns, keys, where=None):
    """``columns`` maps an output name to (Spark expression, oracle expression).

    An oracle expression of None means the same text in both.
    """
    spark_exprs = [*keys, *[f"{s} AS {n}" for n, (s, _) in columns.items()]]
    sql_exprs = [*keys, *[f"{o or s} AS {n}" for n, (s, o) in columns.items()]]
    query(name, f"SELECT {', '.join(sql_exprs)} FROM {source}")(
        lambda spark, sf: ops.select(table(spark, sf, source), spark_exprs)
    )


def _int(expression):
    return f"CAST({expression} AS INT)"


_register(
    "f_string",
    "customer",
    {
        "b64": ("base64(CAST(c_name AS BINARY))", "base64(c_name::BLOB)"),
        "back": ("CAST(unbase64(base64(CAST(c_name AS BINARY))) AS STRING)", "c_name"),
        "joined": ("concat(c_name, '/', c_mktsegment)", None),
        "joined_ws": ("concat_ws('-', c_name, c_mktsegment)", None),
        "hash_at": ("instr(c_name, '#')", _int("instr(c_name, '#')")),
        "len": ("length(c_mktsegment)", _int("length(c_mktsegment)")),
        "low": ("lower(c_mktsegment)", None),
        "up": ("upper(c_name)", None),
        "left_pad": ("lpad(c_mktsegment, 12, '*')", None),
        "right_pad": ("rpad(c_mktsegment, 12, '*')", None),
        "left_trim": ("ltrim(concat('  ', c_mktsegment, ' '))", None),
        "right_trim": ("rtrim(concat('  ', c_mktsegment, ' '))", None),
        "both_trim": ("trim(concat('  ', c_mktsegment, ' '))", None),
        "digits": ("regexp_extract(c_name, '([0-9]+)', 1)", None),
        "all_pairs": (
            "array_join(regexp_extract_all(c_name, '([0-9]{2})', 1), ',')",
            "array_to_string(regexp_extract_all(c_name, '([0-9]{2})', 1), ',')",
        ),
        "masked": ("regexp_replace(c_name, '[0-9]', 'N')", "regexp_replace(c_name, '[0-9]', 'N', 'g')"),
        "twice": ("repeat(substring(c_mktsegment, 1, 3), 2)", None),
        "swapped": ("replace(c_name, 'Customer', 'Client')", None),
        "second": ("split(c_name, '#')[1]", "string_split(c_name, '#')[2]"),
        "part": ("substring(c_name, 3, 4)", None),
        "before": ("substring_index(c_name, '#', 1)", "split_part(c_name, '#', 1)"),
        "mapped": ("translate(c_mktsegment, 'AEIOU', 'aeiou')", None),
    },
    ["c_custkey"],
)

_DATE = "CAST(o_orderdate AS DATE)"


def _day(expression):
    return f"date_format({expression}, 'yyyy-MM-dd')"


def _day_sql(expression):
    return f"strftime({expression}, '%Y-%m-%d')"


_register(
    "f_date",
    "orders",
    {
        "past": ("to_date(o_orderdate) < current_date()", f"{_DATE} < current_date"),
        "past_ts": ("CAST(o_orderdate AS TIMESTAMP) < current_timestamp()", f"{_DATE} < current_date"),
        "later": (_day("date_add(o_orderdate, 10)"), _day_sql(f"{_DATE} + 10")),
        "earlier": (_day("date_sub(o_orderdate, 40)"), _day_sql(f"{_DATE} - 40")),
        "shown": ("date_format(o_orderdate, 'dd.MM.yyyy')", "strftime(o_orderdate, '%d.%m.%Y')"),
        "age": ("datediff(DATE '2010-01-01', o_orderdate)", _int(f"DATE '2010-01-01' - {_DATE}")),
        "day_month": ("dayofmonth(o_orderdate)", _int("day(o_orderdate)")),
        "day_week": ("dayofweek(o_orderdate)", _int("dayofweek(o_orderdate) + 1")),
        "day_year": ("dayofyear(o_orderdate)", _int("dayofyear(o_orderdate)")),
        "month_end": (_day("last_day(o_orderdate)"), _day_sql("last_day(o_orderdate)")),
        "mon": ("month(o_orderdate)", _int("month(o_orderdate)")),
        "months": (
            "CAST(months_between(trunc(o_orderdate, 'MM'), DATE '1990-01-01') AS BIGINT)",
            f"date_diff('month', DATE '1990-01-01', {_DATE})",
        ),
        "monday": (_day("next_day(o_orderdate, 'MO')"), _day_sql(f"{_DATE} + CAST(8 - isodow(o_orderdate) AS INT)")),
        "q": ("quarter(o_orderdate)", _int("quarter(o_orderdate)")),
        "parsed": (
            "to_date(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') = to_date(o_orderdate)",
            "true",
        ),
        "parsed_ts": (
            "to_timestamp(date_format(o_orderdate, 'yyyy-MM-dd HH:mm'), 'yyyy-MM-dd HH:mm') = CAST(o_orderdate AS TIMESTAMP)",
            "true",
        ),
        "year_start": (_day("trunc(o_orderdate, 'YEAR')"), _day_sql("date_trunc('year', o_orderdate)")),
        "epoch_day": ("unix_date(to_date(o_orderdate))", _int(f"{_DATE} - DATE '1970-01-01'")),
        "yr": ("year(o_orderdate)", _int("year(o_orderdate)")),
    },
    ["o_orderkey"],
)

_register(
    "f_time",
    "events",
    {
        "h": ("hour(ts)", _int("hour(ts)")),
        "m": ("minute(ts)", _int("minute(ts)")),
        "s": ("second(ts)", _int("second(ts)")),
    },
    ["event_id"],
)

_X = "(l_discount + l_tax)"


def _nine(expression):
    return f"round({expression}, 9)"


_register(
    "f_math",
    "lineitem",
    {
        "absolute": ("abs(l_discount - l_tax)", None),
        "ac": (_nine(f"acos({_X})"), None),
        "asn": (_nine(f"asin({_X})"), None),
        "at": (_nine("atan(l_quantity)"), None),
        "at2": (_nine("atan2(l_discount, l_quantity)"), None),
        "half_even": ("bround(l_quantity / 4, 1)", "round_even(l_quantity / 4, 1)"),
        "up": ("ceil(l_extendedprice)", "CAST(ceil(l_extendedprice) AS BIGINT)"),
        "up_too": ("ceiling(l_quantity / 3)", "CAST(ceiling(l_quantity / 3) AS BIGINT)"),
        "cosine": (_nine(f"cos({_X})"), None),
        "cosine_h": (_nine(f"cosh({_X})"), None),
        "e_power": (_nine(f"exp({_X})"), None),
        "down": ("floor(l_extendedprice)", "CAST(floor(l_extendedprice) AS BIGINT)"),
        "natural": (_nine("log(l_quantity)"), _nine("ln(l_quantity)")),
        "tens": (_nine("log10(l_quantity)"), None),
        "one_plus": (_nine(f"log1p({_X})"), _nine(f"ln(1 + {_X})")),
        "square": ("pow(l_quantity, 2)", None),
        "cube": ("power(l_quantity, 3)", None),
        "rad": (_nine("radians(l_quantity)"), None),
        "rounded": ("round(l_quantity / 8, 2)", None),
        "root": (_nine("sqrt(l_quantity)"), None),
        "tangent": (_nine(f"tan({_X})"), None),
        "tangent_h": (_nine(f"tanh({_X})"), None),
        "most": ("greatest(l_discount, l_tax, 0.04D)", "greatest(l_discount, l_tax, 0.04)"),
        "fewest": ("least(l_discount, l_tax, 0.04D)", "least(l_discount, l_tax, 0.04)"),
        "not_number": (
            "isnan(CASE WHEN l_discount = 0 THEN double('NaN') ELSE l_discount END)",
            "isnan(CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_discount END)",
        ),
        "number": (
            "nanvl(CASE WHEN l_discount = 0 THEN double('NaN') ELSE l_discount END, -1D)",
            "CASE WHEN l_discount = 0 THEN -1.0 ELSE l_discount END",
        ),
    },
    ["l_orderkey", "l_linenumber"],
)

_register(
    "f_hash",
    "documents",
    {
        "m": ("md5(text)", None),
        "s1": ("sha1(text)", None),
        "s2": ("sha2(text, 256)", "sha256(text)"),
    },
    ["doc_id"],
)


@query("f_hash_numeric")
def f_hash_numeric(spark, sf):
    """Spark's own hashes; the tests check them against other implementations."""
    return ops.select(
        table(spark, sf, "documents"),
        ["doc_id", "crc32(text) AS c", "hash(text) AS h", "xxhash64(text) AS x"],
    )


_ARRAYS = {
    "a": ("array(l_linenumber, CAST(l_quantity AS INT), l_linenumber, 4)", "[l_linenumber, CAST(l_quantity AS INT), l_linenumber, 4]"),
    "b": ("array(4, 5, CAST(l_quantity AS INT))", "[4, 5, CAST(l_quantity AS INT)]"),
}
_ARRAY_FUNCTIONS = {
    "has": ("array_contains(a, 4)", "list_contains(a, 4)"),
    "uniq": ("array_join(array_sort(array_distinct(a)), ',')", "array_to_string(list_sort(list_distinct(a)), ',')"),
    "minus": (
        "array_join(array_sort(array_except(a, b)), ',')",
        "array_to_string(list_sort(list_distinct([x FOR x IN a IF NOT list_contains(b, x)])), ',')",
    ),
    "common": (
        "array_join(array_sort(array_intersect(a, b)), ',')",
        "array_to_string(list_sort(list_distinct([x FOR x IN a IF list_contains(b, x)])), ',')",
    ),
    "text": ("array_join(a, '|')", "array_to_string(a, '|')"),
    "top": ("array_max(a)", "list_max(a)"),
    "low": ("array_min(a)", "list_min(a)"),
    "place": ("array_position(a, 4)", "CAST(coalesce(list_position(a, 4), 0) AS BIGINT)"),
    "without": ("array_join(array_remove(a, 4), ',')", "array_to_string([x FOR x IN a IF x <> 4], ',')"),
    "again": ("array_join(array_repeat(l_linenumber, 3), ',')", "array_to_string([l_linenumber, l_linenumber, l_linenumber], ',')"),
    "n": ("array_size(a)", _int("len(a)")),
    "overlap": ("arrays_overlap(a, b)", "list_has_any(a, b)"),
    "zipped": ("arrays_zip(a, b)[1].b", "b[2]"),
    "at": ("element_at(a, -1)", "a[-1]"),
    "flat": ("array_join(flatten(array(a, b)), ',')", "array_to_string(flatten([a, b]), ',')"),
    "len": ("size(a)", _int("len(a)")),
    "cut": ("array_join(slice(a, 2, 2), ',')", "array_to_string(a[2:3], ',')"),
    "falling": ("array_join(sort_array(a, false), ',')", "array_to_string(list_reverse_sort(a), ',')"),
}


@query(
    "f_array",
    "SELECT l_orderkey, {} FROM (SELECT l_orderkey, l_linenumber, {} FROM lineitem)".format(
        ", ".join(f"{sql} AS {n}" for n, (_, sql) in _ARRAY_FUNCTIONS.items()),
        ", ".join(f"{sql} AS {n}" for n, (_, sql) in _ARRAYS.items()),
    ),
)
def f_array(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, (e, _) in _ARRAYS.items()]
    )
    return df.selectExpr("l_orderkey", *[f"{e} AS {n}" for n, (e, _) in _ARRAY_FUNCTIONS.items()])


@query(
    "f_map",
    """SELECT p_partkey, p_brand AS brand, p_type AS kind, true AS has, 'brand,kind,size' AS names,
              p_brand || ',' || p_type || ',' || CAST(p_size AS VARCHAR) AS vals, 'kind' AS second_key,
              p_name AS from_arrays, p_type AS from_entries, p_size AS in_struct FROM part""",
)
def f_map(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "*", "map_concat(map('brand', p_brand, 'kind', p_type), map('size', CAST(p_size AS STRING))) AS m"
    )
    return df.selectExpr(
        "p_partkey",
        "m['brand'] AS brand",
        "element_at(m, 'kind') AS kind",
        "map_contains_key(m, 'size') AS has",
        "array_join(map_keys(m), ',') AS names",
        "array_join(map_values(m), ',') AS vals",
        "map_entries(m)[1].key AS second_key",
        "map_from_arrays(array('a', 'b'), array(p_brand, p_name))['b'] AS from_arrays",
        "map_from_entries(array(struct('x', p_type)))['x'] AS from_entries",
        "struct(p_name, p_size).p_size AS in_struct",
    )


def _six(expression):
    return f"round({expression}, 6)"


_AGGREGATES = {
    "average": (_six("avg(l_quantity)"), None),
    "mean_value": (_six("mean(l_quantity)"), None),
    "n": ("count(l_quantity)", None),
    "n_distinct": ("count(DISTINCT l_suppkey)", None),
    "correlation": (_six("corr(l_quantity, l_discount)"), None),
    "cov_pop": (_six("covar_pop(l_quantity, l_discount)"), None),
    "cov_samp": (_six("covar_samp(l_quantity, l_discount)"), None),
    # most rows have no value here, and those that have one have the same: nulls must be passed over
    **{
        f"{name}_flag{part}": (f"{call}(CASE WHEN l_tax > 0.06 THEN l_returnflag || '+' END, true)", "any_value(CASE WHEN l_tax > 0.06 THEN l_returnflag || '+' END)")
        for name in ("first", "last")
        for part, call in (("", name), ("_value", f"{name}_value"))
    },
    "top": ("max(l_extendedprice)", None),
    "bottom": ("min(l_extendedprice)", None),
    "at_top": ("max_by(l_quantity, struct(l_extendedprice, l_orderkey, l_linenumber))", "arg_max(l_quantity, (l_extendedprice, l_orderkey, l_linenumber))"),
    "at_bottom": ("min_by(l_quantity, struct(l_extendedprice, l_orderkey, l_linenumber))", "arg_min(l_quantity, (l_extendedprice, l_orderkey, l_linenumber))"),
    "middle": ("median(l_quantity)", None),
    "usual": ("mode(l_linestatus)", None),
    "third_quarter": ("percentile(l_quantity, 0.75)", "quantile_cont(l_quantity, 0.75)"),
    "sd": (_six("stddev(l_quantity)"), None),
    "sd_pop": (_six("stddev_pop(l_quantity)"), None),
    "sd_samp": (_six("stddev_samp(l_quantity)"), None),
    "total": ("sum(l_quantity)", None),
    "total_distinct": ("sum(DISTINCT l_quantity)", None),
    "vp": (_six("var_pop(l_quantity)"), None),
    "vs": (_six("var_samp(l_quantity)"), None),
    "v": (_six("variance(l_quantity)"), None),
}


@query(
    "f_aggregate",
    "SELECT l_returnflag, {} FROM lineitem GROUP BY l_returnflag".format(
        ", ".join(f"{sql or e} AS {n}" for n, (e, sql) in _AGGREGATES.items())
    ),
)
def f_aggregate(spark, sf):
    return ops.aggregate(
        table(spark, sf, "lineitem"),
        ["l_returnflag"],
        [{"expression": e, "alias": n} for n, (e, _) in _AGGREGATES.items()],
    )


@query(
    "f_collect",
    """SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS all_lines,
              array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS lines
       FROM lineitem GROUP BY l_orderkey""",
)
def f_collect(spark, sf):
    """Collections per order, which holds a handful of lines."""
    return ops.aggregate(
        table(spark, sf, "lineitem"),
        ["l_orderkey"],
        [
            {"expression": "array_join(sort_array(collect_list(l_linenumber)), ',')", "alias": "all_lines"},
            {"expression": "array_join(sort_array(collect_set(l_linenumber)), ',')", "alias": "lines"},
        ],
    )


@query(
    "f_conditional",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'NONE') AS segment,
              c_acctbal <= 0 AS missing, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'even' ELSE 'debt' END AS class,
              c_name LIKE '%#%' AS hashed, c_name LIKE 'Cust%' AS named, c_mktsegment LIKE '%Y' AS y_end,
              (CASE WHEN c_acctbal > 0 THEN c_mktsegment END) IS NOT DISTINCT FROM NULL AS same_as_null,
              c_nationkey BETWEEN 3 AND 9 AS near, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed, 1 AS one
       FROM customer""",
)
def f_conditional(spark, sf):
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    kept = F.when(balance > 0, segment)
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.coalesce(kept, F.lit("NONE")).alias("segment"),
        F.isnull(kept).alias("missing"),
        F.when(balance > 5000, "rich").when(balance > 0, "even").otherwise("debt").alias("class"),
        F.col("c_name").contains("#").alias("hashed"),
        F.col("c_name").startswith("Cust").alias("named"),
        segment.endswith("Y").alias("y_end"),
        kept.eqNullSafe(F.lit(None)).alias("same_as_null"),
        F.col("c_nationkey").between(3, 9).alias("near"),
        segment.isin("BUILDING", "MACHINERY").alias("listed"),
        F.lit(1).cast("int").alias("one"),
    )


@query(
    "f_json",
    """SELECT event_id, regexp_extract(props, '[0-9]+') AS k,
              '{"user":' || CAST(user_id AS VARCHAR) || ',"kind":"' || event_type || '"}' AS packed FROM events""",
)
def f_json(spark, sf):
    return ops.select(
        table(spark, sf, "events"),
        [
            "event_id",
            "get_json_object(props, '$.k') AS k",
            "to_json(struct(user_id AS user, event_type AS kind)) AS packed",
        ],
    )


@query(
    "f_dataframe_methods",
    """SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS total_size FROM part WHERE p_size > 10 GROUP BY p_brand
       UNION ALL SELECT 'none', CAST(count(*) AS BIGINT) FROM part WHERE p_size <= 10
       ORDER BY total_size DESC, brand LIMIT 10""",
)
def f_dataframe_methods(spark, sf):
    """DataFrame methods of the custom-code vocabulary, in one block."""

    def block(df):
        large = df.where(F.col("p_size") > 10).withColumnRenamed("p_brand", "brand")
        totals = large.groupBy("brand").agg(F.sum("p_size").alias("total_size"))
        small = df.filter("p_size <= 10").select(F.lit("none"), F.col("p_size")).agg(F.count("*"))
        rest = small.select(F.lit("none").alias("brand"), F.col("count(1)").alias("total_size"))
        return totals.union(rest).orderBy(F.col("total_size").desc(), F.col("brand").asc()).limit(10)

    return ops.custom(table(spark, sf, "part"), block)


@query(
    "f_dataframe_names",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts,
              CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers, l_returnflag || '!' AS marked
       FROM lineitem GROUP BY l_returnflag""",
)
def f_dataframe_names(spark, sf):
    """Functions by their names in the DataFrame API."""
    counts = {
        "suppliers": F.count_distinct(F.col("l_suppkey")),
        "parts": F.countDistinct(F.col("l_partkey")),
        "numbers": F.sum_distinct(F.col("l_linenumber")),
    }
    totals = ops.aggregate(
        table(spark, sf, "lineitem"), ["l_returnflag"], [{"expression": e, "alias": n} for n, e in counts.items()]
    )
    marks = F.create_map(F.lit("k"), F.concat("l_returnflag", F.lit("!")))
    return ops.derive(totals, "marked", F.element_at(marks, "k"))
