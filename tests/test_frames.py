"""Frames over split partitions against Spark's own, and how a hot key is spread."""

import pytest
from pyspark.sql import functions as F

from pipeops import operators as ops
from pipeops.operators import cuts


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, 90 % have the same first order value, and there are nulls."""
    made = spark.range(1200).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS k",
        "CASE WHEN id % 10 = 0 THEN id % 7 ELSE 5 END AS x",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST((id * 31) % 13 AS DOUBLE) END AS v",
        "CASE WHEN id % 17 = 0 THEN NULL ELSE (id * 7919) % 101 END AS t",
    )
    return spark.createDataFrame(made.collect(), made.schema)


def same(left, right):
    def key(df):
        return sorted((tuple(r) for r in df.selectExpr("id", "round(CAST(w AS DOUBLE), 6) AS w").collect()), key=repr)

    assert key(left) == key(right)


FRAMES = [("unbounded preceding", "current row"), ("unbounded preceding", 3), ("unbounded preceding", -2), (-2, 1), (1, 4), (-5, -3), (0, 0), ("current row", "unbounded following"), (-1, "unbounded following"), (2, "unbounded following"), ("unbounded preceding", "unbounded following")]
FUNCTIONS = {"count": "count(v)", "sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "first_value": "first_value(v)", "last_value": "last_value(v)", "nth_value": "nth_value(v, 3)"}


@pytest.mark.parametrize("function,frame", [(f, FRAMES[(3 * i + j) % len(FRAMES)]) for i, f in enumerate(FUNCTIONS) for j in (0, 1, 4)])
def test_rows_frames(skewed, frame, function):
    plain = ops.window(skewed, "w", FUNCTIONS[function], ["k"], ["x DESC", "id"], ("rows", *frame))
    split = ops.split_frame(skewed, "w", function, ["x DESC", "id"], "v", ["k"], ("rows", *frame), offset=3, splits=6, rows_per_chunk=7)
    same(split, plain)


@pytest.mark.parametrize("frame", [("unbounded preceding", 1), (-4, 2), (-1, "unbounded following"), ("unbounded preceding", "unbounded following")])
@pytest.mark.parametrize("function", ["first_value", "last_value"])
def test_values_that_skip_nulls(skewed, frame, function):
    low, high = frame
    plain = ops.window(skewed, "w", f"{function}(v) IGNORE NULLS", [], ["x", "id"], ("rows", low, high))
    split = ops.split_frame(skewed, "w", function, ["x", "id"], "v", [], ("rows", low, high), ignore_nulls=True, splits=6, rows_per_chunk=50)
    same(split, plain)


@pytest.mark.parametrize("function,offset", [("lag", 2), ("lead", 1), ("lead", 40)])
def test_offsets_by_any_number_of_rows(skewed, function, offset):
    plain = ops.window(skewed, "w", f"{function}(v, {offset}, -1.0D)", ["k"], ["x", "id DESC"])
    split = ops.split_frame(skewed, "w", function, ["x", "id DESC"], "v", ["k"], offset=offset, default=-1.0, splits=6, rows_per_chunk=7)
    same(split, plain)


def test_any_aggregate_in_a_bounded_frame(skewed):
    frame = "PARTITION BY k ORDER BY x, id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING"
    split = ops.split_frame(skewed, "s", "collect_set(v)", ["x", "id"], None, ["k"], ("rows", -3, 2), splits=6, rows_per_chunk=7)
    same(split.withColumn("w", F.size("s")), skewed.selectExpr("*", f"size(collect_set(v) OVER ({frame})) AS w"))


RANGES = [(-3, 4), (0, 0), (2, 5), ("unbounded preceding", "current row"), ("unbounded preceding", 4), ("unbounded preceding", -4), (-2, "unbounded following"), ("unbounded preceding", "unbounded following")]


@pytest.mark.parametrize("frame", RANGES)
@pytest.mark.parametrize("function,direction", [("sum", "t"), ("count", "t DESC"), ("max", "t ASC NULLS LAST")])
def test_range_frames(skewed, frame, direction, function):
    plain = ops.window(skewed, "w", f"{function}(v)", ["k"], [direction], ("range", *frame))
    split = ops.split_frame(skewed, "w", function, [direction], "v", ["k"], ("range", *frame), splits=5, rows_per_chunk=20)
    same(split, plain)


def test_refused(skewed):
    for wrong in ({"function": "sum"}, {"function": "sum(v)", "frame": ("rows", "unbounded preceding", 0)}, {"function": "sum", "argument": "v", "frame": ("groups", 0, 1)}, {"function": "first_value", "argument": "v", "frame": ("range", "unbounded preceding", 0)}, {"function": "sum", "argument": "v", "frame": ("range", 0, 1), "order_by": ["t", "id"]}):
        with pytest.raises(ValueError):
            ops.split_frame(skewed, "w", **({"order_by": ["t"]} | wrong)).collect()


def test_places_are_the_sorted_order(skewed):
    placed = ops.places(skewed, ["x DESC", "t NULLS LAST", "id"], splits=7).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 1201))
    assert [r.id for r in placed] == [r.id for r in ops.sort(skewed, ["x DESC", "t NULLS LAST", "id"]).collect()]


def test_equal_first_values_are_cut_by_the_next(spark):
    """90 % of 100,000 rows have one first value; sixteen chunks hold about a sixteenth each."""
    df = spark.range(100_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id ELSE 5 END AS x", "CAST(hash(id) AS STRING) AS s", "CAST(id AS TIMESTAMP) AS t", "CAST(CAST(id % 50 AS STRING) AS BINARY) AS b")
    for order in (["x", "s"], ["x DESC", "t DESC"], ["x", "b", "id"]):
        sizes = [r["count"] for r in df.groupBy(cuts.chunk_number(df, order, chunks=16).alias("c")).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 1.4 * 100_000 / 16
    assert df.select(cuts.chunk_number(df, ["x"], rows_per_chunk=200_000).alias("c")).distinct().count() == 1
    assert df.groupBy(cuts.chunk_number(df, ["x", "s"], rows_per_chunk=10_000).alias("c")).count().count() in (9, 10, 11)


def test_equal_rows_are_cut_by_a_hash_where_ties_do_not_show(spark):
    df = spark.range(50_000).selectExpr("id", "1 AS x")
    text = [r["count"] for r in ops.places(df, ["x"], splits=10).groupBy(F.floor((F.col("place") - 1) / 5000)).count().collect()]
    assert text == [5000] * 10
    tied = df.withColumn("__tie", cuts.row_hash(df))
    assert max(r["count"] for r in tied.groupBy(cuts.chunk_number(tied, ["x", "__tie"], chunks=10)).count().collect()) < 8000


def test_chunks_come_in_order(skewed):
    for order in (["x", "t", "id"], ["x DESC", "t DESC", "id"], ["t NULLS LAST", "x", "id DESC"], ["v DESC NULLS FIRST", "id"]):
        rows = ops.sort(skewed.withColumn("c", cuts.chunk_number(skewed, order, chunks=9)), order).collect()
        numbers = [r.c for r in rows]
        assert numbers == sorted(numbers) and len(set(numbers)) == 9


@pytest.mark.parametrize("gap,chunk", [("1 second", "hour"), ("50 minutes", "minute"), ("50 minutes", "day"), ("3 hours", "hour"), ("2 days", "day")])
def test_sessions_of_a_hot_key(spark, gap, chunk):
    events = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END AS k", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, (id * id * 37) % 700, 0) AS ts", "id AS v")
    split = ops.session_aggregate(events, ["k"], "ts", gap, {"n": "1", "v": "v"}, chunk)
    plain = events.groupBy("k", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.select("k", "s.start", "s.end", "n", "v").collect()))


def test_only_edges_of_chunks_are_scanned_per_key(spark):
    """A gap shorter than the spacing of events makes every event a session; few of them reach the key's task."""
    events = spark.range(20_000).selectExpr("0 AS k", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 10) AS ts")
    assert ops.session_aggregate(events, ["k"], "ts", "1 second", {"n": "1"}).count() == 20_000
    hours = 20_000 * 10 // 3600 + 1
    pieces = events.groupBy("k", F.date_trunc("hour", "ts")).count().count()
    assert pieces == hours  # at most two edges each go to one task
