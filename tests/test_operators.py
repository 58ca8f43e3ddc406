"""Operators on small literal rows."""

import os

import pytest
from pyspark.sql import functions as F

from pipeops import operators as ops
from pipeops import sources
from pipeops.functions import sort_key
from pipeops.sources.secrets import resolve_options


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_retail_sum(spark, tmp_path):
    path = str(tmp_path / "orders.csv")
    with open(path, "w") as handle:
        handle.write("id,status,amount\n1,COMPLETE,10.5\n2,CANCELLED,4.0\n3,COMPLETE,2.5\n")
    orders = sources.read_file(spark, path, "csv", options={"header": True, "inferSchema": True})
    done = ops.filter_rows(orders, "status = 'COMPLETE'")
    total = ops.aggregate(done, [], [{"expression": "sum(amount)", "alias": "total"}])
    assert total.first()["total"] == 13.0


def test_secret_options(monkeypatch):
    monkeypatch.setenv("DB_PASSWORD", "hunter2")
    assert resolve_options({"user": "a", "password": "secret://DB_PASSWORD"}) == {
        "password": "hunter2",
        "user": "a",
    }
    with pytest.raises(KeyError):
        resolve_options({"password": "secret://NO_SUCH_NAME"})


def test_jdbc_and_kafka_options():
    split = sources.jdbc_options(
        "jdbc:x", "t", {"fetchsize": 10}, partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3
    )
    assert split["partitionColumn"] == "id" and split["numPartitions"] == 3 and split["fetchsize"] == 10
    with pytest.raises(ValueError, match="numPartitions"):
        sources.jdbc_options("jdbc:x", "t", partition_column="id", lower_bound=0, upper_bound=9)
    assert sources.kafka_options("h:1", "topic", {"startingOffsets": "earliest"}) == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "topic",
        "startingOffsets": "earliest",
    }
    with pytest.raises(ValueError):
        sources.kafka_options("", "topic")


def test_streaming_file_needs_schema(spark):
    with pytest.raises(ValueError, match="schema"):
        sources.read_file(spark, "/tmp", "csv", streaming=True)


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\x01")
    df = sources.read_file(spark, str(tmp_path), "binaryFile")
    assert df.selectExpr("length", "content").first() == (2, b"\x00\x01")


def test_replace_follows_chains(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "v string")
    assert rows(ops.replace(df, "v", {"A": "B", "B": "C"})) == [("C",), ("C",), ("C",), (None,)]
    assert rows(ops.replace(df, "v", {"B": "C", "A": "B"}, chained=False)) == [("B",), ("C",), ("C",), (None,)]


def test_derive_overwrites_and_rename_swaps(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert ops.derive(df, "a", "a + b").first() == (3, 2)
    swapped = ops.rename(df, {"a": "b", "b": "a"})
    assert swapped.columns == ["b", "a"] and swapped.first() == (1, 2)


def test_drop_nulls_without_subset_means_all_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (1, 2)], "a int, b int")
    assert rows(ops.drop_nulls(df)) == [(1, 2)]
    assert rows(ops.drop_nulls(df, "all")) == [(1, 2), (1, None)]


def test_build_map_needs_pairs(spark):
    with pytest.raises(ValueError):
        ops.build_map(spark.range(1), "m", ["'a'", "'b'"], ["1"])


def test_posexplode_keeps_columns_named_pos_and_col(spark):
    df = spark.createDataFrame([(1, 2, ["x", "y"])], "pos int, col int, items array<string>")
    out = ops.posexplode(df, "items", "item", "place")
    assert out.columns == ["pos", "col", "items", "place", "item"]
    assert [r["item"] for r in out.collect()] == ["x", "y"]


def test_join_names_and_conditions(spark):
    left = spark.createDataFrame([(1, "l"), (2, "l")], "id int, v string")
    right = spark.createDataFrame([(2, "r"), (3, "r")], "id int, v string")
    assert ops.join(left, right, "left.id = right.id").columns == ["id", "v", "right_id", "right_v"]
    full = ops.join(left, right, "left.id = right.id", "full")
    assert rows(full) == rows(ops.join(left, right, "left.id = right.id", "full", split_full=False))
    assert len(rows(full)) == 3
    with pytest.raises(ValueError, match="condition"):
        ops.join(left, right)
    with pytest.raises(ValueError, match="join type"):
        ops.join(left, right, "true", "sideways")


def test_full_join_keeps_nulls_and_copies(spark):
    left = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,), (5,), (5,)], "k int")
    ours = ops.join(left, right, "left.k = right.k", "full")
    assert rows(ours) == rows(ops.join(left, right, "left.k = right.k", "full", split_full=False))
    assert ours.count() == 6


def test_sort_directions(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r[0] for r in ops.sort(df, ["x DESC"]).collect()] == [3, 1, None]
    assert [r[0] for r in ops.sort(df, ["x desc nulls first"]).collect()] == [None, 3, 1]
    assert [r[0] for r in ops.sort(df, [("x", "asc", "last")]).collect()] == [1, 3, None]
    assert [r[0] for r in ops.sort(df, ["x"]).collect()] == [None, 1, 3]
    assert "DESC NULLS LAST" in str(sort_key("x + 1 DESC"))


def test_except_forms(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(1,)], "k int")
    assert rows(ops.except_(left, right)) == [(1,), (2,)]
    assert rows(ops.except_(left, right, all=False)) == [(2,)]


def test_aggregate_defaults_to_row_count(spark):
    assert ops.aggregate(spark.range(4)).first()["row_count"] == 4


def test_json_parse_malformed(spark):
    df = spark.createDataFrame([('{"id": 3}',), ("{",)], "payload string")
    parsed = ops.json_parse(df, "payload", "id INT", "p").select("p.id")
    assert rows(parsed) == [(3,), (None,)]


def test_session_aggregate_equals_session_window(spark):
    """Events exactly one gap apart, on chunk borders and in copies."""
    events = spark.range(0, 400).selectExpr(
        "id % 3 AS k", "timestamp_seconds(id * id * 7 % 90000 DIV 60 * 60) AS ts"
    )
    native = ops.aggregate(
        events, ["k", "session_window(ts, '2 minutes')"], [{"expression": "count(*)", "alias": "n"}]
    ).selectExpr("k", "session_window.start AS s", "session_window.end AS e", "n")
    ours = ops.session_aggregate(events, ["k"], "ts", "2 minutes", {"n": "1"})
    assert rows(ours) == rows(native)


def test_custom_must_return_a_dataframe(spark):
    with pytest.raises(ValueError):
        ops.custom(spark.range(1), lambda df: 1)
    assert ops.custom(spark.range(3), lambda df: df.where(F.col("id") > 0)).count() == 2


def test_single_row_sources_of_other_sizes_fail(spark):
    from pyspark.errors import PySparkException

    from pipeops import sources

    two = spark.createDataFrame([(1,), (2,)], "p int")
    assert sources.with_constants(spark.range(3), two.limit(1)).count() == 3
    for wrong in (two, two.limit(0)):
        with pytest.raises(PySparkException, match="a single row is needed"):
            sources.with_constants(spark.range(3), wrong).collect()


def test_change_feed_ties_in_maps_and_variants(spark):
    from pipeops import outputs

    rows = [(1, 5, {"a": "x", "b": "y"}, '{"v": 1}'), (1, 5, {"b": "z", "a": "x"}, '{"v": 1}'), (2, 5, None, '{"v": 1}'), (2, 5, None, '{"v": 2}')]
    feed = spark.createDataFrame(rows, "k int, s int, m map<string,string>, v string").withColumn("v", F.parse_json("v"))
    for df in (feed, feed.repartition(4), feed.coalesce(1)):
        got = {r["k"]: (r["m"], r["t"]) for r in outputs.cdc_scd1(df, ["k"], "s").withColumn("t", F.to_json("v")).drop("v").collect()}
        assert got == {1: ({"a": "x", "b": "z"}, '{"v":1}'), 2: (None, '{"v":2}')}


def test_scratch_is_released(spark):
    from pipeops import session

    session.release(spark)
    path = session.scratch(spark, "gone")
    spark.range(100).write.parquet(f"{path}/rows")
    assert session.release(spark) == 1 and session.release(spark) == 0
    assert not [f for _, _, names in os.walk(path) for f in names if f.startswith("part-") and os.path.getsize(os.path.join(path, f)) > 1000]
    assert not os.path.isdir(f"{path}/rows")
