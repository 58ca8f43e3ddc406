"""Quality checks on small literal cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from pipeops import quality


def status(df):
    return {r["check_id"]: r["status"] for r in df.collect()}


def test_null_rate(spark):
    df = spark.createDataFrame([(None,), ("ok",)], "value string")
    check = {"id": "n", "type": "null_rate", "config": {"column": "value", "maxRate": 0.25}}
    row = quality.check_columns(df, [check]).first()
    assert (row["status"], row["actual"]) == ("failed", 0.5)
    check["config"]["maxRate"] = 0.5
    assert status(quality.check_columns(df, [check])) == {"n": "passed"}


def test_null_rate_of_nothing_is_zero(spark):
    df = spark.createDataFrame([], "value string")
    check = {"id": "n", "type": "null_rate", "config": {"column": "value", "maxRate": 0}}
    row = quality.check_columns(df, [check]).first()
    assert (row["status"], row["actual"], row["checked"]) == ("passed", 0.0, 0)


def test_uniqueness(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "id int")
    row = quality.uniqueness(df, "u", ["id"]).first()
    assert (row["status"], row["failed"], row["checked"]) == ("failed", 2, 4)
    assert quality.uniqueness_duplicates(df, ["id"]).count() == 2
    assert status(quality.uniqueness(df.where("false"), "u", ["id"])) == {"u": "passed"}


def test_quarantine(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    for condition in ("not_null", "non_empty"):
        split = quality.quarantine_split(df, condition, "id")
        assert [r["id"] for r in split.accepted.collect()] == [1]
        assert [r["id"] for r in split.quarantine.collect()] == [None]


def test_referential(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    reference = spark.createDataFrame([(1,)], "id int")
    row = quality.referential(df, reference, "r", ["id"]).first()
    assert (row["status"], row["failed"]) == ("failed", 1)
    assert status(quality.referential(df, None, "r", ["id"])) == {"r": "deferred"}


def test_null_keys_match_null(spark):
    df = spark.createDataFrame([(None,)], "id int")
    assert status(quality.referential(df, df, "r", ["id"])) == {"r": "passed"}


def test_row_count_range_is_inclusive(spark):
    def check(low, high):
        config = {"minimum": low, "maximum": high}
        return status(quality.check_columns(spark.range(3), [{"id": "c", "type": "row_count_range", "config": config}]))

    assert check(3, 3) == {"c": "passed"}
    assert check(4, None) == {"c": "failed"}
    assert check(0, 2) == {"c": "failed"}


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert status(quality.schema_contract(df, "s", [{"name": "a"}, {"name": "b"}])) == {"s": "passed"}
    assert status(quality.schema_contract(df, "s", [{"name": "a"}])) == {"s": "failed"}


def test_column_rule_actions(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    seen = Observation("warned")
    assert len(quality.apply_column_rule(df, "not_null", "id", "warn", seen).collect()) == 2
    assert seen.get == {"checked": 2, "failed": 1}
    assert quality.apply_column_rule(df, "not_null", "id", "drop").count() == 1
    with pytest.raises(PySparkException, match="rule failed"):
        quality.apply_column_rule(df, "not_null", "id", "fail").collect()
    with pytest.raises(ValueError):
        quality.apply_column_rule(df, "not_null", "id", "shrug")


def test_observe_rule(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "id int")
    watched, seen = quality.observe_rule(df, "ids", "not_null", "id")
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"checked": 3, "failed": 1}


def test_suite_modes(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    checks = [
        {"id": "now", "type": "column_rule", "config": {"column": "id", "condition": "not_null"}},
        {"id": "later", "type": "row_count_range", "mode": "scheduled", "config": {"minimum": 1}},
    ]
    assert status(quality.run_suite({"t": df}, checks, "preview")) == {"now": "failed"}
    everything = quality.run_suite({"t": df}, checks)
    assert status(everything) == {"now": "failed", "later": "passed"}
    assert quality.suite_status(everything).first()["status"] == "failed"
    with pytest.raises(ValueError, match="mode"):
        quality.run_suite({"t": df}, checks, "nightly")


def test_deferred_does_not_fail_a_suite(spark):
    df = spark.createDataFrame([(1,)], "id int")
    checks = [{"id": "r", "type": "referential_sample", "config": {"columns": ["id"], "reference": "none"}}]
    assert quality.suite_status(quality.run_suite({"t": df}, checks)).first()["status"] == "passed"


def test_profile_probe_takes_the_named_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert [r["column"] for r in quality.profile_probe(df, ["c"]).collect()] == ["c"]
