"""Observability operators on small literal cases."""

import json
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from pipeops import observe, outputs, plans
from pipeops.observe import DEFAULT_RULES, Rule


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


# Profiles


def test_profile(spark):
    df = spark.createDataFrame([(1, 3.5), (2, None), (1, 5.0)], "id int, amount double")
    got = by(observe.profile(df), "column")
    assert got["amount"]["count"] == 3 and got["amount"]["null_count"] == 1 and got["amount"]["min"] == 3.5
    assert got["id"]["distinct_count"] == 2


def test_profile_distribution(spark):
    df = spark.createDataFrame([(2, "ok"), (4, "ok"), (6, "bad")], "amount int, status string")
    got = by(observe.profile(df), "column")
    assert got["amount"]["mean"] == 4.0 and round(got["amount"]["stddev"], 6) == 1.632993
    assert got["status"]["min"] is None
    top = observe.top_values(df).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [("ok", 2), ("bad", 1)]
    assert "min" not in observe.profile(df, include_sensitive=False).columns


def test_profile_approx_is_near(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rough, exact = (by(observe.profile(lines, approx=a), "column") for a in (True, False))
    assert not rough["l_tax"]["distinct_exact"]
    for column, row in exact.items():
        assert abs(rough[column]["distinct_count"] - row["distinct_count"]) <= 0.15 * row["distinct_count"]


def test_profile_of_maps(spark):
    df = spark.sql("SELECT map('a', 1) AS m UNION ALL SELECT map('a', 1) UNION ALL SELECT NULL")
    assert by(observe.profile(df), "column")["m"]["distinct_count"] == 1


def test_profile_diff(spark):
    before = observe.profile(spark.createDataFrame([(2.0,)], "amount double"))
    after = observe.profile(spark.createDataFrame([(4.0, "x"), (6.0, "y")], "amount double, status string"))
    got = by(observe.profile_diff(before, after), "column", "metric")
    assert got["amount", "max"]["delta"] == 4.0 and got["amount", "max"]["relative_delta"] == 2.0
    assert got["amount", "null_count"]["relative_delta"] is None
    assert {got["status", m]["status"] for m in ("count", "max")} == {"insufficient_data"}
    assert got["status", "count"]["reason"] == "column_added_or_removed"


def test_profile_diff_marks_infinite_metrics(spark):
    one = observe.profile(spark.createDataFrame([(1.0,)], "x double"))
    infinite = observe.profile(spark.createDataFrame([(float("inf"),)], "x double"))
    assert by(observe.profile_diff(one, infinite), "metric")["max"]["status"] == "insufficient_data"


# Schemas


def changes(spark, before, after):
    fields = [observe.schema_fields(spark.createDataFrame([], ddl)) for ddl in (before, after)]
    return observe.schema_diff(*fields)


def test_schema_diff(spark):
    got = by(changes(spark, "id int, amount double", "id long, status string"), "path")
    assert {p: r["kind"] for p, r in got.items()} == {
        "id": "type_changed",
        "amount": "removed",
        "status": "added",
    }
    assert got["amount"]["breaking"] and not got["status"]["breaking"]


def test_nested_schema_diff(spark):
    got = by(changes(spark, "payload struct<id:int>", "payload struct<id:bigint,label:string>"), "path")
    assert {p: (r["kind"], r["nested"]) for p, r in got.items()} == {
        "payload.id": ("type_changed", True),
        "payload.label": ("added", True),
    }


def test_nullability_and_order_changes(spark):
    got = by(changes(spark, "a int not null, b int, c int", "a int, c int, b int"), "path")
    assert got["a"]["kind"] == "nullability_changed"
    assert got["b"]["kind"] == got["c"]["kind"] == "order_changed"
    assert changes(spark, "a int, b int", "z int, a int, b int").where("kind <> 'added'").count() == 0


@pytest.mark.parametrize("mode, status", [("block", "blocked"), ("warn", "warned")])
def test_schema_contract(spark, mode, status):
    removed = changes(spark, "a int, b int", "a int")
    assert observe.schema_contract_status(removed, mode=mode).first()["status"] == status
    added = changes(spark, "a int", "a int, b int")
    assert observe.schema_contract_status(added, mode=mode).first()["status"] == "passed"
    assert observe.schema_contract_status(added, mode=mode, allow_added=False).first()["status"] == status
    assert observe.schema_contract_status(changes(spark, "a int", "a int")).first()["status"] == "passed"


SNAPSHOT = "array<struct<name:string,type:string,nullable:boolean,fields:array<struct<name:string,type:string,nullable:boolean>>>>"


def test_nested_snapshots(spark):
    old = [("payload", "struct", True, [("id", "int", True)])]
    new = [("payload", "struct", True, [("id", "bigint", True), ("label", "string", True)])]
    df = spark.createDataFrame([(1, old, new)], f"run int, b {SNAPSHOT}, a {SNAPSHOT}")
    got = by(observe.schema_changes(df, ["run"], "b", "a"), "path")
    assert {p: r["kind"] for p, r in got.items()} == {"payload.id": "type_changed", "payload.label": "added"}
    paths = observe.snapshot_fields(df, ["run"], "a")
    assert sorted(r["path"] for r in paths.collect()) == ["payload", "payload.id", "payload.label"]


FLAT = "array<struct<name:string,type:string,nullable:boolean>>"


def test_fingerprint_ignores_order(spark):
    a, b = ("a", "int", True), ("b", "int", False)
    df = spark.createDataFrame([([a, b],), ([b, a],), ([a],)], f"schema {FLAT}")
    prints = [r[0] for r in df.select(observe.schema_fingerprint("schema")).collect()]
    assert prints[0] == prints[1] != prints[2] and len(prints[0]) == 64


@pytest.mark.parametrize("split_by", ["date_trunc('day', created_at)", None])
def test_schema_timeline(spark, split_by):
    runs = spark.sql(
        "SELECT 'r1' AS run_id, TIMESTAMP '2024-01-01 00:00:00' AS created_at "
        "UNION ALL SELECT 'r2', TIMESTAMP '2024-01-01 05:00:00' UNION ALL SELECT 'r3', TIMESTAMP '2024-01-03 00:00:00'"
    )
    snapshots = spark.createDataFrame(
        [
            ("r1", "n", [("id", "int", True)]),
            ("r2", "n", [("id", "bigint", True)]),
            ("r3", "n", [("id", "bigint", True), ("x", "int", True)]),
            ("r3", "m", [("id", "int", True)]),
            ("r3", "no schema", None),
        ],
        f"run_id string, node_id string, schema {FLAT}",
    )
    got = by(observe.schema_timeline(runs, snapshots, split_by), "node_id", "run_id")
    assert len(got) == 4
    assert [got["n", r]["changed"] for r in ("r1", "r2", "r3")] == [False, True, False]
    assert got["n", "r3"]["added"] == ["x"] and not got["m", "r3"]["changed"]


# Event logs


def task(stage, duration, run_time=0, **more):
    return json.dumps(
        {
            "Event": "SparkListenerTaskEnd",
            "Stage ID": stage,
            "Task Info": {"Launch Time": 1000, "Finish Time": 1000 + duration},
            "Task Metrics": {"Executor Run Time": run_time, **more},
        }
    )


def submitted(stage, name):
    return json.dumps({"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": stage, "Stage Name": name}})


@pytest.mark.parametrize("stored", [False, True])
def test_stage_summary(spark, tmp_path, stored):
    lines = [
        submitted(1, "join"),
        task(1, 100, 90, **{"Shuffle Read Metrics": {"Remote Bytes Read": 7, "Local Bytes Read": 3}}),
        task(1, 110, 100),
        task(1, 900, 880),
        submitted(2, "empty"),
        "not json",
        json.dumps({"Event": "SparkListenerApplicationEnd"}),
    ]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    store = str(tmp_path / "tasks") if stored else None
    got = by(observe.stage_summary(df, store=store), "stage_id")
    one = got[1]
    assert (one["name"], one["task_count"], one["median_task_ms"], one["p95_task_ms"]) == ("join", 3, 110.0, 900)
    assert one["skew_score"] == 8.18 and one["diagnostic"] == "severe skew"
    assert one["scheduler_delay_ms"] == 40 and one["shuffle_read_bytes"] == 10
    assert (got[2]["task_count"], got[2]["skew_score"], got[2]["diagnostic"]) == (0, 0.0, "balanced/unknown")


def test_stage_thresholds(spark):
    df = spark.createDataFrame([("",)], "value string")
    for moderate, severe in ((0.5, 2), (3, 3), (5, 2)):
        with pytest.raises(ValueError):
            observe.stage_summary(df, moderate, severe)


def test_event_log_folder(spark, tmp_path):
    """Plain and rolled logs; stage ids of two applications stay apart."""
    (tmp_path / "eventlog_v2_local-1").mkdir()
    (tmp_path / "eventlog_v2_local-1" / "events_1_local-1").write_text(task(0, 5) + "\n")
    (tmp_path / "app-2024-0001").write_text(task(0, 9) + "\n")
    got = by(observe.stage_summary(observe.read_event_log(spark, str(tmp_path))), "app")
    assert {a: r["max_task_ms"] for a, r in got.items()} == {"local-1": 5, "app-2024-0001": 9}


def test_streaming_progress(spark):
    def report(batch, rate, rows, event="SparkListenerStreamingQueryProgress"):
        return json.dumps(
            {
                "Event": event,
                "checkpointLocation": "/c/q",
                "progress": {
                    "id": "q",
                    "timestamp": f"2024-01-01T00:00:0{batch}Z",
                    "batchId": batch,
                    "inputRowsPerSecond": rate,
                    "eventTime": {"watermark": "w"},
                    "stateOperators": [{"operatorName": "agg", "numRowsTotal": rows}],
                },
            }
        )

    spark_name = "org.apache.spark.sql.streaming.StreamingQueryListener$QueryProgressEvent"
    lines = [report(1, 5.0, 4), report(2, 10.0, 8, spark_name), json.dumps({"event": "query_progress", "runId": "r"})]
    got = observe.streaming_progress(spark.createDataFrame([(v,) for v in lines], "value string"))
    latest = by(got.latest, "query_id")
    assert latest["q"]["input_rows_per_second"] == 10.0 and latest["q"]["batches"] == 2
    assert latest["q"]["watermark"] == "w" and set(latest) == {"q", "r"}
    assert got.state.where("batch_id = 2").first()["num_rows_total"] == 8
    assert [r["checkpoint"] for r in got.checkpoints.collect()] == ["/c/q"]


# Runs


def test_run_comparison(spark):
    runs = spark.sql(
        """SELECT 'a' AS run_id, '2024-01-01 00:00:00' AS started_at, '2024-01-01 00:00:10' AS finished_at,
                  'succeeded' AS status, 'run' AS mode, 'h1' AS code_hash
           UNION ALL SELECT 'b', '2024-01-01 00:00:00', '2024-01-01 00:00:25', 'failed', 'run', 'h1'
           UNION ALL SELECT 'c', '2024-01-01 00:00:00', NULL, 'running', 'run', 'h2'"""
    )
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "left_run string, right_run string")
    got = by(observe.run_deltas(runs, pairs), "left_run")
    assert got["a"]["delta_seconds"] == 15.0 and got["a"]["status_changed"] and not got["a"]["code_changed"]
    assert got["b"]["delta_seconds"] is None and got["b"]["code_changed"]

    stages = spark.createDataFrame(
        [("a", 1, 10, 1), ("b", 1, 25, 1), ("b", 2, 5, None)],
        "run_id string, stage_id int, shuffle_read_bytes long, shuffle_write_bytes long",
    )
    deltas = by(observe.stage_deltas(stages, pairs), "left_run", "stage_id")
    assert deltas["a", 1]["shuffle_read_bytes_delta"] == 15 and deltas["a", 1]["available"]
    assert deltas["a", 2]["shuffle_read_bytes_delta"] == 5
    assert not deltas["b", 1]["available"]

    problems = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("b", "z")], "run_id string, message string")
    got = observe.problem_changes(problems, pairs.where("left_run = 'a'"))
    assert sorted((r["change"], r["message"]) for r in got.collect()) == [("added", "z"), ("removed", "x")]


# Logs


def test_log_lines_find_the_narrowest_range(spark):
    file = "transformations/generated.py"
    source_map = spark.createDataFrame(
        [("output", file, 10, 20), ("filter", file, 14, 14), ("other", "elsewhere.py", 14, 14)],
        "node_id string, file string, start_line int, end_line int",
    )
    lines = spark.createDataFrame(
        [(1, 'File "/x/generated.py", line 14, in f'), (2, "generated.py:12: oops"), (3, "nothing"), (4, "generated.py:99")],
        "n int, text string",
    )
    got = by(observe.attribute_log_lines(lines, source_map), "n")
    assert [got[i]["node_id"] for i in (1, 2, 3, 4)] == ["filter", "output", None, None]
    assert [got[i]["generated_line"] for i in (1, 2, 3, 4)] == [14, 12, None, 99]


def test_diagnosis(spark):
    rows = [
        (1, "UNRESOLVED_COLUMN.WITH_SUGGESTION", "boom"),
        (2, "", "pod is in ImagePullBackOff"),
        (3, "OUT_OF_MEMORY", "no words for it"),
        (4, None, "x" * 10_000 + " bad checkpoint"),
    ]
    df = spark.createDataFrame(rows, "n int, cls string, msg string")

    got = sorted((r["n"], r["rule_id"]) for r in observe.diagnose(df, "msg", "cls").collect())
    assert got == [(1, "spark.analysis.unresolved-column"), (2, "spark.kubernetes-image-pull"), (4, "spark.streaming-checkpoint")]


def test_every_rule_has_advice():
    assert len(DEFAULT_RULES) == 12
    assert all(r.checks and r.remediation for r in DEFAULT_RULES)


def test_own_rules(spark):
    df = spark.createDataFrame([("a\nfoo bar",)], "message string")
    rules = observe.rules_from([
        {"rule_id": "mine", "text_pattern": ".*foo.*", "severity": "warning"},
        {"rule_id": "a.dot", "text_pattern": r"foo\.*", "checks": ["look"]},
        {"rule_id": "lazy", "cause": "found", "text_pattern": ".*?bar"},
        {"rule_id": "none", "text_pattern": r"foo\.bar"},
    ])
    got = [(r["rule_id"], r["code"], r["severity"], r["probable_cause"], r["checks"]) for r in observe.diagnose(df, rules=rules).collect()]
    assert got == [("mine", "DIAG-MINE", "warning", "mine", []), ("a.dot", "DIAG-A-DOT", "error", "a.dot", ["look"]), ("lazy", "DIAG-LAZY", "error", "found", [])]
    for wrong in ([{"cause": "x"}], ["x"], [{"rule_id": "x", "pattern": "y"}], [{"rule_id": "x", "text_pattern": 3}], [{"rule_id": "x", "checks": [1]}]):
        with pytest.raises(ValueError):
            observe.rules_from(wrong)


# Trace


def test_aggregate_trace(spark):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("a", 4), ("a", 1), ("b", 5)], "kind string, amount int")
    trace = observe.Trace.start(df, ["amount"], "rows").aggregate(
        ["kind"], [{"expression": "sum(amount)", "alias": "total"}]
    )
    got = by(trace.lineage(), "kind")
    assert {k: (r["total"], r["trace_ids"]) for k, r in got.items()} == {"a": (10, ["aggregate:a"]), "b": (5, ["aggregate:b"])}
    edges = sorted(tuple(r) for r in trace.contributions().collect())
    assert edges == [("aggregate", f"aggregate:{k}", f"rows:{n}") for k, n in (("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5))]


def test_ids_do_not_collide(spark):
    rows = [("a:b", "c"), ("a", "b:c"), (None, "null"), ("null", None), ("\\N", "x"), (None, "x"), ("a\\", ":b"), ("a\\:", "b")]
    df = spark.createDataFrame(rows, "p string, q string")
    ids = [r["trace_ids"][0] for r in observe.Trace.start(df, ["p", "q"], "s").lineage().collect()]
    assert len(set(ids)) == len(rows)


def test_a_dropped_group_loses_all_its_rows(spark):
    df = spark.createDataFrame([(i, "big" if i < 10 else "small") for i in range(12)], "id int, kind string")
    per_kind = observe.Trace.start(df, ["id"], "s").aggregate(["kind"], [{"expression": "count(*)", "alias": "n"}], "kinds")
    kept = per_kind.filter("n < 5", "rare").aggregate([], [{"expression": "sum(n)", "alias": "n"}], "all").filter("n > 100", "none")
    fates = sorted(tuple(r) for r in kept.fates().collect())
    assert fates == sorted([(f"s:{i}", "rare", "filter") for i in range(10)] + [("s:10", "none", "filter"), ("s:11", "none", "filter")])


@pytest.mark.parametrize("how,lost", [("inner", ["left:1", "right:3"]), ("left", ["right:3"]), ("right", ["left:1"]), ("full", []), ("left_semi", ["left:1"]), ("left_anti", ["left:2"])])
def test_fates_of_both_sides(spark, how, lost):
    left = observe.Trace.start(spark.createDataFrame([(1,), (2,)], "id int"), ["id"], "left")
    right = observe.Trace.start(spark.createDataFrame([(2,), (3,)], "id int"), ["id"], "right")
    assert sorted(r["trace_id"] for r in left.join(right, "left.id = right.id", how).fates().collect()) == lost


def test_join_then_aggregate_trace(spark):
    left = observe.Trace.start(spark.createDataFrame([(1,), (2,)], "id int"), ["id"], "left")
    right = observe.Trace.start(spark.createDataFrame([(2,), (3,)], "id int"), ["id"], "right")
    joined = left.join(right, "left.id = right.id").aggregate(["id"], [{"expression": "count(*)", "alias": "n"}])
    assert [tuple(r) for r in joined.rows().collect()] == [(2, 1)]
    assert sorted(r["trace_id"] for r in joined.contributions().collect()) == ["left:2", "right:2"]
    assert sorted(r["trace_id"] for r in joined.fates().collect()) == ["left:1", "right:3"]


def test_custom_boundary_is_unknown(spark):
    trace = observe.Trace.start(spark.range(3), ["id"], "source").custom(lambda df: df.where("id > 0")).output()
    got = by(trace.report(), "step")
    assert got["source"]["status"] == "known"
    assert got["custom"]["status"] == got["output"]["status"] == "unknown"
    assert got["custom"]["rows_in"] == 3 and got["output"]["rows_out"] == 2


def test_every_row_of_a_filter_is_accounted_for(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, keep boolean")
    trace = observe.Trace.start(df, ["id"], "s").rename({"id": "key"}).cast("key", "bigint").filter("keep")
    assert [r["key"] for r in trace.rows().collect()] == [2]
    assert sorted(r["trace_id"] for r in trace.fates().collect()) == ["s:1", "s:3"]
    both = trace.union(trace)
    assert both.rows().count() == 2


# Secrets


def test_redact_text(spark):
    text = "token=abc;x password: hunter2, Bearer xyz and api_key = k1 and MYLONGSECRET"
    df = spark.createDataFrame([(text,), (None,), ("plain",)], "t string")
    out = observe.redact(df, ["t"], {"s": "MYLONGSECRET", "short": "k1", "none": ""}, matched="m").collect()
    assert out[0]["t"] == (
        "token=***REDACTED***;x password: ***REDACTED***, Bearer ***REDACTED*** "
        "and api_key = ***REDACTED*** and ***REDACTED***"
    )
    assert out[0]["m"] == ["s", "short"] and out[1]["t"] is None and out[2]["t"] == "plain"
    five = observe.redact(spark.createDataFrame([("see ab12z there",)], "t string"), ["t"], {"five": "ab12z"})
    assert "ab12z" not in five.first()["t"]


def test_redaction_counts(spark):
    df = spark.createDataFrame([("token=a token=b",), ("none",)], "t string")
    got = by(observe.redaction_counts(df, ["t"], {"n": "one"}), "name")
    assert (got["assignment"]["matches"], got["assignment"]["rows"]) == (2, 1)
    assert got["n"]["matches"] == 1


def test_secret_literals(spark):
    config = {
        "password": "p",
        "user": "u",
        "nested": {"API_TOKEN": "t", "secret": "secret://X", "token": "", "api_key": 5},
        "list": [{"access_key": "k"}, "plain"],
        "private_key": {"inner": "ok", "password": "deep"},
    }
    df = spark.createDataFrame([(1, json.dumps(config)), (2, "not json"), (3, None)], "id int, c string")
    expected = [
        "config.list[0].access_key",
        "config.nested.API_TOKEN",
        "config.password",
        "config.private_key.password",
    ]
    assert sorted(r["path"] for r in observe.secret_literals(df, "c", ["id"]).collect()) == expected


def test_secret_literals_of_any_depth_and_of_no_json(spark):
    deep = '{"a":[' * 250 + '{"password": "x\\u0041y", "n": [1, "{", {"to\\u006ben": "abc"}]}' + "]}" * 250
    rows = [(1, deep), (2, '{"password": "x"'), (3, None), (4, "[]"), (5, '"password"'), (6, '{"password": ["a", "b"], "k": {"secret": "z"}}')]
    df = spark.createDataFrame(rows, "id int, c string")
    found = {(r["id"], r["path"], r["value_length"]) for r in observe.secret_literals(df, "c", ["id"]).collect()}
    inner = "config" + ".a[0]" * 250
    assert found == {(1, f"{inner}.password", 3), (1, f"{inner}.n[2].token", 3), (6, "config.k.secret", 1)}
    assert [(r["id"], r["problem"]) for r in observe.unparsable(df, "c", ["id"]).collect()] == [(2, "no JSON in c")]


def test_secrets_that_hold_each_other(spark):
    df = spark.createDataFrame([("xabcdefx abc abcd RED",), ("a.c a+c (abc)",), (None,)], "t string")
    secrets = {"a": "abc", "b": "abcdef", "z": "RED", "m": "a+c", "n": "***"}
    got = [r["t"] for r in observe.redact(df, ["t"], secrets, patterns=()).collect()]
    m = "***REDACTED***"
    assert got == [f"x{m}x {m} {m}d {m}", f"a.c {m} ({m})", None]



# Plans


def test_plan_nodes_of_a_real_plan(spark):
    joined = spark.range(100).join(spark.range(100).withColumnRenamed("id", "b"), F.col("id") == F.col("b"))
    text = outputs.explain_text(joined)
    df = spark.createDataFrame([("r", text)], "run string, text string")
    nodes = plans.plan_nodes(df, ["run"])
    assert {r["phase"] for r in nodes.collect()} == {"parsed", "analyzed", "optimized", "physical"}
    physical = nodes.where("phase = 'physical'")
    assert physical.where("join_strategy = 'broadcast'").count() > 0
    assert nodes.where("normalized rlike '#[0-9]'").count() == 0


def test_every_line_of_a_plan_tree_is_a_node(spark):
    from catalog import plan_texts

    for text in (plan_texts.JOINED, plan_texts.WINDOWED, plan_texts.UNITED):
        df = spark.createDataFrame([("r", text)], "run string, text string")
        nodes = plans.plan_nodes(df, ["run"]).collect()
        trees = [part.split("\n")[1:] for part in text.split("\n\n")]
        trees[1] = trees[1][1:]  # the column types of the analyzed plan
        lines = [line for tree in trees for line in tree if "== " not in line]
        assert [n["raw"] for n in nodes] == [line.rstrip() for line in lines]
        marks = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        assert [n["depth"] * 3 for n in nodes] == marks
    joined = plans.plan_nodes(spark.createDataFrame([("r", plan_texts.JOINED)], "run string, text string"), ["run"])
    physical = [(n["operator"], n["depth"], n["join_strategy"], n["partitioning"]) for n in joined.where("phase = 'physical'").collect()]
    assert ("SortMergeJoin", 5, "sort_merge", None) in physical and physical.count(("Exchange", 7, None, 8)) == 2
    assert sum(o == "FileScan" for o, *_ in physical) == 2 and sum(o == "HashAggregate" for o, *_ in physical) == 2


@pytest.mark.parametrize("how,count", [("hashpartitioning(coalesce(a#1, 0), 200)", 200), ("RoundRobinPartitioning(8)", 8), ("rangepartitioning(a#1 ASC NULLS FIRST, 50)", 50), ("SinglePartition", 1)])
def test_partition_counts(spark, how, count):
    df = spark.createDataFrame([("r", f"Exchange {how}, REPARTITION_BY_NUM, [plan_id=7]")], "run string, text string")
    assert plans.plan_nodes(df, ["run"]).first()["partitioning"] == count


def test_plan_details_and_changes(spark):
    before = "== Physical Plan ==\nSort [id#1]\n+- Exchange hashpartitioning(id#1, 200), [id=12]\n   +- Filter x"
    after = "== Physical Plan ==\nSort [id#7]\n+- Exchange hashpartitioning(id#7, 50), [id=99]"
    nodes = [
        plans.plan_nodes(spark.createDataFrame([(1, t)], "k int, text string"), ["k"]) for t in (before, after)
    ]
    exchange = nodes[0].where("operator = 'Exchange'").first()
    assert exchange["partitioning"] == 200 and exchange["depth"] == 1 and "[id=?]" in exchange["exchange"]
    got = by(plans.plan_changes(*nodes, ["k"]), "node_index")
    assert got[1]["op"] == "alter" and got[1]["partitioning_changed"]
    assert got[2]["op"] == "remove" and got[2]["before_operator"] == "Filter"
    changed = plans.plan_operator_changes(*nodes, ["k"]).collect()
    assert [(r["operator"], r["change"]) for r in changed] == [("Filter", "removed")]


# Hashes against other implementations


def test_spark_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for row in docs.selectExpr("text", "crc32(text) AS c", "xxhash64(text) AS x").collect():
        data = row["text"].encode()
        assert row["c"] == zlib.crc32(data)
        assert row["x"] % 2**64 == xxhash.xxh64(data, seed=42).intdigest()


def test_groups_of_two_steps_have_ids_of_their_own(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "p")], "id int, a string, b string")
    trace = observe.Trace.start(df, ["id"], "t:1")
    twice = trace.aggregate(["a", "b"]).aggregate(["a"], [{"expression": "sum(row_count)", "alias": "n"}])
    edges = {tuple(r) for r in twice.contributions().collect()}
    assert ("aggregate", "aggregate:x:p", "t\\:1:1") in edges and ("aggregate", "aggregate#2:x", "aggregate:x:p") in edges
    gone = twice.filter("a = 'y'")
    assert sorted(r["trace_id"] for r in gone.fates().collect()) == ["t\\:1:1", "t\\:1:2"]
    same = trace.aggregate(["a"], name="t:1")
    assert {r["group_id"] for r in same.contributions().collect()} == {"t\\:1#2:x", "t\\:1#2:y"}
    with pytest.raises(ValueError, match="name them apart"):
        trace.aggregate(["a"]).join(trace.aggregate(["b"]), "left.a = right.b")


def test_report_of_a_table_met_twice_and_of_nothing(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, k int")
    source = observe.Trace.start(df, ["id"], "t")
    both = source.join(source.filter("id < 4"), "left.k = right.k")
    assert [(r["step"], r["rows_in"], r["rows_out"]) for r in both.report().collect()] == [("t", 0, 9), ("filter", 9, 4), ("join", 13, 12)]
    none = source.filter("id < 0").aggregate(["k"])
    assert [(r["rows_in"], r["rows_out"]) for r in none.report().collect()] == [(0, 9), (9, 0), (0, 0)]


def test_plan_metrics_are_compared(spark):
    schema = "id int, node_index int, operator string, phase string, join_strategy string, partitioning int, exchange string, metrics map<string,int>"
    before = [(1, 0, "SortMergeJoin", "physical", "sort_merge", 200, "hashpartitioning(id, 200)", {"ms": 10}), (1, 1, "Scan", "physical", None, None, None, {"a": 1, "b": 2}), (2, 0, "Scan", "physical", None, None, None, None)]
    after = [(1, 0, "BroadcastHashJoin", "physical", "broadcast", 1, None, {"ms": 4}), (1, 1, "Scan", "physical", None, None, None, {"b": 2, "a": 1}), (2, 0, "Scan", "physical", None, None, None, {"ms": 1})]
    got = {(r["id"], r["node_index"]): r for r in plans.plan_changes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ["id"]).collect()}
    assert set(got) == {(1, 0), (2, 0)}
    join = got[1, 0]
    assert (join["op"], join["after_metrics"], join["metrics_changed"], join["exchange_changed"], join["partitioning_changed"]) == ("replace", '{"ms":4}', True, True, True)
    assert (got[2, 0]["op"], got[2, 0]["metrics_changed"]) == ("alter", True)


def _line_ends(text, end):
    return text.replace("\n", end)


def test_plan_nodes_of_other_line_ends(spark):
    """Line ends, ids and sections are told apart as before, each section's first line once a text."""
    from catalog import plan_texts

    text = "== Physical Plan ==\r\nScan a#1L, id=2, valid=3, plan_id=4  \r\n+- Exchange SinglePartition, [plan_id=5], x#6plan_id=7\n \r\nNot [a node]\n== Optimized Logical Plan ==\nJoin x#8"
    rows = plans.plan_nodes(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string"), ["k"]).orderBy("node_index").collect()
    assert [(r.k, r.node_index, r.operator, r.line, r.phase, r.depth) for r in rows] == [
        (1, 0, "Scan", 2, "physical", 0), (1, 1, "Exchange", 3, "physical", 1), (1, 2, "Join", 7, "optimized", 0)
    ]
    assert rows[0].normalized == "Scan a#?, id=?, valid=3, plan_id=?"
    assert rows[1].exchange == "Exchange SinglePartition, [plan_id=?], x#?plan_id=7" and rows[1].partitioning == 1
    unix, dos = (
        plans.plan_nodes(spark.createDataFrame([(1, _line_ends(plan_texts.JOINED, end))], "k int, text string"), ["k"]) for end in ("\n", "\r\n")
    )
    assert unix.exceptAll(dos).count() == 0 and dos.exceptAll(unix).count() == 0
    physical = unix._jdf.queryExecution().optimizedPlan().toString()
    assert physical.count("aggregate(") == 1 and "zip_with" in physical


@pytest.mark.parametrize("of", ["changes", "operators", "problems", "nodes"])
def test_pairs_meet_in_many_small_tasks(spark, of):
    """Rows that a grouping hardly shrinks are dealt first, to more tasks than the session's partitions."""
    node = spark.createDataFrame([(1, 0, "Scan", "physical", None, None, None)], "k int, node_index int, operator string, phase string, join_strategy string, partitioning int, exchange string")
    pairs = spark.createDataFrame([("a", "b")], "left_run string, right_run string")
    schema = "run_id string, node_id int, schema array<struct<name:string,type:string,nullable:boolean>>, profile array<struct<column:string,count:bigint>>"
    df = {
        "changes": lambda: plans.plan_changes(node, node, ["k"]),
        "operators": lambda: plans.plan_operator_changes(node, node, ["k"]),
        "problems": lambda: observe.problem_changes(spark.createDataFrame([("a", "m")], "run_id string, message string"), pairs),
        "nodes": lambda: observe.node_snapshots(spark.createDataFrame([("a", 1, None, None)], schema), pairs),
    }[of]()
    many = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert f", {many}), REPARTITION_BY_NUM" in text
    assert not any("ENSURE_REQUIREMENTS" in line and "hashpartitioning" in line for line in text.split("\n"))


def test_sums_of_tasks_are_not_told_per_value(spark, tmp_path):
    """Only metrics whose spread is told give a row each; the sums of the others are right beside them."""
    end = '{"Event":"SparkListenerTaskEnd","Stage ID":1,"Task Info":{"Launch Time":0,"Finish Time":%d},"Task Metrics":{"Executor CPU Time":%d,"JVM GC Time":%d,"Output Metrics":{"Bytes Written":%d}}}'
    lines = spark.createDataFrame([(end % v,) for v in ((5, 1, 2, 3), (5, 10, 20, 30), (7, 100, 200, 300))], "value string")
    df = observe.stage_summary(lines)
    row = df.first()
    assert (row.task_count, row.executor_cpu_time_ns, row.gc_time_ms, row.output_bytes, row.median_task_ms, row.scheduler_delay_ms) == (3, 111, 222, 333, 5, 17)
    assert "struct(metric, executor_cpu_time_ns" not in df._jdf.queryExecution().analyzed().toString()


def test_log_lines_are_parsed_once(spark, tmp_path):
    """Neither the check of the event nor the summary reads a line a second time; the summary is made from stored tasks."""
    from pipeops.observe import stages

    values = [(3 * i * i) % 101 - 7 for i in range(60)]
    lines = spark.createDataFrame(
        [("a", submitted(1, "n")), ("b", submitted(2, "m")), ("b", submitted(2, "k"))]
        + [(a, task(1, v, 0, **{"Input Metrics": {"Bytes Read": v * 2**40 + i % 2}})) for a in "ab" for i, v in enumerate(values)],
        "app string, value string",
    )
    parsed = stages._records(lines, "value", True)._jdf.queryExecution().optimizedPlan().toString()
    assert parsed.count("from_json(") == 1
    df = observe.stage_summary(lines, merge_attempts=True)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in text and "Join" in text
    got = {(r.app, r.stage_id): r for r in df.collect()}
    durations, read = sorted(max(v, 0) for v in values), sorted(v * 2**40 + i % 2 for i, v in enumerate(values))
    for app in "ab":
        row = got[app, 1]
        assert (row.task_count, row.max_task_ms, row.p95_task_ms) == (60, durations[-1], durations[56])
        assert row.median_task_ms == (durations[29] + durations[30]) / 2
        assert (row.median_input_bytes, row.p95_input_bytes, row.max_input_bytes) == ((read[29] + read[30]) / 2, read[56], read[-1])
        assert (row.input_bytes, row.name) == (sum(read), "n" if app == "a" else "")
    assert (got["b", 2].name, got["b", 2].task_count, got["b", 2].p95_input_bytes) == ("m", 0, 0)


def test_quantiles_do_not_shuffle_their_input(spark):
    """Values meet the cells of their group where they are read; only counts are shuffled. Counts may be given."""
    from pipeops.functions import exact_quantiles

    df = spark.range(4000).selectExpr("id % 3 AS k", "CASE WHEN id % 5 > 0 THEN id * id END AS v", "id % 4 AS c")
    ranks = {"low": F.floor((F.col("n") + 1) / 2), "last": F.col("n"), "none": F.lit(None)}
    result = exact_quantiles(df, ["k"], "v", ranks, count="c")
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    for k, low, last, none in result.collect():
        group = sorted(i * i for i in range(k, 4000, 3) if i % 5 for _ in range(i % 4))
        assert (low, last, none) == (group[(len(group) + 1) // 2 - 1], group[-1], None)


def test_event_log_of_line_items(spark, tmp_path):
    """The log is put in folders without sorting its texts, by a fast codec; a line item without a flag has no application."""
    from catalog.observe_queries import event_log

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    rows = [(1, 2, 3, 4, 5.5, 99.9, flag, "F") for flag in ("R", "N", None, "R", "")]
    spark.createDataFrame(rows, line).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(7, "N7")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    log = event_log(spark, str(tmp_path))
    got = [(r.app, json.loads(r.value)) for r in log.collect()]
    assert sorted((a, v["Event"][13:]) for a, v in got) == [("", "TaskEnd"), ("", "TaskEnd"), ("app-N", "TaskEnd"), ("app-R", "StageSubmitted"), ("app-R", "TaskEnd"), ("app-R", "TaskEnd")]
    assert all(v["Stage ID"] == 4 and v["Task Info"] == {"Launch Time": 1000, "Finish Time": 1099} for _, v in got if "Task Info" in v)
    assert all(f.endswith(".txt.lz4") for f in log.inputFiles())


def test_plans_dealt_by_their_key_meet_without_a_shuffle_of_nodes(spark):
    """Texts dealt by their key are taken apart and compared in place, with the same changes; what is not asked for is not made."""
    from catalog import plan_texts
    from pipeops import operators as ops

    def nodes(texts, by):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (1, texts[2])], "k int, text string")
        return plans.plan_nodes(ops.dealt(df, ["k"]) if by else df, ["k"])

    one = [plan_texts.JOINED, plan_texts.WINDOWED, plan_texts.UNITED]
    changes = [plans.plan_changes(nodes(one, by), nodes(one[1:] + one[:1], by), ["k"], together=by) for by in (False, True)]
    assert changes[0].count() > 0 and changes[0].exceptAll(changes[1]).count() == 0 and changes[1].exceptAll(changes[0]).count() == 0
    plan = changes[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k#") == 2 and "node_index" not in "".join(x for x in plan.split("\n") if "Exchange hash" in x)
    # ids are blanked in exchanges alone where only those are compared
    assert plan.count("id=(?<=") == 2 and "normalized" not in plan
    # a change is found whichever side was dealt otherwise
    apart = plans.plan_changes(nodes(one, True), nodes(one[1:] + one[:1], False), ["k"], together=True)
    assert apart.exceptAll(changes[0]).count() == 0 and changes[0].exceptAll(apart).count() == 0


def test_plan_nodes_of_odd_lines(spark):
    """Blank lines end a tree but not what stands before the first heading; headings may have blanks; places count all lines."""
    text = "Scan a\n\n+- Sort b\n=== Analyzed Logical Plan ==  \na: int\nJoin c, id=3\n  \nNot d\n== = ==\n*(1) Exchange e#4, [plan_id=5]\nlower\n\r\n== Physical Plan ==\n'Filter\r"
    df = spark.createDataFrame([(1, text), (2, "\r"), (3, "== Physical Plan ==\n\nScan"), (4, "Scan\r")], "k int, text string")
    rows = plans.plan_nodes(df, ["k"]).orderBy("k", "node_index").collect()
    assert [(r.k, r.node_index, r.operator, r.line, r.phase, r.depth, r.raw) for r in rows] == [
        (1, 0, "Scan", 1, "unknown", 0, "Scan a"),
        (1, 1, "Sort", 3, "unknown", 1, "+- Sort b"),
        (1, 2, "Join", 6, "analyzed", 0, "Join c, id=3"),
        (1, 3, "Exchange", 10, "unknown", 0, "*(1) Exchange e#4, [plan_id=5]"),
        (1, 4, "Filter", 14, "physical", 0, "'Filter\r"),
        (4, 0, "Scan", 1, "unknown", 0, "Scan\r"),
    ]
    assert (rows[2].normalized, rows[3].exchange, rows[3].normalized) == ("Join c, id=?", "Exchange e#?, [plan_id=?]", "*(1) Exchange e#?, [plan_id=?]")


def test_conditions_on_nodes_do_not_take_texts_apart_again(spark):
    """A condition on what is told of a node is tested at the node alone."""
    from catalog import plan_texts

    nodes = plans.plan_nodes(spark.createDataFrame([(1, plan_texts.JOINED)], "k int, text string"), ["k"])
    some = nodes.where("phase = 'physical' AND operator = 'SortMergeJoin' AND join_strategy = 'sort_merge' AND raw LIKE '%Inner' AND depth = 5 AND line > 30")
    assert [(r.operator, r.depth) for r in some.collect()] == [("SortMergeJoin", 5)]
    steps, whole = (df._jdf.queryExecution().optimizedPlan().toString().count("transform(") for df in (some, nodes))
    assert steps == whole
