"""Streams over several micro-batches: late data, replays, state and refresh."""

import datetime

import pytest
from pyspark.sql import functions as F

from pipeops import operators as ops
from pipeops import outputs, sources, streaming


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def write(spark, folder, number, rows, ddl):
    """One file per call, so that each is a micro-batch of its own."""
    df = spark.createDataFrame(rows, ddl).coalesce(1)
    df.write.mode("append").parquet(str(folder))


def stream(spark, folder, ddl):
    return sources.read_file(
        spark, str(folder), "parquet", streaming=True, schema=ddl, options={"maxFilesPerTrigger": 1}
    )


EVENTS = "k int, ts timestamp"


def test_late_rows_are_dropped(spark, tmp_path):
    feed = tmp_path / "feed"
    for i, rows in enumerate(([(1, at(5))], [(1, at(60))], [(1, at(7)), (1, at(61))])):
        write(spark, feed, i, rows, EVENTS)
        marked = streaming.watermark(stream(spark, feed, EVENTS), "ts", "10 minutes")
        counts = ops.aggregate(marked, ["window(ts, '10 minutes')"], [{"expression": "count(*)", "alias": "n"}])
        flat = counts.select(F.minute("window.start").alias("m"), "n")
        out = streaming.drain(flat, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    # Minute 7 came after the watermark (50) had closed its window.
    assert [(r["m"], r["n"]) for r in out.collect()] == [(0, 1)]


def test_dedup_across_batches(spark, tmp_path):
    feed = tmp_path / "feed"
    for i, rows in enumerate(([(1, at(0)), (2, at(0))], [(1, at(3)), (3, at(4))], [(2, at(5))])):
        write(spark, feed, i, rows, EVENTS)
        unique = streaming.deduplicate_event_time(stream(spark, feed, EVENTS), ["k"], "ts", "1 hour")
        out = streaming.drain(unique, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3]


CHANGES = "id int, seq int, op string, name string"
FEED = [
    [(1, 1, "u", "a1"), (2, 1, "u", "b1"), (3, 1, "u", "c1")],
    [(1, 5, "d", "gone"), (2, 3, "u", "b3")],
    [(1, 4, "u", "late"), (2, 2, "u", "old"), (3, 1, "d", "tie")],
    [(4, 1, "u", "d1")],
]
AFTER = [(2, 3, "b3"), (4, 1, "d1")]
CONFIG = {"keys": ["id"], "sequence_by": "seq", "apply_as_deletes": "op = 'd'"}


def table_of(df):
    return sorted((r["id"], r["seq"], r["name"]) for r in df.collect())


def test_cdc_batch(spark):
    changes = spark.createDataFrame([row for batch in FEED for row in batch], CHANGES)
    assert table_of(outputs.cdc_scd1(changes, **CONFIG)) == AFTER


@pytest.mark.parametrize("compact_every", [1, 2, 50])
def test_cdc_stream(spark, tmp_path, compact_every):
    """A late older change does not bring a deleted key back."""
    target = outputs.CdcTarget(str(tmp_path / "target"), compact_every=compact_every, **CONFIG)
    for i, rows in enumerate(FEED):
        write(spark, tmp_path / "feed", i, rows, CHANGES)
        now = target.run(stream(spark, tmp_path / "feed", CHANGES), str(tmp_path / "checkpoint"))
    assert table_of(now) == AFTER


def test_cdc_replay_of_a_batch(spark, tmp_path):
    target = outputs.CdcTarget(str(tmp_path / "target"), compact_every=2, **CONFIG)
    batches = [spark.createDataFrame(rows, CHANGES) for rows in FEED]
    for number, batch in enumerate(batches):
        target.write_batch(batch, number)
        target.write_batch(batch, number)
    assert table_of(target.read(spark, batches[0].schema)) == AFTER


def test_streaming_table_takes_new_input_only(spark, tmp_path):
    feed, home = tmp_path / "feed", tmp_path / "table"
    name = f"t_{tmp_path.name.replace('-', '_')}"
    for i in range(3):
        write(spark, feed, i, [(i, at(i))], EVENTS)
        stored = outputs.streaming_table(
            stream(spark, feed, EVENTS), name, str(tmp_path / "checkpoint"), str(home)
        )
        assert sorted(r["k"] for r in stored.collect()) == list(range(i + 1))


def test_refresh(spark, tmp_path):
    feed, home = tmp_path / "feed", str(tmp_path / "home")
    suffix = tmp_path.name.replace("-", "_")
    raw, total = f"raw_{suffix}", f"total_{suffix}"
    offset = {"by": 0}
    datasets = [
        outputs.Dataset(
            raw,
            "streaming_table",
            lambda s: stream(s, feed, EVENTS).withColumn("k", F.col("k") + offset["by"]),
        ),
        outputs.Dataset(
            total,
            "materialized_view",
            lambda s: ops.aggregate(s.read.table(raw), [], [{"expression": "sum(k)", "alias": "total"}]),
        ),
    ]

    def now():
        return spark.read.table(total).first()["total"]

    write(spark, feed, 0, [(1, at(0))], EVENTS)
    assert outputs.refresh(spark, datasets, home) == [raw, total]
    assert now() == 1
    write(spark, feed, 1, [(2, at(1))], EVENTS)
    offset["by"] = 100
    assert outputs.refresh(spark, datasets, home, selected=[total]) == [total]
    assert now() == 1
    outputs.refresh(spark, datasets, home)
    assert now() == 1 + 102  # only the new row went through the new code
    outputs.refresh(spark, datasets, home, full=[raw], selected=[total])
    assert now() == 101 + 102
    outputs.refresh(spark, datasets, home)
    assert now() == 101 + 102
    outputs.refresh(spark, datasets, home, full_all=True)
    assert now() == 101 + 102
    with pytest.raises(ValueError, match="unknown"):
        outputs.refresh(spark, datasets, home, selected=["nope"])


def test_modes_are_checked(spark, tmp_path):
    folder = tmp_path / "feed"
    write(spark, folder, 0, [(1, at(0))], EVENTS)
    live, batch = stream(spark, folder, EVENTS), spark.range(1)
    with pytest.raises(ValueError, match="batch input"):
        outputs.materialized_view(live, "x")
    with pytest.raises(ValueError, match="streaming input"):
        outputs.streaming_table(batch, "x", "c")
    with pytest.raises(ValueError, match="streaming input"):
        outputs.external_sink(batch, "x", "json", "c")
    with pytest.raises(ValueError, match="preview the table"):
        outputs.preview(live)
    with pytest.raises(ValueError, match="limit"):
        outputs.preview(batch, 500)


def test_preview_is_bounded(spark):
    assert outputs.preview(spark.range(1000), 20).count() == 20
    assert outputs.preview(spark.range(1000), 200, 0.05, seed=3).count() <= 200


def test_stream_stream_left_join_gives_unmatched_rows(spark, tmp_path):
    for side, rows in (("buys", [(1, at(0)), (2, at(1)), (3, at(600))]), ("clicks", [(1, at(-5)), (9, at(600))])):
        write(spark, tmp_path / side, 0, rows, EVENTS)
    buys, clicks = (
        streaming.watermark(stream(spark, tmp_path / side, EVENTS), "ts", "1 hour") for side in ("buys", "clicks")
    )
    near = "left.k = right.k AND right.ts BETWEEN left.ts - INTERVAL '1 hour' AND left.ts"
    joined = ops.join(buys, clicks, near, "left").select("k", "right_k")
    out = streaming.drain(joined, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    # The purchase at minute 600 may still find a click; the watermark has not passed it.
    assert sorted((r["k"], r["right_k"]) for r in out.collect()) == [(1, 1), (2, None)]


def test_kafka_decode(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01' AS timestamp, CAST('x' AS BINARY) AS value UNION ALL SELECT NULL, NULL")
    assert [r["payload"] for r in sources.decode_kafka(rows).collect()] == ["x"]


def test_append_flows_share_a_target(spark, tmp_path):
    for flow in ("a", "b"):
        write(spark, tmp_path / flow, 0, [(1 if flow == "a" else 2, at(0))], EVENTS)
        for _ in range(2):
            outputs.append_flow(
                stream(spark, tmp_path / flow, EVENTS), str(tmp_path / "target"), flow, str(tmp_path / "checkpoints")
            )
    got = outputs.read_flows(spark, str(tmp_path / "target"), EVENTS)
    assert sorted((r["flow"], r["k"]) for r in got.collect()) == [("a", 1), ("b", 2)]


def ten_batches(spark, feed):
    """Ten files of an hour each; late rows are within the delay."""
    for i in range(10):
        rows = [(k, at(60 * i + m)) for k in range(3) for m in (0, 20, 40)] + ([(9, at(60 * i - 10))] if i else [])
        write(spark, feed, i, rows, EVENTS)


def state_rows(seen):
    return lambda query: seen.extend(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"])


@pytest.mark.parametrize("mode", ["append", "update"])
def test_state_stays_flat_over_ten_batches(spark, tmp_path, mode):
    feed, seen = tmp_path / "feed", []
    ten_batches(spark, feed)
    counts = [{"expression": "count(*)", "alias": "n"}]

    def build(source):
        windows = ops.aggregate(streaming.watermark(source, "ts", "30 minutes"), ["k", "window(ts, '20 minutes')"], counts)
        return windows.select("k", F.unix_timestamp("window.start").alias("start"), "n")

    where = (str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    if mode == "update":
        out = streaming.drain_updates(build(stream(spark, feed, EVENTS)), ["k", "start"], *where, finished=state_rows(seen), buckets=3, compact_every=4)
    else:
        closing = str(tmp_path / "closing")
        streaming.drain(build(streaming.with_closing_rows(stream(spark, feed, EVENTS), closing)), *where, finished=state_rows(seen))
        streaming.close(spark, closing, stream(spark, feed, EVENTS).schema, [{"ts": at(100_000)}])
        out = streaming.drain(build(streaming.with_closing_rows(stream(spark, feed, EVENTS), closing)), *where)
    batch = spark.read.schema(EVENTS).parquet(str(feed))
    want = batch.groupBy("k", F.window("ts", "20 minutes").alias("w")).count().select("k", F.unix_timestamp("w.start"), "count")
    assert sorted(map(tuple, out.select("k", "start", "n").collect())) == sorted(map(tuple, want.collect()))
    assert len(seen) >= 10 and max(seen[2:]) <= 2 * seen[1]


def test_cdc_compaction_leaves_other_buckets_alone(spark, tmp_path):
    target = outputs.CdcTarget(str(tmp_path / "t"), ["id"], "seq", compact_every=1, buckets=8)
    schema = "id int, seq int, name string"
    everything = spark.range(200).selectExpr("CAST(id AS INT) AS id", "1 AS seq", "'old' AS name")
    target.write_batch(everything, 0)
    _, first = target._manifest(spark)
    assert set(first.values()) == {0} and len(first) == 8
    target.write_batch(spark.createDataFrame([(7, 2, "new")], schema), 1)
    last, second = target._manifest(spark)
    moved = [b for b, g in second.items() if g == 1]
    assert last == 1 and len(moved) == 1 and set(second.values()) == {0, 1}
    written = [p.name for p in (tmp_path / "t" / "bases" / "generation=1").glob("__bucket=*")]
    assert written == [f"__bucket={moved[0]}"]
    now = target.read(spark, everything.schema)
    assert now.count() == 200 and now.where("name = 'new'").first()["id"] == 7
    # what a later compaction of all buckets leaves behind is emptied
    for number in (2, 3, 4):
        target.write_batch(everything.withColumn("seq", F.lit(number + 1)), number)
    assert target.read(spark, everything.schema).where("seq = 5").count() == 200
    assert not list((tmp_path / "t" / "bases" / "generation=0").glob("__bucket=*"))
    assert spark.read.schema("id int").parquet(str(tmp_path / "t" / "batches" / "batch=0")).count() == 0
