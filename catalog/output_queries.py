"""M1-M7: tables, change feeds, sinks, refresh and preview."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pipeops import operators as ops
from pipeops import outputs, sources
from pipeops.session import scratch

from .registry import query, table
from .streaming_queries import event_stream


def _name(label):
    return f"{label}_{uuid.uuid4().hex[:8]}"


_BY_TYPE = "SELECT event_type, count(*) AS row_count FROM events GROUP BY event_type"


@query(
    "m1_materialized_view",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey",
)
def m1_materialized_view(spark, sf):
    name = _name("spending")
    spent = ops.aggregate(
        table(spark, sf, "orders"), ["o_custkey"], [{"expression": "round(sum(o_totalprice), 2)", "alias": "spent"}]
    )
    return outputs.materialized_view(spent, name, scratch(spark, name))


@query("m2_streaming_table", _BY_TYPE)
def m2_streaming_table(spark, sf):
    """Two refreshes take the input in once; the table is then read as a stream."""
    name = _name("events_table")
    home = scratch(spark, name)
    for _ in range(2):
        outputs.streaming_table(event_stream(spark, sf), name, f"{home}/checkpoint", f"{home}/table")
    again = sources.dataset_reference(spark, name, streaming=True)
    copy = _name("events_copy")
    other = scratch(spark, copy)
    stored = outputs.streaming_table(again, copy, f"{other}/checkpoint", f"{other}/table")
    return ops.aggregate(stored, ["event_type"])


@query("m3_temporary_view", "SELECT p_brand, count(*) AS row_count FROM part WHERE p_size > 25 GROUP BY p_brand")
def m3_temporary_view(spark, sf):
    name = _name("large_parts")
    outputs.temporary_view(table(spark, sf, "part").where("p_size > 25"), name)
    return ops.aggregate(sources.dataset_reference(spark, name), ["p_brand"])


_CDC = """SELECT user_id, event_id, event_type, value FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
          WHERE rn = 1 AND event_type <> 'error'"""
_CDC_CONFIG = {"keys": ["user_id"], "sequence_by": ["ts", "event_id"], "apply_as_deletes": "event_type = 'error'"}


@query("m4_cdc_batch", _CDC)
def m4_cdc_batch(spark, sf):
    """Errors delete the user."""
    latest = outputs.cdc_scd1(table(spark, sf, "events"), **_CDC_CONFIG)
    return latest.select("user_id", "event_id", "event_type", "value")


@query("m4_cdc_stream", _CDC)
def m4_cdc_stream(spark, sf):
    """The feed arrives out of order in many micro-batches; a compaction falls in between."""
    home = scratch(spark, "cdc")
    changes = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    changes.repartition(6, "event_type", "event_id").write.parquet(f"{home}/feed")
    stream = sources.read_file(
        spark,
        f"{home}/feed",
        "parquet",
        streaming=True,
        schema=changes.schema,
        options={"maxFilesPerTrigger": 1},
    )
    target = outputs.CdcTarget(f"{home}/target", compact_every=4, buckets=8, **_CDC_CONFIG)
    latest = target.run(stream, f"{home}/checkpoint")
    return latest.select("user_id", "event_id", "event_type", "value")


@query("m5_external_sink", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def m5_external_sink(spark, sf):
    home = scratch(spark, "sink")
    bought = event_stream(spark, sf).where("event_type = 'purchase'").select("event_id", "value")
    running = outputs.external_sink(bought, _name("sink"), "json", f"{home}/checkpoint", {"path": f"{home}/out"})
    running.awaitTermination()
    return sources.read_file(spark, f"{home}/out", "json", schema=bought.schema)


@query(
    "m5_append_flows",
    """SELECT CASE WHEN event_type = 'error' THEN 'errors' ELSE 'purchases' END AS flow, event_id
       FROM events WHERE event_type IN ('error', 'purchase')""",
)
def m5_append_flows(spark, sf):
    """Two flows into one target."""
    home = scratch(spark, "flows")
    for flow, kind in (("errors", "error"), ("purchases", "purchase")):
        rows = event_stream(spark, sf).where(F.col("event_type") == kind).select("event_id")
        outputs.append_flow(rows, f"{home}/target", flow, f"{home}/checkpoints")
    return outputs.read_flows(spark, f"{home}/target", "event_id BIGINT").select("flow", "event_id")


@query("m6_refresh", _BY_TYPE)
def m6_refresh(spark, sf):
    """Incremental, incremental again, then one dataset in full: the answer stays."""
    home = scratch(spark, "refresh")
    bronze, counts = _name("bronze"), _name("counts")
    datasets = [
        outputs.Dataset(bronze, "streaming_table", lambda s: event_stream(s, sf)),
        outputs.Dataset(
            counts,
            "materialized_view",
            lambda s: ops.aggregate(sources.dataset_reference(s, bronze), ["event_type"]),
        ),
    ]
    outputs.refresh(spark, datasets, home)
    outputs.refresh(spark, datasets, home, selected=[bronze])
    outputs.refresh(spark, datasets, home, selected=[counts], full=[bronze])
    return sources.dataset_reference(spark, counts)


@query("m7_preview")
def m7_preview(spark, sf):
    """At most 200 rows of a sample: the bound is what a preview is."""
    return outputs.preview(table(spark, sf, "lineitem"), limit=200, fraction=0.5, seed=7)
