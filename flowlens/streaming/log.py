"""Streaming views: delivery dedup, hourly throughput, silent attempts, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def deduplicated_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event of a workflow once, by sequence, with state kept no longer than ``late``."""
    timed = events.withColumn("event_time", F.timestamp_millis("created_at"))
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["workflow_id", "sequence"])


def streaming_throughput(activities: DataFrame, late: str = "1 hour") -> DataFrame:
    """Completions by topic in tumbling hours; equals the batch metric once the stream has caught up."""
    timed = activities.where("completed_at IS NOT NULL").withColumn("event_time", F.timestamp_millis("completed_at")).withWatermark("event_time", late)
    out = timed.groupBy("topic", F.window("event_time", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("completed"))
    return out.select("topic", F.unix_millis("w.start").alias("bucket_start"), "completed")


def silent_attempts(heartbeats: DataFrame, now: int, silence: int) -> DataFrame:
    """Open attempts whose latest heartbeat is ``silence`` or more before ``now``. Heartbeats are appended; the latest counts."""
    last = heartbeats.groupBy("activity_id", "attempt_number").agg(F.max("heartbeat_at").alias("heartbeat_at"), F.max(F.col("finished_at").isNotNull()).alias("over"))
    return last.where(~F.col("over") & (F.col("heartbeat_at") <= now - silence)).select("activity_id", "attempt_number", "heartbeat_at")


def replay(events: DataFrame, commands: DataFrame) -> DataFrame:
    """``workflow_id, applied, failure``: fold each workflow's deliverable events in order; fail closed.

    ``commands``: ``workflow_id, command_sequence, kind`` that the code would issue. An event for a command that was
    never issued, a gap or a repeat in the delivery order is a failure, and nothing behind it is applied.
    """
    order = F.col("delivery_sequence")
    seq = F.coalesce(F.get_json_object("metadata_json", "$.data.command_sequence").cast("int"), F.lit(0))
    own = commands.groupBy("workflow_id").agg(F.collect_set("command_sequence").alias("issued"))
    log = events.where("delivery_sequence IS NOT NULL").groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("d"), seq.alias("c"), "event_type"))).alias("log"))
    j = log.join(own, "workflow_id", "left")
    wrong = lambda x, i: F.when(x["d"] != i + 1, "delivery_order").when((x["c"] > 0) & ~F.coalesce(F.array_contains("issued", x["c"]), F.lit(False)), "unknown_command")
    marks = F.transform("log", wrong)
    first = F.array_position(F.transform(marks, lambda m: m.isNotNull()), True)
    return j.select("workflow_id", F.when(first == 0, F.size("log")).otherwise(first - 1).cast("long").alias("applied"), F.when(first > 0, F.get(marks, (first - 1).cast("int"))).alias("failure"))
