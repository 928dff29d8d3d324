"""Topic and schedule metrics. Each is one pass over the activities with a small dimension joined in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import HOUR, hour_start, live_lease, shown_available_at
from ..sources.schemas import SLOT_HOLDERS, TERMINAL


def chain_root() -> Column:
    return F.coalesce(F.col("root_activity_id"), F.col("id"))


def unresolved_dead_letters(act: DataFrame) -> DataFrame:
    """Dead letters whose chain of corrections has no success. The coalesced key keeps this a hash join."""
    resolved = act.where(F.col("status") == "succeeded").select(chain_root().alias("__root")).distinct()
    return act.where(F.col("status") == "dead_lettered").join(resolved, chain_root() == F.col("__root"), "left_anti")


def open_dead_letters(act: DataFrame, wf: DataFrame) -> DataFrame:
    """Unresolved dead letters of workflows that have not ended."""
    going = wf.where(~F.col("status").isin(TERMINAL)).select(F.col("id").alias("__wf"))
    return unresolved_dead_letters(act).join(going, F.col("workflow_id") == F.col("__wf"), "left_semi")


def awaited(act: DataFrame, wf: DataFrame) -> DataFrame:
    """Pending activities that their workflow is waiting for right now."""
    waits = wf.where(F.col("status") == "waiting_activity").select(F.col("id").alias("__wf"), F.col("wait_reference_id").alias("__act"))
    return act.where(F.col("status") == "pending").join(waits, (F.col("workflow_id") == F.col("__wf")) & (F.col("id") == F.col("__act")), "left_semi")


def topic_metrics(topics: DataFrame, act: DataFrame, wf: DataFrame, att: DataFrame, caps: DataFrame, now: int) -> DataFrame:
    """One row for each registered topic (``topic, configured_max``), with zeros where nothing is stored."""
    active = act.where(F.col("status").isin(SLOT_HOLDERS) & live_lease(now))
    current = active.join(att.select(F.col("activity_id").alias("__a"), F.col("attempt_number").alias("__n"), "started_at"), (F.col("id") == F.col("__a")) & (F.col("attempt_count") == F.col("__n")), "left")
    running = current.groupBy("topic").agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "cancelling").alias("cancelling"), F.min("started_at").alias("oldest_started"))
    due = F.col("available_at") <= now
    waiting = awaited(act, wf).groupBy("topic").agg(
        F.count_if(due).alias("ready"), F.count_if(~due & (F.col("attempt_count") > 0)).alias("retry_scheduled"), F.min(F.when(due, shown_available_at())).alias("oldest_ready")
    )
    dead = open_dead_letters(act, wf).groupBy("topic").agg(F.count(F.lit(1)).alias("dead_letters"))
    out = topics.join(caps.select("topic", F.col("max_concurrency").alias("stored_max")), "topic", "left")
    for part in (running, waiting, dead):
        out = out.join(part, "topic", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    most = F.coalesce("stored_max", "configured_max")
    age = lambda c: F.greatest(F.lit(now) - F.col(c), F.lit(0)).cast("long")
    return out.select(
        "topic", most.cast("long").alias("max_concurrency"), F.col("configured_max").cast("long").alias("configured_max"),
        (~F.col("stored_max").eqNullSafe(F.col("configured_max"))).alias("configuration_mismatch"), zero("active"),
        F.greatest(most - F.coalesce("active", F.lit(0)), F.lit(0)).cast("long").alias("available"), zero("ready"), zero("retry_scheduled"), zero("dead_letters"),
        F.when(F.col("oldest_ready").isNotNull(), age("oldest_ready")).alias("oldest_ready_age"), F.when(F.col("oldest_started").isNotNull(), age("oldest_started")).alias("oldest_active_age"),
    )


def hourly_throughput(topics: DataFrame, act: DataFrame, now: int) -> DataFrame:
    """``topic, bucket_start, completed`` for the 24 hours up to and with ``now``'s; all that completed counts, however it ended."""
    first = now - now % HOUR - 23 * HOUR
    done = act.where((F.col("completed_at") >= first) & (F.col("completed_at") < now + 1)).groupBy("topic", hour_start(F.col("completed_at")).alias("bucket_start")).agg(F.count(F.lit(1)).alias("completed"))
    hours = topics.select("topic", F.explode(F.sequence(F.lit(first), F.lit(first + 23 * HOUR), F.lit(HOUR))).alias("bucket_start"))
    return hours.join(done, ["topic", "bucket_start"], "left").select("topic", "bucket_start", F.coalesce("completed", F.lit(0)).cast("long").alias("completed"))


def recent_runs(runs: DataFrame, wf: DataFrame, most: int = 5) -> DataFrame:
    """The latest ``most`` runs of each schedule, with the state of the workflow that each started.

    A bounded heap for each key, kept while rows are read, so a schedule with most of the runs is no large sort.
    """
    if not 1 <= most <= 20:
        raise ValueError("recent runs must be between 1 and 20")
    w = W.partitionBy("schedule_key").orderBy(F.desc("scheduled_for"), F.desc("id"))
    top = runs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    state = wf.select(F.col("id").alias("__wf"), F.col("status").alias("workflow_status"), F.col("completed_at").alias("workflow_completed_at"))
    joined = top.join(state, F.col("workflow_id") == F.col("__wf"), "left")
    return joined.select("schedule_key", "rn", "id", "local_occurrence", "scheduled_for", "status", "reason", "workflow_id", "workflow_status", "workflow_completed_at")


def schedule_summary(registry: DataFrame, states: DataFrame, runs: DataFrame, wf: DataFrame) -> DataFrame:
    """One row for each schedule that is registered (``schedule_key, fingerprint, version``) or stored, with counts and what is wrong with it."""
    going = wf.where(~F.col("status").isin(TERMINAL)).select(F.col("schedule_run_id").alias("__run"))
    overlap = runs.select("id", "schedule_key").join(going, F.col("id") == F.col("__run")).groupBy("schedule_key").agg(F.count(F.lit(1)).alias("active_overlap"))
    counts = runs.groupBy("schedule_key").agg(
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "coalesced").alias("coalesced"), F.max(F.struct("scheduled_for", "id")).alias("last")
    )
    drift = definition_drift(registry, states)
    return (
        drift.join(counts, "schedule_key", "left").join(overlap, "schedule_key", "left")
        .select("schedule_key", "issue", "paused", "next_occurrence_at", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("active_overlap", "skipped", "coalesced")], F.col("last.id").alias("last_run_id"))
    )


def definition_drift(registry: DataFrame, states: DataFrame) -> DataFrame:
    """Registered and stored schedules side by side: ``missing_state``, ``unregistered_state``, ``definition_mismatch`` or no issue."""
    r = registry.select("schedule_key", F.col("fingerprint"), F.col("version"), F.lit(True).alias("__r"))
    s = states.select("schedule_key", "definition_fingerprint", "definition_version", "next_occurrence_at", F.col("paused_at").isNotNull().alias("paused"), F.lit(True).alias("__s"))
    both = r.join(s, "schedule_key", "full_outer")
    differ = (F.col("fingerprint") != F.col("definition_fingerprint")) | (F.col("version") != F.col("definition_version"))
    issue = F.when(F.col("__s").isNull(), "missing_state").when(F.col("__r").isNull(), "unregistered_state").when(differ, "definition_mismatch")
    return both.select("schedule_key", issue.alias("issue"), F.coalesce("paused", F.lit(False)).alias("paused"), "next_occurrence_at")
