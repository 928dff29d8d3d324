"""Planners for claims, leases, timers, approvals and outcomes: ``DataFrame`` and time in, proposed changes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.exprs import backoff, correction_key, expired_lease, live_lease
from ..operators.metrics import awaited
from ..sources.schemas import SLOT_HOLDERS, START_RECOVERABLE, TERMINAL

SCAN = 32
FAIR_CONTINUES, FAIR_DELAY = 16, 100


def registered(df: DataFrame, defs: DataFrame) -> DataFrame:
    """Rows whose kind and version is in ``defs``; an empty registry leaves nothing."""
    return df.join(defs.select("kind", "version").distinct(), ["kind", "version"], "left_semi")


def in_flight(act: DataFrame, now: int, unsettled: DataFrame | None = None) -> DataFrame:
    """``topic, in_flight``: slot holders with a live lease, and expired ones of ``unsettled`` (``id``), which a heartbeat may still revive."""
    holders = act.where(F.col("status").isin(SLOT_HOLDERS))
    live = holders.where(live_lease(now))
    if unsettled is not None:
        live = live.unionByName(holders.where(expired_lease(now)).join(unsettled.select("id").distinct(), "id", "left_semi"))
    return live.groupBy("topic").agg(F.count(F.lit(1)).alias("in_flight"))


def claim_plan(act: DataFrame, wf: DataFrame, caps: DataFrame, defs: DataFrame, local: DataFrame, now: int, batch: int, scan: int = SCAN) -> DataFrame:
    """``topic, activity_id, place, decision``: what one dispatcher would claim now.

    Of each topic the first ``scan`` due candidates are looked at, in the order of availability. Those out of attempts
    are quarantined and use up the scan, not the quota. A topic's quota is what its cap leaves, at most its ``local``
    (``topic, capacity``); the batch is dealt out in the order of topics.
    """
    order = W.partitionBy("topic").orderBy("available_at", F.when(F.col("available_at") == 0, F.col("workflow_id")).otherwise(F.col("id")), "id")
    due = registered(awaited(act, wf).where(F.col("available_at") <= now), defs)
    seen = due.select("topic", "id", "workflow_id", "available_at", "attempt_count", "max_attempts").withColumn("place", F.row_number().over(order)).where(F.col("place") <= scan)
    seen = seen.withColumn("fit", F.col("attempt_count") < F.col("max_attempts"))
    seen = seen.withColumn("nth", F.sum(F.col("fit").cast("long")).over(W.partitionBy("topic").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    free = F.greatest(F.col("max_concurrency") - F.coalesce("in_flight", F.lit(0)), F.lit(0))
    quota = caps.join(local, "topic").join(in_flight(act, now), "topic", "left").select("topic", F.least(free, F.col("capacity")).cast("long").alias("quota"))
    # One row for each topic; those before it in key order have the batch first.
    wants = seen.groupBy("topic").agg(F.count_if("fit").alias("fit")).join(quota, "topic").select("topic", F.least("fit", "quota").alias("want"))
    before = F.coalesce(F.sum("want").over(W.orderBy("topic").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    gets = wants.select("topic", F.greatest(F.least(F.col("want"), F.lit(batch) - before), F.lit(0)).cast("long").alias("gets"))
    plan = seen.join(gets, "topic").where(~F.col("fit") | (F.col("nth") <= F.col("gets")))
    return plan.select("topic", F.col("id").alias("activity_id"), F.col("place").cast("long").alias("place"), F.when(F.col("fit"), "claim").otherwise("quarantine_attempt_cap").alias("decision"))


def workflow_claim_plan(wf: DataFrame, defs: DataFrame, now: int, scan: int = SCAN) -> DataFrame:
    """``workflow_id, available_at``: the ready workflows that coordinators look at, first come first served."""
    return registered(wf.where((F.col("status") == "ready") & (F.col("available_at") <= now)), defs).orderBy("available_at", "id").limit(scan).select(F.col("id").alias("workflow_id"), "available_at")


def reconcile_plan(act: DataFrame, wf: DataFrame, now: int) -> DataFrame:
    """``activity_id, from_status, to_status, reason, available_at, blocks_workflow``: what expired leases lead to.

    Cancelling ones end as cancelled, running ones with attempts left go back with a delay, others are dead letters
    and block the workflow that waits for them.
    """
    lost = act.where(F.col("status").isin(SLOT_HOLDERS) & expired_lease(now))
    waits = wf.where(F.col("status") == "waiting_activity").select(F.col("id").alias("__wf"), F.col("wait_reference_id").alias("__act"))
    j = lost.join(waits, (F.col("workflow_id") == F.col("__wf")) & (F.col("id") == F.col("__act")), "left")
    left = F.col("attempt_count") < F.col("max_attempts")
    to = F.when(F.col("status") == "cancelling", "cancelled").when(left, "pending").otherwise("dead_lettered")
    seed = F.concat(F.lit("activity:"), F.col("id").cast("string"), F.lit(":lease_recovery:"), F.col("attempt_count").cast("string"))
    # Without a valid policy the activity is due at once; the next claim then finds it out of bounds.
    again = F.lit(now) + F.coalesce(backoff(F.col("retry_policy_json"), F.col("attempt_count"), seed), F.lit(0))
    return j.select(
        F.col("id").alias("activity_id"), F.col("status").alias("from_status"), to.alias("to_status"), F.lit("lease_expired").alias("reason"),
        F.when(to == "pending", again).alias("available_at"), ((to == "dead_lettered") & F.col("__wf").isNotNull()).alias("blocks_workflow"),
    )


def recover_workflows(wf: DataFrame, now: int) -> DataFrame:
    """Running workflows whose lease has run out are ready again; without an expiry they are left alone."""
    return wf.where((F.col("status") == "running") & (F.col("lease_expires_at") <= now)).select(F.col("id").alias("workflow_id"), F.lit("ready").alias("to_status"), F.lit(now).cast("long").alias("available_at"))


def due_timers(wf: DataFrame, now: int) -> DataFrame:
    """Sleeping workflows whose time has come."""
    return wf.where((F.col("status") == "sleeping") & (F.col("wait_kind") == "timer") & (F.col("available_at") <= now)).select(F.col("id").alias("workflow_id"), "available_at", F.lit("timer_fired").alias("event"))


def due_approvals(appr: DataFrame, wf: DataFrame, now: int) -> DataFrame:
    """Approvals to expire: pending, past their time, and still what their workflow waits for."""
    waits = wf.where((F.col("wait_kind") == "approval") & F.col("status").isin("waiting_approval", "paused")).select(F.col("id").alias("__wf"), F.col("wait_reference_id").alias("__a"))
    due = appr.where((F.col("status") == "pending") & (F.col("expires_at") <= now))
    j = due.join(waits, (F.col("workflow_id") == F.col("__wf")) & (F.col("id") == F.col("__a")), "left")
    return j.select(F.col("id").alias("approval_id"), "workflow_id", "expires_at", F.col("__wf").isNotNull().alias("awaited"))


def finish_plan(outcomes: DataFrame, act: DataFrame, now: int) -> DataFrame:
    """``activity_id, to_status, available_at`` for outcomes ``activity_id, outcome`` (succeeded, retryable, permanent) of running activities."""
    j = outcomes.join(act.where(F.col("status").isin(SLOT_HOLDERS)), F.col("activity_id") == F.col("id"))
    seed = F.concat(F.lit("activity:"), F.col("id").cast("string"), F.lit(":retry:"), F.col("attempt_count").cast("string"))
    retry = (F.col("outcome") == "retryable") & (F.col("attempt_count") < F.col("max_attempts"))
    to = F.when(F.col("status") == "cancelling", "cancelled").when(F.col("outcome") == "succeeded", "succeeded").when(retry, "pending").otherwise("dead_lettered")
    return j.select("activity_id", to.alias("to_status"), F.when(to == "pending", F.lit(now) + backoff(F.col("retry_policy_json"), F.col("attempt_count"), seed)).alias("available_at"))


def activation_failure_plan(wf: DataFrame, failed: DataFrame, now: int, cap: int = 8, first_delay: int = 1, most_delay: int = 60, jitter: int = 20) -> DataFrame:
    """Workflows (``failed``: ``id``) whose step failed: one attempt more, and failed for good at the smaller of the caps. Delays in seconds."""
    j = wf.join(failed.select(F.col("id").alias("__f")), F.col("id") == F.col("__f"), "left_semi")
    n = F.col("activation_attempts") + 1
    policy = F.lit(f'{{"backoff":{{"Exponential":{{"initial_secs":{first_delay},"max_secs":{most_delay},"jitter_percent":{jitter}}}}}}}')
    over = n >= F.least("max_activation_attempts", F.lit(cap))
    seed = F.concat(F.lit("workflow:"), F.col("id").cast("string"), F.lit(":activation:"), n.cast("string"))
    return j.select(F.col("id").alias("workflow_id"), n.alias("attempts"), F.when(over, "failed").otherwise("ready").alias("to_status"), (F.lit(now) + backoff(policy, n, seed)).alias("available_at"))


def continuation_delay() -> F.Column:
    """After so many continuations in a row a workflow makes way for others."""
    return F.when(F.col("consecutive_continuations") >= FAIR_CONTINUES, F.lit(FAIR_DELAY)).otherwise(F.lit(0))


def start_plan(requests: DataFrame, wf: DataFrame, newest: DataFrame) -> DataFrame:
    """``kind, deduplication_key, decision, workflow_id`` for start requests ``kind, deduplication_key``.

    A new key starts. A known one gives its newest generation, which is restarted if it failed or is blocked.
    """
    known = wf.where("deduplication_key IS NOT NULL").select("kind", "deduplication_key", F.col("id").alias("origin"))
    last = newest.select("origin", F.col("id").alias("workflow_id")).join(wf.select(F.col("id").alias("workflow_id"), "status"), "workflow_id")
    j = requests.dropDuplicates(["kind", "deduplication_key"]).join(known, ["kind", "deduplication_key"], "left").join(last, "origin", "left")
    decision = F.when(F.col("origin").isNull(), "start").when(F.col("status").isin(START_RECOVERABLE), "restart").otherwise("existing")
    return j.select("kind", "deduplication_key", decision.alias("decision"), "workflow_id")


def next_events(wf: DataFrame, ev: DataFrame) -> DataFrame:
    """``workflow_id, delivery_sequence, event_type``: the first event that each workflow hasn't been given."""
    j = ev.join(wf.select(F.col("id").alias("workflow_id"), "delivered_event_sequence"), "workflow_id").where("delivery_sequence > delivered_event_sequence")
    return j.groupBy("workflow_id").agg(F.min("delivery_sequence").alias("delivery_sequence"), F.min_by("event_type", "delivery_sequence").alias("event_type"))


def sequence_floor(ev: DataFrame) -> DataFrame:
    """``workflow_id, next_sequence``: where each log goes on."""
    return ev.groupBy("workflow_id").agg((F.max("sequence") + 1).alias("next_sequence"))


def resume_plan(wf: DataFrame, act: DataFrame, appr: DataFrame) -> DataFrame:
    """``workflow_id, to_status, refusal`` of paused workflows, by what they wait for.

    An open activity or child and a pending approval are waited for again, a dead letter blocks again, a success or a
    settled approval makes ready. A cancelled activity and an ended child, whose outcome never arrived, and targets
    that don't exist refuse the resume.
    """
    paused = wf.where("status = 'paused'").select("id", "wait_kind", "wait_reference_id")

    def target(df, kind):
        return df.select(F.lit(kind).alias("wait_kind"), F.col("id").alias("wait_reference_id"), F.col("status").alias("target"))

    targets = target(act, "activity").unionByName(target(wf, "child")).unionByName(target(appr, "approval"))
    j = paused.join(targets, ["wait_kind", "wait_reference_id"], "left")
    kind, t = F.col("wait_kind"), F.col("target")
    to = (
        F.when(kind.isNull(), "ready").when(kind == "timer", "sleeping")
        .when(kind == "activity", F.when(t.isin("pending", *SLOT_HOLDERS), "waiting_activity").when(t == "dead_lettered", "blocked").when(t == "succeeded", "ready"))
        .when(kind == "child", F.when(~t.isin(TERMINAL), "waiting_child")).when(kind == "approval", F.when(t == "pending", "waiting_approval").when(t.isNotNull(), "ready"))
    )
    refusal = F.when(to.isNull(), F.when(t.isNull(), F.concat(F.lit("missing_"), kind)).otherwise(F.concat(t, F.lit("_"), kind)))
    return j.select(F.col("id").alias("workflow_id"), to.alias("to_status"), refusal.alias("refusal"))


def retry_plan(act: DataFrame, wf: DataFrame) -> DataFrame:
    """``activity_id, workflow_id, root_id, replacement_number, correction_key``: dead letters that an operator may retry.

    Only the one that a blocked workflow waits for. Its replacement counts on from it and shares its root; a retry with
    another payload runs under the correction's key.
    """
    held = wf.where("status = 'blocked' AND wait_kind = 'activity'").select(F.col("id").alias("workflow_id"), F.col("wait_reference_id").alias("id"))
    j = act.where("status = 'dead_lettered'").join(held, ["workflow_id", "id"])
    root, number = F.coalesce("root_activity_id", "id"), F.col("replacement_number") + 1
    return j.select(F.col("id").alias("activity_id"), "workflow_id", root.alias("root_id"), number.alias("replacement_number"), correction_key(root, number).alias("correction_key"))


def approval_plan(appr: DataFrame, wf: DataFrame, now: int) -> DataFrame:
    """``approval_id, workflow_id, decision``: whether an operator's decision on each approval would be taken, or why not."""
    flows = wf.select(F.col("id").alias("workflow_id"), F.col("kind").alias("__kind"), F.col("version").alias("__version"), F.col("status").alias("__status"), "wait_kind", "wait_reference_id")
    j = appr.join(flows, "workflow_id", "left")
    fits = F.col("__status").isin("waiting_approval", "paused") & (F.col("wait_kind") == "approval") & (F.col("wait_reference_id") == F.col("id")) & (F.col("kind") == F.col("__kind")) & (F.col("version") == F.col("__version"))
    decision = (
        F.when(F.col("status") != "pending", F.concat(F.lit("already_"), F.col("status"))).when(F.col("expires_at") <= now, "expired")
        .when(F.coalesce(fits, F.lit(False)), "resolve").otherwise("no_longer_matches")
    )
    return j.select(F.col("id").alias("approval_id"), "workflow_id", decision.alias("decision"))
