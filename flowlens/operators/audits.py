"""Invariant audits: each gives the rows of a snapshot that break a rule, as ``entity_id, detail``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import live_lease
from ..sources.schemas import CHILD_WAITERS, RESTARTABLE, SLOT_HOLDERS, TERMINAL

# The engine's limits in bytes.
LIMITS = {"input_json": 262_144, "state_json": 262_144, "payload_json": 262_144, "result_json": 65_536, "provider_result_json": 65_536, "metadata_json": 16_384, "description": 2_048, "reason": 2_048, "error_category": 64}


def _bad(df: DataFrame, rule: Column, detail: Column, id_: str = "id") -> DataFrame:
    return df.where(rule).select(F.col(id_).cast("long").alias("entity_id"), detail.cast("string").alias("detail"))


def lease_fields(wf: DataFrame, act: DataFrame) -> DataFrame:
    """Running exactly with a token and an expiry."""
    has = F.col("lease_token").isNotNull() & F.col("lease_expires_at").isNotNull()
    some = F.col("lease_token").isNotNull() | F.col("lease_expires_at").isNotNull()
    rule = lambda holds: (holds & ~has) | (~holds & some)
    return _bad(wf, rule(F.col("status") == "running"), F.lit("workflow")).unionByName(_bad(act, rule(F.col("status").isin(SLOT_HOLDERS)), F.lit("activity")))


def delivery(wf: DataFrame, ev: DataFrame) -> DataFrame:
    """An event delivered twice; more than one undelivered; a ready workflow without one."""
    twice = ev.where("delivery_sequence IS NOT NULL").groupBy("workflow_id", "delivery_sequence").count().where("count > 1").select(F.col("workflow_id").alias("entity_id"), F.lit("duplicate_delivery").alias("detail"))
    open_ = wf.select("id", "status", "delivered_event_sequence").join(ev.select("workflow_id", "delivery_sequence"), (F.col("id") == F.col("workflow_id")) & (F.col("delivery_sequence") > F.col("delivered_event_sequence")), "left")
    n = open_.groupBy("id", "status").agg(F.count("delivery_sequence").alias("n"))
    return twice.unionByName(_bad(n, F.col("n") > 1, F.lit("several_undelivered"))).unionByName(_bad(n, (F.col("status") == "ready") & (F.col("n") == 0), F.lit("ready_without_event")))


#: Which wait goes with which status; a paused or blocked workflow keeps what it waited for.
WAITS = {"waiting_activity": "activity", "waiting_child": "child", "sleeping": "timer", "waiting_approval": "approval"}


def wait_coupling(wf: DataFrame) -> DataFrame:
    """Status, kind of wait and its target fit each other."""
    half = F.col("wait_kind").isNull() != F.col("wait_reference_id").isNull()
    wrong = F.lit(False)
    for status, kind in WAITS.items():
        wrong = wrong | ((F.col("status") == status) & ~F.col("wait_kind").eqNullSafe(F.lit(kind)))
    idle = F.col("status").isin("ready", "running", *TERMINAL) & F.col("wait_kind").isNotNull()
    return _bad(wf, half | wrong | idle, F.col("status"))


def open_attempts(act: DataFrame, att: DataFrame) -> DataFrame:
    """A slot holder has exactly one open attempt, under its own token."""
    own = act.where(F.col("status").isin(SLOT_HOLDERS)).select("id", F.col("lease_token").alias("token"))
    n = own.join(att.where("outcome IS NULL").select("activity_id", "lease_token"), F.col("id") == F.col("activity_id"), "left").groupBy("id", "token").agg(F.count("activity_id").alias("n"), F.count_if(F.col("lease_token") == F.col("token")).alias("same"))
    return _bad(n, (F.col("n") != 1) | (F.col("same") != 1), F.col("n"))


def attempt_numbers(act: DataFrame, att: DataFrame) -> DataFrame:
    """Attempts are 1 to attempt_count, of which there are at most max_attempts."""
    n = att.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.min("attempt_number").alias("lo"), F.max("attempt_number").alias("hi"), F.countDistinct("attempt_number").alias("d"))
    j = act.select("id", "attempt_count", "max_attempts").join(n, F.col("id") == F.col("activity_id"), "left")
    has = F.coalesce("n", F.lit(0))
    gaps = F.coalesce((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")), F.lit(False))
    return _bad(j, (has != F.col("attempt_count")) | gaps | (F.col("attempt_count") > F.col("max_attempts")), has)


def activity_coupling(wf: DataFrame, act: DataFrame) -> DataFrame:
    """A workflow that waits for an activity waits for one of its own that is open; a blocked one for a dead letter."""
    waits = wf.where((F.col("wait_kind") == "activity") & F.col("status").isin("waiting_activity", "blocked")).select(F.col("id").alias("wid"), F.col("status").alias("ws"), "wait_reference_id")
    j = waits.join(act.select("id", "workflow_id", "status"), F.col("wait_reference_id") == F.col("id"), "left")
    fits = F.when(F.col("ws") == "blocked", F.col("status") == "dead_lettered").otherwise(F.col("status").isin("pending", *SLOT_HOLDERS))
    return _bad(j, ~F.coalesce((F.col("workflow_id") == F.col("wid")) & fits, F.lit(False)), F.col("status"), "wid")


def topic_caps(act: DataFrame, caps: DataFrame, now: int) -> DataFrame:
    """No more live slot holders than a topic's cap; the topic is the detail."""
    n = act.where(F.col("status").isin(SLOT_HOLDERS) & live_lease(now)).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).join(caps, "topic")
    return _bad(n, F.col("n") > F.col("max_concurrency"), F.col("topic"), "n")


def duplicate_keys(wf: DataFrame) -> DataFrame:
    """One workflow for each kind and key; null keys are no keys."""
    n = wf.where("deduplication_key IS NOT NULL").groupBy("kind", "deduplication_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return _bad(n, F.col("n") > 1, F.col("deduplication_key"))


def successors(wf: DataFrame) -> DataFrame:
    """A workflow is restarted once at most, and only from a state that allows it."""
    n = wf.where("restarted_from_workflow_id IS NOT NULL").groupBy("restarted_from_workflow_id").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(wf.select("id", "status"), F.col("restarted_from_workflow_id") == F.col("id"), "left")
    return _bad(j, (F.col("n") > 1) | ~F.coalesce(F.col("status").isin(TERMINAL), F.lit(False)), F.col("status"), "restarted_from_workflow_id")


def pending_approvals(wf: DataFrame, appr: DataFrame) -> DataFrame:
    """A pending approval is one that its workflow waits for."""
    waits = wf.where((F.col("wait_kind") == "approval") & F.col("status").isin("waiting_approval", "paused")).select(F.col("id").alias("wid"), "wait_reference_id")
    lost = appr.where("status = 'pending'").join(waits, (F.col("workflow_id") == F.col("wid")) & (F.col("id") == F.col("wait_reference_id")), "left_anti")
    return _bad(lost, F.lit(True), F.col("kind"))


def ended_children(wf: DataFrame) -> DataFrame:
    """No parent waits for a child that has ended."""
    waits = wf.where((F.col("wait_kind") == "child") & F.col("status").isin(CHILD_WAITERS)).select(F.col("id").alias("wid"), "wait_reference_id")
    j = waits.join(wf.where(F.col("status").isin(TERMINAL)).select("id", "status"), F.col("wait_reference_id") == F.col("id"))
    return _bad(j, F.lit(True), F.col("status"), "wid")


def duplicate_occurrences(runs: DataFrame) -> DataFrame:
    """One run for each schedule and local occurrence."""
    n = runs.groupBy("schedule_key", "local_occurrence").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return _bad(n, F.col("n") > 1, F.col("local_occurrence"))


def cursor_floor(states: DataFrame, runs: DataFrame) -> DataFrame:
    """The next local occurrence is behind all that were materialized; manual runs don't count. The schedule is the detail."""
    floor = runs.where(~F.col("local_occurrence").startswith("manual:")).groupBy("schedule_key").agg(F.max("local_occurrence").alias("floor"), F.max("id").alias("id"))
    return _bad(states.join(floor, "schedule_key"), F.col("next_local_occurrence") <= F.col("floor"), F.col("schedule_key"))


def queued_runs(runs: DataFrame) -> DataFrame:
    """One queued run for each schedule at most."""
    n = runs.where("status = 'queued'").groupBy("schedule_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return _bad(n, F.col("n") > 1, F.col("schedule_key"))


def payload_limits(df: DataFrame, id_: str = "id", limits: dict[str, int] = LIMITS) -> DataFrame:
    """Documents and texts over their limit in bytes; the column is the detail."""
    over = F.array_compact(F.array(*[F.when(F.octet_length(c) > n, F.lit(c)) for c, n in limits.items() if c in df.columns]))
    return df.select(F.col(id_).cast("long").alias("entity_id"), F.explode(over).alias("detail"))


def restartable(wf: DataFrame) -> DataFrame:
    """Workflows that an operator may restart: in a state that allows it, and not restarted before."""
    after = wf.where("restarted_from_workflow_id IS NOT NULL").select(F.col("restarted_from_workflow_id").alias("__id"))
    return wf.where(F.col("status").isin(RESTARTABLE)).join(after, F.col("id") == F.col("__id"), "left_anti").select("id", "kind", "version", "status")
