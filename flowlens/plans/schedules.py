"""Schedule materialization: occurrences, misfires, overlap, promotion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.calendar import KEY, Cron, occurrences
from ..sources.schemas import TERMINAL

CHUNK = 10_000


def gap_end_utc(local: Column, zone: str) -> Column:
    """Epoch milliseconds of a local timestamp: where it doesn't exist, of the first later second that does.

    A time inside a gap is read with the offset before it, which leads to a moment behind the gap; what the clock shows
    then is as much ahead of the wanted time as the gap is long, and the gap's end lies at that moment less what has
    passed of the gap. So one day before and after tell the offsets, and no seconds are walked.
    """
    at = F.to_utc_timestamp(local, zone)
    valid = F.from_utc_timestamp(at, zone) == local
    day = F.expr("interval 1 day")
    seen = lambda t: F.unix_millis(F.from_utc_timestamp(t, zone)) - F.unix_millis(t)  # noqa: E731  the offset at a moment
    before, after = seen(at - day), seen(at + day)
    # In local time the gap is [start, start + after - before); the change is at the moment start - before.
    lo, hi = F.unix_millis(local) - after, F.unix_millis(local) - before
    step = F.lit(1000)
    moments = F.filter(F.sequence(lo, hi, F.lit(60_000)), lambda m: seen(F.timestamp_millis(m)) == after)
    first = F.coalesce(F.get(moments, F.lit(0)), hi)
    seconds = F.filter(F.sequence(F.greatest(lo, first - 60_000), first, step), lambda m: seen(F.timestamp_millis(m)) == after)
    return F.when(valid, F.unix_millis(at)).otherwise(F.get(seconds, F.lit(0)))


def due_occurrences(schedules: DataFrame, now: int, chunk: int = CHUNK) -> DataFrame:
    """``schedule_key, local_occurrence, due_at, disposition`` for rows ``schedule_key, cron, zone, after_local``.

    Calendars are walked one schedule at a time inside tasks; the schedules are dealt out evenly, since their number
    of occurrences isn't known before.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("schedule_key", pa.string()), ("local_occurrence", pa.string()), ("due_at", pa.int64()), ("disposition", pa.string())])
        for b in batches:
            for r in b.to_pylist():
                found = occurrences(Cron(r["cron"]), r["zone"], datetime.strptime(r["after_local"], KEY), now, chunk)
                yield pa.RecordBatch.from_pylist([{"schedule_key": r["schedule_key"], "local_occurrence": o.local, "due_at": o.due_at, "disposition": o.disposition} for o in found], schema=schema)

    rows = schedules.select("schedule_key", "cron", "zone", "after_local").repartition(int(schedules.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(run, "schedule_key string, local_occurrence string, due_at long, disposition string")


def classify_misfires(due: DataFrame, policies: DataFrame, now: int) -> DataFrame:
    """Adds ``outcome`` (start, skip, coalesce) and ``reason``.

    Policies: ``schedule_key, misfire`` (skip, run_latest, catch_up), ``grace``, ``catch_up``, ``following`` (runnable
    occurrences behind this chunk). Local times that don't exist never run.
    """
    runs = F.col("disposition") != "gap"
    newest = F.when(runs, F.sum(F.when(runs, 1).otherwise(0)).over(W.partitionBy("schedule_key").orderBy(F.desc("local_occurrence")).rowsBetween(W.unboundedPreceding, 0)))
    j = due.join(policies, "schedule_key").withColumn("nth", newest)
    late = F.col("due_at") + F.col("grace") < now
    out = (
        F.when(~runs, F.struct(F.lit("skip").alias("outcome"), F.lit("dst_gap").alias("reason")))
        .when((F.col("misfire") == "skip") & late, F.struct(F.lit("skip").alias("outcome"), F.lit("misfire_skip").alias("reason")))
        .when((F.col("misfire") == "run_latest") & ((F.col("nth") > 1) | (F.col("following") > 0)), F.struct(F.lit("coalesce").alias("outcome"), F.lit("run_latest").alias("reason")))
        .when((F.col("misfire") == "catch_up") & (F.col("nth") > F.greatest(F.col("catch_up") - F.col("following"), F.lit(0))), F.struct(F.lit("skip").alias("outcome"), F.lit("catch_up_limit").alias("reason")))
        .otherwise(F.struct(F.lit("start").alias("outcome"), F.lit(None).cast("string").alias("reason")))
    )
    return j.withColumn("out", out).select("schedule_key", "local_occurrence", "due_at", "disposition", "out.outcome", "out.reason")


def apply_overlap(classified: DataFrame, policies: DataFrame, active: DataFrame) -> DataFrame:
    """Settle ``start`` outcomes under ``overlap`` (allow, skip_if_active, queue_one), one occurrence after the other.

    Each start makes the next overlap, so this is a fold over a schedule's occurrences in order. ``active``:
    ``schedule_key, active, queued`` (booleans) before the tick. What matters of the state is two flags, so the fold
    has a closed form: of the starts of a schedule only the first can start when nothing is active.
    """
    starts = F.col("outcome") == "start"
    nth = F.sum(F.when(starts, 1).otherwise(0)).over(W.partitionBy("schedule_key").orderBy("local_occurrence").rowsBetween(W.unboundedPreceding, 0))
    j = classified.join(policies.select("schedule_key", "overlap"), "schedule_key").join(active, "schedule_key", "left").withColumn("nth", nth)
    busy, queued = F.coalesce("active", F.lit(False)), F.coalesce("queued", F.lit(False))
    runs = starts & ((F.col("overlap") == "allow") | (~busy & (F.col("nth") == 1)))
    waits = starts & ~runs & (F.col("overlap") == "queue_one") & ~queued & (F.col("nth") == F.when(busy, 1).otherwise(2))
    outcome = F.when(~starts, F.col("outcome")).when(runs, "start").when(waits, "queue").otherwise("skip")
    reason = F.when(starts & ~runs & ~waits, "overlap").otherwise(F.col("reason"))
    return j.select("schedule_key", "local_occurrence", "due_at", outcome.alias("outcome"), reason.alias("reason"))


def materialization_report(settled: DataFrame) -> DataFrame:
    """Counts by schedule: inspected, started, queued, skipped, coalesced."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return settled.groupBy("schedule_key").agg(F.count(F.lit(1)).alias("inspected"), n("start").alias("started"), n("queue").alias("queued"), n("skip").alias("skipped"), n("coalesce").alias("coalesced"))


def active_runs(runs: DataFrame, wf: DataFrame) -> DataFrame:
    """``schedule_key, active, queued``: whether a workflow of a schedule's runs is going on, and whether a run waits."""
    going = wf.where(~F.col("status").isin(TERMINAL)).select(F.col("schedule_run_id").alias("__run"))
    j = runs.join(going, F.col("id") == F.col("__run"), "left")
    return j.groupBy("schedule_key").agg(F.max(F.col("__run").isNotNull()).alias("active"), F.max(F.col("status") == "queued").alias("queued"))


def promotions(runs: DataFrame, wf: DataFrame) -> DataFrame:
    """``schedule_key, run_id``: the oldest queued run of each schedule with nothing going on."""
    idle = active_runs(runs, wf).where("queued AND NOT active").select("schedule_key")
    oldest = runs.where("status = 'queued'").groupBy("schedule_key").agg(F.min(F.struct("scheduled_for", "id")).alias("first"))
    return oldest.join(idle, "schedule_key").select("schedule_key", F.col("first.id").alias("run_id"))


def run_now_plan(runs: DataFrame, now: int) -> DataFrame:
    """``schedule_key, scheduled_for, local_occurrence`` of a manual run: behind the last one, and not before now."""
    at = F.greatest(F.max("scheduled_for") + 1, F.lit(now))
    return runs.groupBy("schedule_key").agg(at.alias("scheduled_for")).withColumn("local_occurrence", F.concat(F.lit("manual:"), F.col("scheduled_for").cast("string")))


def materialized_floor(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("local_occurrence").startswith("manual:")).groupBy("schedule_key").agg(F.max("local_occurrence").alias("floor"))


def pause_plan(states: DataFrame) -> DataFrame:
    """``schedule_key, action, next_status``: what an operator can do now; an active schedule pauses, a paused one resumes, never the other way."""
    paused = F.col("paused_at").isNotNull()
    return states.select("schedule_key", F.when(paused, "resume").otherwise("pause").alias("action"), F.when(paused, "active").otherwise("paused").alias("next_status"))
