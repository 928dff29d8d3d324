"""Readiness and health findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.exprs import stale_lease
from ..sources.schemas import ACTIVITY_OPEN, DEAD_LETTER_WAITERS, SLOT_HOLDERS, TERMINAL
from .metrics import unresolved_dead_letters

MAX_ALERTS, MOST_ALERTS = 25, 100


def recoverable_dead_letters(act: DataFrame, wf: DataFrame) -> DataFrame:
    """Dead letters that a blocked or paused workflow still waits for: an operator may retry them."""
    held = wf.where(F.col("status").isin(DEAD_LETTER_WAITERS) & (F.col("wait_kind") == "activity")).select(F.col("id").alias("__wf"), F.col("wait_reference_id").alias("__act"))
    return act.where(F.col("status") == "dead_lettered").join(held, (F.col("workflow_id") == F.col("__wf")) & (F.col("id") == F.col("__act")), "left_semi")


def readiness(wf: DataFrame, act: DataFrame, workflow_defs: DataFrame, activity_defs: DataFrame, topics: DataFrame) -> DataFrame:
    """``missing, name, version``: definitions and topics that stored work needs and the registries lack.

    Registries are DataFrames ``kind, version`` (activities: with ``topic``) and ``topic``; their topics are needed too.
    """
    work = act.where(F.col("status").isin(ACTIVITY_OPEN)).select("kind", "version", "topic").unionByName(recoverable_dead_letters(act, wf).select("kind", "version", "topic"))
    flows = wf.where(~F.col("status").isin(TERMINAL)).select("kind", "version").distinct().join(workflow_defs, ["kind", "version"], "left_anti")
    kinds = work.select("kind", "version").distinct().join(activity_defs, ["kind", "version"], "left_anti")
    lost = work.select("topic").unionByName(activity_defs.select("topic")).distinct().join(topics, "topic", "left_anti")
    return (
        flows.select(F.lit("workflow_definition").alias("missing"), F.col("kind").alias("name"), "version")
        .unionByName(kinds.select(F.lit("activity_definition").alias("missing"), F.col("kind").alias("name"), "version"))
        .unionByName(lost.select(F.lit("topic").alias("missing"), F.col("topic").alias("name"), F.lit(None).cast("int").alias("version")))
    )


def health_alerts(wf: DataFrame, act: DataFrame, missing: DataFrame, now: int, stale_after: int, most: int = MAX_ALERTS) -> DataFrame:
    """``alert, entity_id, name, version``: of each kind the first ``most``, what is missing by name and version, the rest by id.

    Dead letters count here whatever became of their workflow; only a success in their chain clears them.
    """
    if not 1 <= most <= MOST_ALERTS:
        raise ValueError(f"alerts of each kind must be between 1 and {MOST_ALERTS}")

    def first(df, alert):
        return df.orderBy("id").limit(most).select(F.lit(alert).alias("alert"), F.col("id").alias("entity_id"), F.col("kind").alias("name"), "version")

    order = W.partitionBy("missing").orderBy("name", "version")
    missing = missing.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return (
        missing.select(F.concat(F.lit("missing_"), "missing").alias("alert"), F.lit(None).cast("long").alias("entity_id"), "name", "version")
        .unionByName(first(wf.where((F.col("status") == "failed") & (F.col("error_category") == "activation")), "activation_exhausted"))
        .unionByName(first(unresolved_dead_letters(act), "activity_dead_lettered"))
        .unionByName(first(wf.where((F.col("status") == "running") & stale_lease(now, stale_after)), "stale_workflow"))
        .unionByName(first(act.where(F.col("status").isin(SLOT_HOLDERS) & stale_lease(now, stale_after)), "stale_activity"))
    )


def windowed_errors(errors: DataFrame, window_ms: int, limit: int, key: str = "process", time: str = "at") -> DataFrame:
    """``key, opened_at, errors, over``: errors counted in fixed windows.

    A window opens at the first error that no window holds and closes once more than ``window_ms`` have gone by, so
    where it opens depends on the errors before: a fold over each process's errors in order of time.
    """

    def fold(batches):
        import pyarrow as pa

        now, opened, n = None, None, 0
        schema = pa.schema([(key, pa.string()), ("opened_at", pa.int64()), ("errors", pa.int64()), ("over", pa.bool_())])
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now or t - opened > window_ms:
                    if n:
                        out.append({key: now, "opened_at": opened, "errors": n, "over": n > limit})
                    now, opened, n = k, t, 0
                n += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if n:
            yield pa.RecordBatch.from_pylist([{key: now, "opened_at": opened, "errors": n, "over": n > limit}], schema=schema)

    n = int(errors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = errors.where(F.col(time).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(time).cast("long").alias(time))
    return rows.repartition(n, key).sortWithinPartitions(key, time).mapInArrow(fold, f"{key} string, opened_at long, errors long, over boolean")
