"""Restart chains, ancestors, owned descendants and waiting parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.schemas import CHILD_WAITERS, TERMINAL


def waiting_parents(wf: DataFrame) -> DataFrame:
    """``child_id, parent_id, child_status``: workflows that wait for a child."""
    waits = wf.where((F.col("wait_kind") == "child") & F.col("status").isin(CHILD_WAITERS)).select(F.col("id").alias("parent_id"), F.col("wait_reference_id").alias("child_id"))
    return waits.join(wf.select(F.col("id").alias("child_id"), F.col("status").alias("child_status")), "child_id")


def _closure(start: DataFrame, step: DataFrame, keep: str) -> DataFrame:
    """Follow ``step`` (``id, next``) from ``start`` (``origin, id, depth``) until nothing new is found; ``keep``: all or last.

    One join for each level, over the rows that got further: the work is what the chains hold, not their longest times all.
    A row that comes back to where its origin has been before goes no further, so cycles end.
    """
    done, front, seen = [], start, start.select("origin", "id")
    while True:
        if keep == "all":
            done.append(front)
        more = front.join(step, "id").select("origin", F.col("next").alias("id"), (F.col("depth") + 1).alias("depth"))
        more = more.join(seen, ["origin", "id"], "left_anti")
        if keep == "last":
            done.append(front.join(step.select("id").distinct(), "id", "left_anti").select("origin", "id", "depth"))
        front = more.checkpoint() if front.sparkSession.conf.get("spark.checkpoint.dir", None) else more
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("origin", "id"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def newest_generation(wf: DataFrame) -> DataFrame:
    """``origin, id, depth``: of each workflow the newest of its restarts, itself if there is none."""
    step = wf.where("restarted_from_workflow_id IS NOT NULL").select(F.col("restarted_from_workflow_id").alias("id"), F.col("id").alias("next"))
    return _closure(wf.select(F.col("id").alias("origin"), "id", F.lit(0).alias("depth")), step, "last")


def ancestors(wf: DataFrame) -> DataFrame:
    """``origin, id, depth``: each workflow and all before it, by parent or else by what it was restarted from."""
    step = wf.select("id", F.coalesce("parent_workflow_id", "restarted_from_workflow_id").alias("next")).where("next IS NOT NULL")
    return _closure(wf.select(F.col("id").alias("origin"), "id", F.lit(0).alias("depth")), step, "all")


def owned_descendants(wf: DataFrame, roots: DataFrame) -> DataFrame:
    """``origin, id, depth``: what the workflows in ``roots`` (``id``) own, for a cascade of cancellations.

    A child is owned if its key is exactly that of its parent and command. All its restarts count, and the search
    goes on below those generations that have not ended.
    """
    key = F.concat_ws(":", F.lit("child"), F.col("parent_workflow_id").cast("string"), F.col("parent_command_sequence").cast("string"))
    first = wf.where(F.col("deduplication_key") == key).select(F.col("parent_workflow_id").alias("id"), F.col("id").alias("next"))
    again = wf.where("restarted_from_workflow_id IS NOT NULL").select(F.col("restarted_from_workflow_id").alias("id"), F.col("id").alias("next"))
    # Restarts follow from any generation, children only from one that is going on.
    going = wf.where(~F.col("status").isin(TERMINAL)).select("id")
    step = first.join(going.unionByName(roots.select("id")).distinct(), "id", "left_semi").unionByName(again.join(first.select(F.col("next").alias("id")).unionByName(again.select(F.col("next").alias("id"))).distinct(), "id", "left_semi"))
    found = _closure(roots.select(F.col("id").alias("origin"), "id", F.lit(0).alias("depth")), step, "all")
    return found.where("depth > 0").distinct()
