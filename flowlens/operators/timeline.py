"""One timeline out of five sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cursor import TIMELINE_MAX, bounded_limit
from ..functions.exprs import byte_length, tie_breaker

SOURCES = ("event", "activity", "attempt", "progress", "approval")


def entries(ev: DataFrame, act: DataFrame, att: DataFrame, prog: DataFrame, appr: DataFrame, workflow_id: int | None = None) -> DataFrame:
    """``workflow_id, occurred_at, source, rank, tie_breaker, c1, c2, c3, status, label, bytes`` of all entries, or of one workflow's."""
    if workflow_id is not None:
        ev, act, appr = (d.where(F.col("workflow_id") == workflow_id) for d in (ev, act, appr))
    owner = act.select(F.col("id").alias("activity_id"), "workflow_id")

    def rows(df, rank, time, parts, status, label, size):
        c = [F.col(p).cast("long") for p in parts] + [F.lit(None).cast("long")] * (3 - len(parts))
        return df.select(
            "workflow_id", F.col(time).alias("occurred_at"), F.lit(SOURCES[rank]).alias("source"), F.lit(rank).alias("rank"), tie_breaker(rank, *parts).alias("tie_breaker"),
            *[x.alias(f"c{k + 1}") for k, x in enumerate(c)], status.cast("string").alias("status"), label.alias("label"), size.alias("bytes"),
        )

    none = F.lit(None).cast("long")
    return (
        rows(ev, 0, "created_at", ["id"], F.lit(None), F.col("event_type"), byte_length("metadata_json"))
        .unionByName(rows(act, 1, "created_at", ["id"], F.col("status"), F.col("kind"), byte_length("payload_json")))
        .unionByName(rows(att.join(owner, "activity_id"), 2, "started_at", ["activity_id", "attempt_number"], F.col("outcome"), F.col("worker_id"), none))
        .unionByName(rows(prog.join(owner, "activity_id"), 3, "created_at", ["activity_id", "attempt_number", "sequence"], F.col("severity"), F.col("code"), byte_length("metadata_json")))
        .unionByName(rows(appr, 4, "requested_at", ["id"], F.col("status"), F.col("kind"), byte_length("prompt_metadata_json")))
    )


def after_key(key: tuple[int, int, tuple[int, ...]] | None) -> Column:
    """Entries behind a cursor's (time, rank, components): by time, then rank, then the components in order."""
    if key is None:
        return F.lit(True)
    at, rank, parts = key
    same = F.lit(False)
    for k in reversed(range(len(parts))):
        c = F.col(f"c{k + 1}")
        same = (c > parts[k]) | ((c == parts[k]) & same)
    return (F.col("occurred_at") > at) | ((F.col("occurred_at") == at) & ((F.col("rank") > rank) | ((F.col("rank") == rank) & same)))


def timeline_page(all_entries: DataFrame, limit: int | None = None, key=None) -> DataFrame:
    return all_entries.where(after_key(key)).orderBy("occurred_at", "tie_breaker").limit(bounded_limit(limit, TIMELINE_MAX))
