"""Filtered pages over workflows, activities, approvals, runs, attempts and progress, and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cursor
from ..functions.exprs import byte_length, effective_approval_status, shown_available_at

#: Columns that a list shows; documents go in as their bytes alone.
WORKFLOW_COLUMNS = ["id", "kind", "version", "status", "error_category", "wait_kind", "wait_reference_id", "activation_attempts", "schedule_run_id", "root_workflow_id", "restarted_from_workflow_id", "parent_workflow_id", "created_at", "updated_at", "completed_at"]
ACTIVITY_COLUMNS = ["id", "workflow_id", "command_sequence", "replacement_number", "kind", "version", "topic", "status", "max_attempts", "attempt_count", "last_error_category", "root_activity_id", "replaces_activity_id", "lease_expires_at", "created_at", "updated_at", "completed_at"]


def where_equal(df: DataFrame, **values) -> DataFrame:
    """All conjuncts that are given."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def created_between(df: DataFrame, after: int | None = None, before: int | None = None) -> DataFrame:
    if after is not None and before is not None and after >= before:
        raise ValueError("created_after must be before created_before")
    if after is not None:
        df = df.where(F.col("created_at") >= after)
    return df if before is None else df.where(F.col("created_at") < before)


def before_key(time: str, key: tuple[int, int] | None) -> Column:
    """Rows that come after ``key`` in descending (time, id); pushed down to the scan."""
    if key is None:
        return F.lit(True)
    return (F.col(time) < key[0]) | ((F.col(time) == key[0]) & (F.col("id") < key[1]))


def workflow_summaries(wf: DataFrame) -> DataFrame:
    return wf.select(*WORKFLOW_COLUMNS, shown_available_at().alias("available_at"), byte_length("input_json").alias("input_bytes"), byte_length("state_json").alias("state_bytes"), byte_length("result_json").alias("result_bytes"))


def activity_summaries(act: DataFrame) -> DataFrame:
    return act.select(*ACTIVITY_COLUMNS, shown_available_at().alias("available_at"), byte_length("payload_json").alias("payload_bytes"), byte_length("provider_result_json").alias("provider_result_bytes"))


def workflow_filter(wf: DataFrame, kind=None, version=None, status=None, schedule_run_id=None, root_workflow_id=None, created_after=None, created_before=None, waiting_approval=None) -> DataFrame:
    """``waiting_approval`` looks at what a workflow waits for, so that a paused one still counts; False takes those that wait for nothing, too."""
    if version is not None and version <= 0:
        raise ValueError("version must be positive")
    df = created_between(where_equal(wf, kind=kind, version=version, status=status, schedule_run_id=schedule_run_id, root_workflow_id=root_workflow_id), created_after, created_before)
    if waiting_approval is not None:
        waits = F.col("wait_kind").eqNullSafe(F.lit("approval"))
        df = df.where(waits if waiting_approval else ~waits)
    return df


def page(df: DataFrame, time: str, limit: int | None = None, key: tuple[int, int] | None = None, most: int = cursor.MAX_LIMIT) -> DataFrame:
    """The rows of one page, newest first."""
    return df.where(before_key(time, key)).orderBy(F.desc(time), F.desc("id")).limit(cursor.bounded_limit(limit, most))


def fetch_page(df: DataFrame, scope: str, time: str, limit: int | None = None, after: str | None = None) -> tuple[list, str | None]:
    """(rows, cursor of the next page): one row more than asked for tells whether there is one."""
    n = cursor.bounded_limit(limit)
    key = cursor.decode_number(after, scope) if after else None
    rows = df.where(before_key(time, key)).orderBy(F.desc(time), F.desc("id")).limit(n + 1).collect()
    more = len(rows) > n
    rows = rows[:n]
    return rows, cursor.encode(scope, rows[-1][time], str(rows[-1]["id"])) if more else None


def approvals(appr: DataFrame, now: int, status: str | None = None, workflow_id: int | None = None) -> DataFrame:
    """Approvals with the status that holds at ``now``; a status that doesn't exist matches nothing."""
    shown = where_equal(appr, workflow_id=workflow_id).withColumn("status", effective_approval_status(now))
    cols = ["id", "workflow_id", "command_sequence", "kind", "version", "status", "requested_at", "expires_at", "decided_by", "resolved_at"]
    return where_equal(shown.select(*cols, byte_length("prompt_metadata_json").alias("prompt_bytes"), byte_length("decision_payload_json").alias("decision_bytes")), status=status)


def attempts_page(att: DataFrame, activity_id: int, limit: int | None = None, after: int | None = None) -> DataFrame:
    df = att.where(F.col("activity_id") == activity_id)
    df = df if after is None else df.where(F.col("attempt_number") > after)
    return df.drop("provider_result_json").orderBy("attempt_number").limit(cursor.bounded_limit(limit))


def progress_page(prog: DataFrame, activity_id: int, limit: int | None = None, after: tuple[int, int] | None = None) -> DataFrame:
    df = prog.where(F.col("activity_id") == activity_id)
    if after is not None:
        df = df.where((F.col("attempt_number") > after[0]) | ((F.col("attempt_number") == after[0]) & (F.col("sequence") > after[1])))
    return df.drop("metadata_json").orderBy("attempt_number", "sequence").limit(cursor.bounded_limit(limit))


def key_page(df: DataFrame, column: str, limit: int | None = None, after: str | None = None) -> DataFrame:
    df = df if after is None else df.where(F.col(column) > after)
    return df.orderBy(column).limit(cursor.bounded_limit(limit))


def by_id(df: DataFrame, id_: int) -> DataFrame:
    """The row with this id, if any; documents are checked to be JSON when they are read."""
    docs = [c for c in df.columns if c.endswith("_json")]
    bad = F.raise_error(F.lit("invalid JSON document"))
    out = df.where(F.col("id") == id_).limit(1)
    return out.withColumns({c: F.when(F.col(c).isNull() | F.try_parse_json(c).isNotNull(), F.col(c)).otherwise(bad) for c in docs})


def by_deduplication_key(wf: DataFrame, kind: str, key: str) -> DataFrame:
    return wf.where((F.col("kind") == kind) & (F.col("deduplication_key") == key)).limit(1)
