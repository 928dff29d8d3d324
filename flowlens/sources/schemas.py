"""Schemas of the nine workflow tables and of trace records, and the closed sets of statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TABLES = {
    "workflow": """id BIGINT, kind STRING, version INT, input_json STRING, state_json STRING, state_version INT, status STRING, result_json STRING,
        error_category STRING, error_message STRING, wait_kind STRING, wait_reference_id BIGINT, available_at BIGINT, activation_attempts INT,
        max_activation_attempts INT, consecutive_continuations INT, lease_owner STRING, lease_token STRING, lease_expires_at BIGINT,
        deduplication_key STRING, schedule_run_id BIGINT, root_workflow_id BIGINT, restarted_from_workflow_id BIGINT, parent_workflow_id BIGINT,
        parent_command_sequence INT, command_sequence INT, delivered_event_sequence INT, created_at BIGINT, updated_at BIGINT, completed_at BIGINT""",
    "workflow_event": """id BIGINT, workflow_id BIGINT, sequence INT, delivery_sequence INT, event_type STRING, metadata_json STRING, actor_type STRING,
        actor_id STRING, reason STRING, created_at BIGINT""",
    "activity": """id BIGINT, workflow_id BIGINT, command_sequence INT, replacement_number INT, kind STRING, version INT, topic STRING, payload_json STRING,
        status STRING, available_at BIGINT, max_attempts INT, attempt_count INT, timeout_millis BIGINT, lease_duration_millis BIGINT,
        retry_policy_json STRING, operation_key STRING, provider_result_json STRING, last_error_category STRING, last_error_message STRING,
        lease_owner STRING, lease_token STRING, lease_expires_at BIGINT, root_activity_id BIGINT, replaces_activity_id BIGINT, created_at BIGINT,
        updated_at BIGINT, completed_at BIGINT""",
    "activity_attempt": """activity_id BIGINT, attempt_number INT, worker_id STRING, lease_token STRING, started_at BIGINT, heartbeat_at BIGINT,
        finished_at BIGINT, outcome STRING, error_category STRING, error_message STRING, provider_result_json STRING""",
    "progress_event": """activity_id BIGINT, attempt_number INT, sequence INT, code STRING, description STRING, description_bytes INT,
        completed_units BIGINT, total_units BIGINT, severity STRING, metadata_json STRING, created_at BIGINT""",
    "approval": """id BIGINT, workflow_id BIGINT, command_sequence INT, kind STRING, version INT, prompt_metadata_json STRING,
        validation_schema_json STRING, validation_version INT, status STRING, requested_at BIGINT, expires_at BIGINT, decision_payload_json STRING,
        decided_by INT, operator_reason STRING, resolved_at BIGINT""",
    "schedule_state": """schedule_key STRING, definition_fingerprint STRING, definition_version INT, next_local_occurrence STRING,
        next_occurrence_at BIGINT, last_materialized_at BIGINT, paused_at BIGINT, paused_by INT, pause_reason STRING, created_at BIGINT, updated_at BIGINT""",
    "schedule_run": """id BIGINT, schedule_key STRING, local_occurrence STRING, scheduled_for BIGINT, materialized_at BIGINT, status STRING,
        reason STRING, actor_id INT, workflow_id BIGINT, created_at BIGINT""",
    "topic_lock": "topic STRING, max_concurrency INT, updated_at BIGINT",
}
TRACE = "schema INT, test STRING, backend STRING, database STRING, topics MAP<STRING, INT>, records ARRAY<STRUCT<seq: BIGINT, txn: BIGINT, actor: STRING, action: STRING, depth: INT, begin_seq: BIGINT, now: BIGINT, end_now: BIGINT, params: STRING, post: STRING>>"

# The statuses that the engine stores.
WORKFLOW_STATUS = ["ready", "running", "waiting_activity", "waiting_child", "sleeping", "waiting_approval", "paused", "blocked", "succeeded", "failed", "cancelled"]
TERMINAL = ["succeeded", "failed", "cancelled"]
CHILD_WAITERS = ["waiting_child", "paused"]
APPROVAL_WAITERS = ["waiting_approval", "paused"]
DEAD_LETTER_WAITERS = ["blocked", "paused"]
RESTARTABLE = [*TERMINAL, "paused", "blocked"]
START_RECOVERABLE = ["failed", "blocked"]
ACTIVITY_STATUS = ["pending", "running", "cancelling", "succeeded", "dead_lettered", "cancelled"]
SLOT_HOLDERS = ["running", "cancelling"]
ACTIVITY_OPEN = ["pending", "running", "cancelling"]
ACTIVITY_TERMINAL = ["succeeded", "dead_lettered", "cancelled"]
WAIT_KIND = ["timer", "activity", "child", "approval"]
APPROVAL_STATUS = ["pending", "resolved", "expired", "cancelled"]
SCHEDULE_RUN_STATUS = ["queued", "materializing", "started", "skipped", "coalesced"]
ATTEMPT_OUTCOME = ["succeeded", "retryable_failure", "dead_lettered", "lease_expired", "operator_cancelled", "application_cancelled", "operator_paused"]
SEVERITY = ["info", "warning", "error"]

#: table -> column -> values it may hold
DOMAINS = {
    "workflow": {"status": WORKFLOW_STATUS, "wait_kind": [*WAIT_KIND, None]},
    "activity": {"status": ACTIVITY_STATUS},
    "activity_attempt": {"outcome": [*ATTEMPT_OUTCOME, None]},
    "progress_event": {"severity": SEVERITY},
    "approval": {"status": APPROVAL_STATUS},
    "schedule_run": {"status": SCHEDULE_RUN_STATUS},
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def invalid(table: str) -> Column:
    """True for rows with a status outside its closed set or an id that is not positive."""
    out = F.lit(False)
    for column, values in DOMAINS.get(table, {}).items():
        known = F.col(column).isin([v for v in values if v is not None])
        out = out | ~F.coalesce(known, F.lit(None in values))
    if "id BIGINT" in TABLES[table]:
        out = out | ~F.coalesce(F.col("id") > 0, F.lit(False))
    return out


def check_rows(df: DataFrame, table: str) -> DataFrame:
    """``df``, which stops with an error at the first row that :func:`invalid` marks."""
    return df.withColumn(df.columns[0], F.when(~invalid(table), F.col(df.columns[0])).otherwise(F.raise_error(F.lit(f"invalid row in {table}"))))
