"""The nine workflow tables, derived from the synthetic star schema with integer arithmetic alone.

Each table is one SQL text that Spark and DuckDB both run: the dialects differ in integer division, in reading
milliseconds, in JSON access and in generating rows, which are filled in.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

#: The moment of the snapshot: 2024-01-30T12:00:00Z.
NOW = 1_706_616_000_000

# A log of few, alike columns takes so few bytes that adaptive execution would put it into a handful of tasks: a number of partitions that is asked for stays.
SPARK = {
    "dealt": "(SELECT /*+ REPARTITION(:parts, workflow_id) */ * FROM ", "dealt_end": " u)",
    "div": "div", "ms": "unix_millis(CAST({0} AS TIMESTAMP))", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "repeat": "LATERAL VIEW explode(sequence(1, {0})) x AS i", "local": "date_format(timestamp_millis({0}), \"yyyy-MM-dd'T'HH:mm:ss\")",
}
DUCK = {
    "dealt": "", "dealt_end": "",
    "div": "//", "ms": "(epoch_us({0}) // 1000)", "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
    "repeat": ", unnest(range(1, {0} + 1)) AS x(i)", "local": "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S')",
}

BASE = """
SELECT *, CASE WHEN ms < {now} THEN ms ELSE {now} - 1 - event_id % 3600000 END AS t, w % 20 AS b
FROM (SELECT event_id, user_id, event_type, event_id {div} 4 AS w, event_id % 4 + 1 AS s, {k} AS k, {ms_ts} AS ms FROM events) e
"""

ACTIVITY = """
SELECT id, workflow_id, CAST(command_sequence AS INT) AS command_sequence, CAST(replacement_number AS INT) AS replacement_number, kind, CAST(version AS INT) AS version, topic,
       payload_json, status, available_at, CAST(3 AS INT) AS max_attempts,
       CAST(CASE WHEN status IN ('running', 'succeeded', 'cancelling') THEN 1 + k % 2 WHEN status = 'dead_lettered' THEN 3 WHEN s = 4 AND b = 5 THEN 1 ELSE 0 END AS INT) AS attempt_count,
       CAST(30000 AS BIGINT) AS timeout_millis, CAST(60000 AS BIGINT) AS lease_duration_millis, retry_policy_json, CAST(NULL AS {text}) AS operation_key,
       CASE WHEN status = 'succeeded' THEN 'null' END AS provider_result_json, CASE WHEN status = 'dead_lettered' THEN 'provider' END AS last_error_category,
       CASE WHEN status = 'dead_lettered' THEN 'gave up' END AS last_error_message,
       CASE WHEN status IN ('running', 'cancelling') THEN concat('worker-', CAST(w % 7 AS {text})) END AS lease_owner,
       CASE WHEN status IN ('running', 'cancelling') THEN concat('token-', CAST(id AS {text})) END AS lease_token,
       CASE WHEN status NOT IN ('running', 'cancelling') OR w % 40 = 27 THEN NULL WHEN b = 8 THEN {now} - 600000 - k ELSE {now} + 1000 + k END AS lease_expires_at,
       root_activity_id, root_activity_id AS replaces_activity_id, t - 1000 AS created_at, t AS updated_at,
       CASE WHEN status IN ('succeeded', 'dead_lettered', 'cancelled') THEN least(t + 1000 + 10 * k, {now}) END AS completed_at
FROM (
  SELECT event_id + 1 AS id, w + 1 AS workflow_id, CASE WHEN s = 3 AND w % 5 = 1 THEN 2 ELSE s END AS command_sequence,
         CASE WHEN s = 3 AND w % 5 = 1 THEN 1 ELSE 0 END AS replacement_number, concat('activity_', event_type) AS kind, 1 + user_id % 2 AS version, event_type AS topic,
         concat('{{"k":', CAST(k AS {text}), '}}') AS payload_json,
         CASE WHEN w % 23 = 6 THEN '{{"backoff":{{"Fixed":{{"delay_secs":0}}}}}}' WHEN w % 3 = 0 THEN '{{"backoff":{{"Fixed":{{"delay_secs":2}}}}}}'
              ELSE '{{"backoff":{{"Exponential":{{"initial_secs":40,"max_secs":300,"jitter_percent":20}}}}}}' END AS retry_policy_json,
         CASE WHEN s = 1 THEN 'succeeded'
              WHEN s = 2 THEN CASE WHEN w % 5 = 1 THEN 'dead_lettered' ELSE 'succeeded' END
              WHEN s = 3 AND w % 5 = 1 THEN CASE WHEN w % 10 = 1 THEN 'succeeded' ELSE 'dead_lettered' END
              WHEN s = 3 THEN CASE WHEN w % 7 = 0 THEN 'cancelled' ELSE 'succeeded' END
              WHEN b IN (3, 4, 5, 13) THEN 'pending' WHEN b IN (6, 7, 8) THEN 'running' WHEN b = 9 THEN 'cancelling' WHEN b = 15 THEN 'dead_lettered'
              WHEN b = 19 THEN 'cancelled' ELSE 'succeeded' END AS status,
         CASE WHEN s = 4 AND b = 4 THEN 0 WHEN s = 4 AND b = 5 THEN {now} + 5000 + event_id ELSE t END AS available_at,
         CASE WHEN s = 3 AND w % 5 = 1 THEN event_id END AS root_activity_id, w, s, b, k, t
  FROM base
) a
"""

WORKFLOW = """
SELECT w + 1 AS id, concat('flow_', CAST(w % 4 AS {text})) AS kind, CAST(1 + w % 2 AS INT) AS version, '{{}}' AS input_json, concat('{{"w":', CAST(w AS {text}), '}}') AS state_json,
       CAST(1 AS INT) AS state_version,
       CASE WHEN b = 0 THEN 'ready' WHEN b IN (1, 2) THEN 'running' WHEN b BETWEEN 3 AND 9 THEN 'waiting_activity' WHEN b = 10 THEN 'waiting_child' WHEN b = 11 THEN 'sleeping'
            WHEN b = 12 THEN 'waiting_approval' WHEN b IN (13, 14) THEN 'paused' WHEN b = 15 THEN 'blocked' WHEN b IN (16, 17) THEN 'succeeded' WHEN b = 18 THEN 'failed'
            ELSE 'cancelled' END AS status,
       CASE WHEN b IN (16, 17) THEN '{{"ok":true}}' END AS result_json, CASE WHEN b = 18 THEN 'activation' WHEN b = 19 AND r % 4 = 1 THEN repeat('é', 33) END AS error_category,
       CASE WHEN b = 18 THEN 'step failed' END AS error_message,
       CASE WHEN b BETWEEN 3 AND 9 OR b IN (13, 15) THEN 'activity' WHEN b = 10 OR b = 14 AND r % 5 = 4 THEN 'child' WHEN b = 11 THEN 'timer' WHEN b IN (12, 14) THEN 'approval' END AS wait_kind,
       CASE WHEN b = 3 AND r % 9 = 2 THEN NULL WHEN b = 4 AND r % 9 = 1 OR b = 13 AND r % 4 = 1 THEN 4 * w + 1 WHEN b = 13 AND r % 4 = 2 THEN 4 * w + 3 WHEN b = 13 AND r % 8 = 3 THEN 4 * w + 12
            WHEN b BETWEEN 3 AND 9 OR b IN (13, 15) THEN 4 * w + 4 WHEN b = 10 AND r % 6 = 1 THEN w + 7 WHEN b = 10 THEN w + 2 WHEN b = 11 THEN 4
            WHEN b = 14 AND r % 10 = 9 THEN w + 4 WHEN b = 14 AND r % 5 = 4 THEN w + 2 WHEN b IN (12, 14) THEN w + 1 END AS wait_reference_id,
       CASE WHEN b = 11 THEN {now} - 60000 + 120000 * (r % 2) ELSE t - 2000 END AS available_at, CAST(CASE WHEN b = 18 THEN 8 ELSE w % 3 END AS INT) AS activation_attempts,
       CAST(8 AS INT) AS max_activation_attempts, CAST(w % 18 AS INT) AS consecutive_continuations, CASE WHEN b IN (1, 2) THEN 'runtime-1' END AS lease_owner,
       CASE WHEN b IN (1, 2) THEN concat('wf-token-', CAST(w AS {text})) END AS lease_token, CASE WHEN b = 1 THEN {now} + 10000 WHEN b = 2 THEN {now} - 900000 END AS lease_expires_at,
       CASE WHEN b = 11 THEN concat('child:', CAST(CASE WHEN r % 8 = 3 THEN w - 160 * (r {div} 8 % 2) ELSE w END AS {text}), ':5') END AS deduplication_key,
       CASE WHEN b IN (1, 12, 17) AND r % 30 = 0 THEN w + 2 END AS schedule_run_id,
       CASE WHEN b = 0 AND w >= 20 THEN w - 1 - 3 * (CASE WHEN r % 6 = 5 THEN 1 ELSE 0 END) END AS root_workflow_id,
       CASE WHEN b = 0 AND w >= 20 THEN w - 1 - 3 * (CASE WHEN r % 6 = 5 THEN 1 ELSE 0 END) END AS restarted_from_workflow_id,
       CASE WHEN b = 11 THEN w END AS parent_workflow_id, CAST(CASE WHEN b = 11 THEN 5 END AS INT) AS parent_command_sequence, CAST(4 AS INT) AS command_sequence,
       CAST(2 AS INT) AS delivered_event_sequence, t - 2000 AS created_at, t AS updated_at, CASE WHEN b >= 16 THEN {now} END AS completed_at
FROM (SELECT w, w {div} 20 AS r, min(b) AS b, min(t) AS t FROM base GROUP BY w) g
"""

ATTEMPT = """
SELECT id AS activity_id, CAST(i + CASE WHEN id % 89 = 0 THEN 1 ELSE 0 END AS INT) AS attempt_number, lease_owner_or AS worker_id,
       concat(CASE WHEN id % 36 = 0 THEN 'lost-' ELSE 'token-' END, CAST(id AS {text})) AS lease_token, created_at + 1000 * i AS started_at,
       created_at + 1000 * i + 500 AS heartbeat_at, CASE WHEN open THEN NULL ELSE created_at + 1000 * i + 900 END AS finished_at,
       CASE WHEN open THEN NULL WHEN i < attempt_count THEN 'retryable_failure' WHEN status = 'succeeded' THEN 'succeeded' WHEN status = 'dead_lettered' THEN 'dead_lettered'
            WHEN status = 'cancelled' THEN 'operator_cancelled' ELSE 'retryable_failure' END AS outcome,
       CASE WHEN i < attempt_count THEN 'transient' END AS error_category, CAST(NULL AS {text}) AS error_message, CAST(NULL AS {text}) AS provider_result_json
FROM (SELECT a.*, CAST(i AS BIGINT) AS i, coalesce(lease_owner, 'worker-0') AS lease_owner_or, status IN ('running', 'cancelling') AND i = attempt_count AS open
      FROM (SELECT * FROM activity WHERE attempt_count > 0) a {repeat_attempts}) x
"""

PROGRESS = """
SELECT activity_id, attempt_number, CAST(i AS INT) AS sequence, concat('step_', CAST(i AS {text})) AS code, concat('did part ', CAST(i AS {text})) AS description,
       CAST(10 AS INT) AS description_bytes, CAST(i AS BIGINT) AS completed_units, CAST(3 AS BIGINT) AS total_units,
       CASE WHEN i = 3 THEN 'warning' ELSE 'info' END AS severity, CAST(NULL AS {text}) AS metadata_json, started_at + 100 * i AS created_at
FROM (SELECT * FROM activity_attempt WHERE activity_id % 4 > 0) a {repeat_progress}
"""

APPROVAL = """
SELECT w + 1 AS id, w + 1 AS workflow_id, CAST(4 AS INT) AS command_sequence, CASE WHEN r % 7 = 6 THEN 'review' ELSE concat('flow_', CAST(w % 4 AS {text})) END AS kind, CAST(1 + w % 2 AS INT) AS version, '{{"title":"Review"}}' AS prompt_metadata_json,
       '{{"type":"object"}}' AS validation_schema_json, CAST(1 AS INT) AS validation_version,
       CASE WHEN b = 14 AND r % 5 = 1 THEN 'expired' WHEN b = 14 AND r % 5 = 2 OR b = 16 THEN 'resolved' WHEN b IN (12, 14) OR b = 19 AND r % 4 = 0 THEN 'pending' WHEN b = 17 THEN 'expired' ELSE 'cancelled' END AS status, t - 2000 + 3000 AS requested_at,
       CASE w % 3 WHEN 1 THEN {now} - 1 WHEN 2 THEN {now} + 60000 END AS expires_at, CASE WHEN b = 16 THEN '{{"approved":true}}' END AS decision_payload_json,
       CAST(CASE WHEN b = 16 THEN 7 END AS INT) AS decided_by, CAST(NULL AS {text}) AS operator_reason, CASE WHEN b IN (16, 17, 19) THEN {now} END AS resolved_at
FROM (SELECT w, w {div} 20 AS r, min(b) AS b, min(t) AS t FROM base GROUP BY w) g WHERE b IN (12, 14, 16, 17, 19)
"""

TOPIC_LOCK = "SELECT topic, CAST(2 AS INT) AS max_concurrency, CAST({now} AS BIGINT) AS updated_at FROM (VALUES ('purchase'), ('signup'), ('error'), ('click')) v(topic)"

SCHEDULE_STATE = """
SELECT concat('nation_', CAST(n_nationkey AS {text})) AS schedule_key, concat('fp-', CAST(n_nationkey % 3 AS {text})) AS definition_fingerprint, CAST(1 AS INT) AS definition_version,
       CASE WHEN n_nationkey % 7 = 3 THEN '1992-06-01T00:00:00' ELSE '2030-01-31T00:00:00' END AS next_local_occurrence, CAST({now} + 43200000 - 60000 * n_nationkey * 100 AS BIGINT) AS next_occurrence_at, CAST({now} - 43200000 AS BIGINT) AS last_materialized_at,
       CAST(CASE WHEN n_nationkey % 10 = 9 THEN {now} - 1000 END AS BIGINT) AS paused_at, CAST(CASE WHEN n_nationkey % 10 = 9 THEN 1 END AS INT) AS paused_by,
       CAST(NULL AS {text}) AS pause_reason, CAST({now} - 86400000 AS BIGINT) AS created_at, CAST({now} AS BIGINT) AS updated_at
FROM nation
"""

SCHEDULE_RUN = """
SELECT o_orderkey + 1 AS id, concat('nation_', CAST(c_nationkey AS {text})) AS schedule_key, {local_at} AS local_occurrence, due AS scheduled_for, due + 250 AS materialized_at,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 40 = 7 THEN 'queued' WHEN o_orderstatus = 'F' THEN 'started' WHEN o_orderstatus = 'O' THEN 'skipped' ELSE 'coalesced' END AS status,
       CASE WHEN o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_orderkey % 40 = 7 THEN NULL WHEN o_orderstatus = 'O' THEN 'misfire_grace' ELSE 'run_latest' END AS reason, CAST(NULL AS INT) AS actor_id,
       CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 250 + 1 END AS workflow_id, due AS created_at
FROM (SELECT o.*, c_nationkey, {ms_date} + 1000 * (o_orderkey % 86400) AS due FROM orders o JOIN customer ON o_custkey = c_custkey) o
"""

EVENT = """
SELECT row_number() OVER (ORDER BY workflow_id, activity_id, part) AS id, workflow_id, CAST(sequence AS INT) AS sequence,
       CAST(CASE WHEN part <> 1 THEN delivered END AS INT) AS delivery_sequence, event_type, metadata_json, 'system' AS actor_type, CAST(NULL AS {text}) AS actor_id,
       CAST(NULL AS {text}) AS reason, created_at
FROM (
  SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY activity_id, part) AS sequence,
         sum(CASE WHEN part <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY workflow_id ORDER BY activity_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS delivered
  FROM {dealt}(
    SELECT id AS workflow_id, CAST(0 AS BIGINT) AS activity_id, 0 AS part, 'started' AS event_type, '{{}}' AS metadata_json, created_at FROM workflow
    UNION ALL SELECT workflow_id, id, 1, 'activity_scheduled', concat('{{"data":{{"command_sequence":', CAST(command_sequence AS {text}), '}}}}'), created_at FROM activity
    UNION ALL SELECT workflow_id, id, 2, 'activity_succeeded', concat('{{"data":{{"command_sequence":', CAST(command_sequence + CASE WHEN id % 97 = 1 THEN 50 ELSE 0 END AS {text}), '}}}}'), completed_at FROM activity WHERE status = 'succeeded'
  ){dealt_end} l
) e
"""
#: The log's id there orders all rows in one window; in Spark it is built from workflow and sequence instead.
EVENT_ID = "workflow_id * 1000 + sequence"

SQL = {
    "base": BASE, "activity": ACTIVITY, "workflow": WORKFLOW, "activity_attempt": ATTEMPT, "progress_event": PROGRESS, "approval": APPROVAL, "topic_lock": TOPIC_LOCK,
    "schedule_state": SCHEDULE_STATE, "schedule_run": SCHEDULE_RUN, "workflow_event": EVENT.replace("row_number() OVER (ORDER BY workflow_id, activity_id, part)", EVENT_ID),
}


def _filled(text: str, words: dict) -> str:
    return text.format(
        now=NOW, div=words["div"], k=words["k"], ms_ts=words["ms"].format("ts"), ms_date=words["ms"].format("o_orderdate"), text="STRING" if words is SPARK else "VARCHAR",
        dealt=words["dealt"], dealt_end=words["dealt_end"],
        repeat_attempts=words["repeat"].format("attempt_count"), repeat_progress=words["repeat"].format("CAST(activity_id % 4 AS INT)"), local_at=words["local"].format("(CASE WHEN o_orderkey % 20 = 0 THEN due - due % 2592000000 ELSE due END)"),
    )


#: Which tables each is made of.
NEEDS = {
    "base": ["events"], "activity": ["base"], "workflow": ["base"], "activity_attempt": ["activity"], "progress_event": ["activity_attempt"], "approval": ["base"], "topic_lock": [],
    "schedule_state": ["nation"], "schedule_run": ["orders", "customer"], "workflow_event": ["workflow", "activity"],
}


class Snapshot:
    """The derived tables over one folder of the star schema, as DataFrames, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.now = spark, sf_dir, NOW

    @functools.cache  # noqa: B019
    def __call__(self, name: str) -> DataFrame:
        if name not in SQL:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text, args = _filled(SQL[name], SPARK).replace("{", "{{").replace("}", "}}"), {}
        text = text.replace(":parts", self.spark.conf.get("spark.sql.shuffle.partitions"))
        for need in NEEDS[name]:
            # The name of a table it needs becomes a DataFrame parameter.
            text = re.sub(rf"\b(FROM|JOIN) {need}\b", rf"\1 {{{need}}}", text)
            args[need] = self(need)
        return self.spark.sql(text, **args)


def duck(query: str) -> str:
    """``query`` with the derived tables it needs in front, for DuckDB."""
    need: list[str] = []

    def add(name: str):
        for x in NEEDS[name]:
            if x in SQL:
                add(x)
        if name not in need:
            need.append(name)

    for name in SQL:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", query):
            add(name)
    head = ", ".join(f"{name} AS MATERIALIZED ({_filled(SQL[name], DUCK)})" for name in need)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
