"""Registered queries over the derived workflow tables, each with the same result in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import audits, health, lineage, lists, metrics, timeline
from .plans import schedules, work
from .sources.derived import NOW, Snapshot, duck
from .streaming import log

STALE = 300_000
TOPICS = ["click", "error", "purchase", "signup", "view"]
WORKFLOW_DEFS = [("flow_0", 1), ("flow_1", 2), ("flow_2", 1)]
ACTIVITY_DEFS = [(f"activity_{t}", v, t) for t in TOPICS[:4] for v in (1, 2) if (t, v) != ("error", 2)] + [("activity_audit", 1, "audit")]
LOCAL = [("click", 1), ("error", 40), ("purchase", 40), ("signup", 2), ("view", 40)]

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function of a snapshot under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Snapshot(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql.replace(":now", str(NOW)).replace(":stale", str(NOW - STALE)))
        return f

    return add


def topics(s):
    return s.spark.createDataFrame([(t, 2) for t in TOPICS], "topic string, configured_max int")


def workflow_defs(s):
    return s.spark.createDataFrame(WORKFLOW_DEFS, "kind string, version int")


def activity_defs(s):
    return s.spark.createDataFrame(ACTIVITY_DEFS, "kind string, version int, topic string")


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


TOPIC_SQL = f"(VALUES {values((t, 2) for t in TOPICS)}) t(topic, configured_max)"
TERMINAL = "('succeeded', 'failed', 'cancelled')"
RESOLVED = "SELECT coalesce(root_activity_id, id) FROM activity WHERE status = 'succeeded'"
AWAITED = "SELECT a.* FROM activity a JOIN workflow w ON w.id = a.workflow_id AND w.wait_reference_id = a.id AND w.status = 'waiting_activity' WHERE a.status = 'pending'"


@query(f"""
WITH run AS (
  SELECT a.topic, count(*) AS active, min(t.started_at) AS oldest FROM activity a LEFT JOIN activity_attempt t ON t.activity_id = a.id AND t.attempt_number = a.attempt_count
  WHERE a.status IN ('running', 'cancelling') AND a.lease_expires_at > :now GROUP BY a.topic
), wait AS (
  SELECT topic, count(*) FILTER (available_at <= :now) AS ready, count(*) FILTER (available_at > :now AND attempt_count > 0) AS retry_scheduled,
         min(CASE WHEN available_at = 0 THEN created_at ELSE available_at END) FILTER (available_at <= :now) AS oldest FROM ({AWAITED}) x GROUP BY topic
), dead AS (
  SELECT a.topic, count(*) AS n FROM activity a JOIN workflow w ON w.id = a.workflow_id WHERE a.status = 'dead_lettered' AND w.status NOT IN {TERMINAL}
  AND coalesce(a.root_activity_id, a.id) NOT IN ({RESOLVED}) GROUP BY a.topic
)
SELECT t.topic, coalesce(c.max_concurrency, t.configured_max)::BIGINT AS max_concurrency, t.configured_max::BIGINT AS configured_max, c.max_concurrency IS DISTINCT FROM t.configured_max AS configuration_mismatch,
       coalesce(active, 0)::BIGINT AS active, greatest(coalesce(c.max_concurrency, t.configured_max) - coalesce(active, 0), 0)::BIGINT AS available, coalesce(ready, 0)::BIGINT AS ready,
       coalesce(retry_scheduled, 0)::BIGINT AS retry_scheduled, coalesce(dead.n, 0)::BIGINT AS dead_letters, greatest(:now - wait.oldest, 0) AS oldest_ready_age, greatest(:now - run.oldest, 0) AS oldest_active_age
FROM {TOPIC_SQL} LEFT JOIN topic_lock c USING (topic) LEFT JOIN run USING (topic) LEFT JOIN wait USING (topic) LEFT JOIN dead USING (topic)
""")  # fmt: skip
def topic_metrics(s):
    return metrics.topic_metrics(topics(s), s("activity"), s("workflow"), s("activity_attempt"), s("topic_lock"), s.now)


@query(f"""
SELECT t.topic, h AS bucket_start, count(a.id)::BIGINT AS completed
FROM {TOPIC_SQL}, unnest(range(:now - :now % 3600000 - 23 * 3600000, :now + 1, 3600000)) x(h)
LEFT JOIN activity a ON a.topic = t.topic AND a.completed_at >= h AND a.completed_at < least(h + 3600000, :now + 1) GROUP BY t.topic, h
""")
def topic_hourly_throughput(s):
    return metrics.hourly_throughput(topics(s), s("activity"), s.now)


WF_COLS = ", ".join(lists.WORKFLOW_COLUMNS)
ACT_COLS = ", ".join(lists.ACTIVITY_COLUMNS)
SHOWN = "CASE WHEN available_at = 0 THEN created_at ELSE available_at END AS available_at"
WF_LIST = f"SELECT {WF_COLS}, {SHOWN}, strlen(input_json) AS input_bytes, strlen(state_json) AS state_bytes, strlen(result_json) AS result_bytes FROM workflow"
ACT_LIST = f"SELECT {ACT_COLS}, {SHOWN}, strlen(payload_json) AS payload_bytes, strlen(provider_result_json) AS provider_result_bytes FROM activity"


@query(f"{WF_LIST} WHERE kind = 'flow_1' AND version = 2 AND created_at >= :now - 864000000 ORDER BY created_at DESC, id DESC LIMIT 50")
def workflow_page(s):
    rows = lists.workflow_filter(s("workflow"), kind="flow_1", version=2, created_after=NOW - 864_000_000)
    return lists.page(lists.workflow_summaries(rows), "created_at", 50)


@query(f"""
WITH first AS (SELECT created_at AS t, id AS i FROM workflow ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 49)
SELECT * FROM ({WF_LIST}) w WHERE EXISTS (SELECT 1 FROM first WHERE created_at < t OR created_at = t AND w.id < i) ORDER BY created_at DESC, id DESC LIMIT 50
""")
def workflow_page_keyset_second(s):
    _, after = lists.fetch_page(s("workflow").select("id", "created_at"), "workflows", "created_at", 50)
    from .functions.cursor import decode_number

    return lists.page(lists.workflow_summaries(s("workflow")), "created_at", 50, decode_number(after, "workflows"))


@query(f"{WF_LIST} WHERE wait_kind <> 'approval' OR wait_kind IS NULL")
def workflow_not_waiting_approval(s):
    return lists.workflow_summaries(lists.workflow_filter(s("workflow"), waiting_approval=False))


@query(f"{WF_LIST} WHERE wait_kind = 'approval'")
def workflow_waiting_approval(s):
    return lists.workflow_summaries(lists.workflow_filter(s("workflow"), waiting_approval=True))


@query(f"{ACT_LIST} WHERE topic = 'click' AND status = 'succeeded' ORDER BY created_at DESC, id DESC LIMIT 100")
def activity_page(s):
    return lists.page(lists.activity_summaries(lists.where_equal(s("activity"), topic="click", status="succeeded")), "created_at", 100)


EFFECTIVE = "CASE WHEN status = 'pending' AND expires_at <= :now THEN 'expired' ELSE status END"
APPR_LIST = f"SELECT id, workflow_id, command_sequence, kind, version, {EFFECTIVE} AS status, requested_at, expires_at, decided_by, resolved_at, strlen(prompt_metadata_json) AS prompt_bytes, strlen(decision_payload_json) AS decision_bytes FROM approval"


@query(f"SELECT * FROM ({APPR_LIST}) x WHERE status = 'expired' ORDER BY requested_at DESC, id DESC LIMIT 50")
def approval_page(s):
    return lists.page(lists.approvals(s("approval"), s.now, "expired"), "requested_at", 50)


@query(f"SELECT {EFFECTIVE} AS status, count(*) AS n FROM approval GROUP BY 1")
def approval_effective_status(s):
    return lists.approvals(s("approval"), s.now).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM schedule_run WHERE schedule_key = 'nation_3' ORDER BY scheduled_for DESC, id DESC LIMIT 50")
def schedule_run_page(s):
    return lists.page(lists.where_equal(s("schedule_run"), schedule_key="nation_3"), "scheduled_for", 50)


@query("SELECT * EXCLUDE (provider_result_json) FROM activity_attempt WHERE activity_id = 6 ORDER BY attempt_number LIMIT 50")
def attempt_page(s):
    return lists.attempts_page(s("activity_attempt"), 6)


@query("SELECT * EXCLUDE (metadata_json) FROM progress_event WHERE activity_id = 7 AND (attempt_number, sequence) > (1, 1) ORDER BY attempt_number, sequence LIMIT 50")
def progress_page(s):
    return lists.progress_page(s("progress_event"), 7, after=(1, 1))


@query("SELECT topic, max_concurrency FROM topic_lock WHERE topic > 'click' ORDER BY topic LIMIT 2")
def topic_page(s):
    return lists.key_page(s("topic_lock").select("topic", "max_concurrency"), "topic", 2, "click")


@query("SELECT * FROM workflow WHERE id = 17")
def workflow_detail(s):
    return lists.by_id(s("workflow"), 17)


@query("SELECT * FROM activity WHERE id = 42")
def activity_detail(s):
    return lists.by_id(s("activity"), 42)


@query("SELECT id, kind, status FROM workflow WHERE kind = 'flow_3' AND deduplication_key = 'child:11:5'")
def workflow_by_key(s):
    return lists.by_deduplication_key(s("workflow"), "flow_3", "child:11:5").select("id", "kind", "status")


@query("""
WITH all_entries AS (
  SELECT workflow_id, created_at AS occurred_at, 'event' AS source, 0 AS rank, '0:' || lpad(id::VARCHAR, 20, '0') AS tie_breaker, event_type AS label, strlen(metadata_json) AS bytes FROM workflow_event
  UNION ALL SELECT workflow_id, created_at, 'activity', 1, '1:' || lpad(id::VARCHAR, 20, '0'), kind, strlen(payload_json) FROM activity
  UNION ALL SELECT workflow_id, started_at, 'attempt', 2, '2:' || lpad(activity_id::VARCHAR, 20, '0') || ':' || lpad(attempt_number::VARCHAR, 20, '0'), t.worker_id, NULL FROM activity_attempt t JOIN activity a ON a.id = t.activity_id
  UNION ALL SELECT workflow_id, p.created_at, 'progress', 3, '3:' || lpad(activity_id::VARCHAR, 20, '0') || ':' || lpad(attempt_number::VARCHAR, 20, '0') || ':' || lpad(p.sequence::VARCHAR, 20, '0'), code, strlen(p.metadata_json) FROM progress_event p JOIN activity a ON a.id = p.activity_id
  UNION ALL SELECT workflow_id, requested_at, 'approval', 4, '4:' || lpad(id::VARCHAR, 20, '0'), kind, strlen(prompt_metadata_json) FROM approval
)
SELECT * FROM all_entries
""")  # fmt: skip
def timeline_entries(s):
    out = timeline.entries(s("workflow_event"), s("activity"), s("activity_attempt"), s("progress_event"), s("approval"))
    return out.select("workflow_id", "occurred_at", "source", "rank", "tie_breaker", "label", "bytes")


@query("""
WITH e AS (
  SELECT created_at AS occurred_at, '0:' || lpad(id::VARCHAR, 20, '0') AS tie_breaker FROM workflow_event WHERE workflow_id = 13
  UNION ALL SELECT created_at, '1:' || lpad(id::VARCHAR, 20, '0') FROM activity WHERE workflow_id = 13
  UNION ALL SELECT started_at, '2:' || lpad(activity_id::VARCHAR, 20, '0') || ':' || lpad(attempt_number::VARCHAR, 20, '0') FROM activity_attempt t JOIN activity a ON a.id = t.activity_id WHERE workflow_id = 13
  UNION ALL SELECT p.created_at, '3:' || lpad(activity_id::VARCHAR, 20, '0') || ':' || lpad(attempt_number::VARCHAR, 20, '0') || ':' || lpad(p.sequence::VARCHAR, 20, '0') FROM progress_event p JOIN activity a ON a.id = p.activity_id WHERE workflow_id = 13
  UNION ALL SELECT requested_at, '4:' || lpad(id::VARCHAR, 20, '0') FROM approval WHERE workflow_id = 13
)
SELECT * FROM e ORDER BY occurred_at, tie_breaker LIMIT 20
""")  # fmt: skip
def workflow_timeline(s):
    out = timeline.entries(s("workflow_event"), s("activity"), s("activity_attempt"), s("progress_event"), s("approval"), 13)
    return timeline.timeline_page(out, 20).select("occurred_at", "tie_breaker")


REGISTERED = [(f"nation_{k}", f"fp-{k % 3 if k % 7 else 9}", 1) for k in range(3, 28)]


def registered_schedules(s):
    return s.spark.createDataFrame(REGISTERED, "schedule_key string, fingerprint string, version int")


@query(f"""
WITH r AS (SELECT * FROM (VALUES {values(REGISTERED)}) v(schedule_key, fingerprint, version)), c AS (
  SELECT schedule_key, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'coalesced') AS coalesced, arg_max(id, (scheduled_for, id)) AS last_run_id FROM schedule_run GROUP BY 1
), o AS (SELECT schedule_key, count(*) AS active_overlap FROM schedule_run q JOIN workflow w ON w.schedule_run_id = q.id WHERE w.status NOT IN {TERMINAL} GROUP BY 1)
SELECT schedule_key, CASE WHEN st.definition_version IS NULL THEN 'missing_state' WHEN r.version IS NULL THEN 'unregistered_state'
         WHEN fingerprint <> definition_fingerprint OR version <> definition_version THEN 'definition_mismatch' END AS issue,
       st.paused_at IS NOT NULL AS paused, next_occurrence_at, coalesce(active_overlap, 0)::BIGINT AS active_overlap, coalesce(skipped, 0)::BIGINT AS skipped, coalesce(coalesced, 0)::BIGINT AS coalesced, last_run_id
FROM r FULL JOIN schedule_state st USING (schedule_key) LEFT JOIN c USING (schedule_key) LEFT JOIN o USING (schedule_key)
""")  # fmt: skip
def schedule_summary(s):
    return metrics.schedule_summary(registered_schedules(s), s("schedule_state"), s("schedule_run"), s("workflow"))


@query("""
SELECT q.schedule_key, rn, q.id, local_occurrence, scheduled_for, q.status, q.reason, q.workflow_id, w.status AS workflow_status, w.completed_at AS workflow_completed_at
FROM (SELECT *, row_number() OVER (PARTITION BY schedule_key ORDER BY scheduled_for DESC, id DESC)::INT AS rn FROM schedule_run) q LEFT JOIN workflow w ON w.id = q.workflow_id WHERE rn <= 5
""")
def schedule_recent_runs(s):
    return metrics.recent_runs(s("schedule_run"), s("workflow"), 5)


WF_DEF_SQL = f"(VALUES {values(WORKFLOW_DEFS)}) d(kind, version)"
ACT_DEF_SQL = f"(VALUES {values(ACTIVITY_DEFS)}) d(kind, version, topic)"
READINESS = f"""
work AS (
  SELECT kind, version, topic FROM activity WHERE status IN ('pending', 'running', 'cancelling')
  UNION ALL SELECT a.kind, a.version, a.topic FROM activity a JOIN workflow w ON w.id = a.workflow_id AND w.wait_reference_id = a.id WHERE a.status = 'dead_lettered' AND w.status IN ('blocked', 'paused') AND w.wait_kind = 'activity'
), missing AS (
  SELECT 'workflow_definition' AS missing, kind AS name, version FROM (SELECT DISTINCT kind, version FROM workflow WHERE status NOT IN {TERMINAL}) w ANTI JOIN {WF_DEF_SQL} USING (kind, version)
  UNION ALL SELECT 'activity_definition', kind, version FROM (SELECT DISTINCT kind, version FROM work) w ANTI JOIN {ACT_DEF_SQL} USING (kind, version)
  UNION ALL SELECT 'topic', topic, NULL FROM (SELECT topic FROM work UNION SELECT topic FROM {ACT_DEF_SQL}) w ANTI JOIN {TOPIC_SQL} USING (topic)
)
"""  # fmt: skip


def missing(s):
    return health.readiness(s("workflow"), s("activity"), workflow_defs(s), activity_defs(s), topics(s).select("topic"))


@query(f"WITH {READINESS} SELECT * FROM missing")
def readiness_missing(s):
    return missing(s)


@query(f"""
WITH {READINESS},
a1 AS (SELECT 'activation_exhausted' AS alert, id AS entity_id, kind AS name, version FROM workflow WHERE status = 'failed' AND error_category = 'activation' ORDER BY id LIMIT 25),
a2 AS (SELECT 'activity_dead_lettered', id, kind, version FROM activity WHERE status = 'dead_lettered' AND coalesce(root_activity_id, id) NOT IN ({RESOLVED}) ORDER BY id LIMIT 25),
a3 AS (SELECT 'stale_workflow', id, kind, version FROM workflow WHERE status = 'running' AND (lease_expires_at <= :stale OR lease_expires_at IS NULL) ORDER BY id LIMIT 25),
a4 AS (SELECT 'stale_activity', id, kind, version FROM activity WHERE status IN ('running', 'cancelling') AND (lease_expires_at <= :stale OR lease_expires_at IS NULL) ORDER BY id LIMIT 25)
SELECT 'missing_' || missing AS alert, NULL::BIGINT AS entity_id, name, version FROM (SELECT *, row_number() OVER (PARTITION BY missing ORDER BY name, version) AS nth FROM missing) m WHERE nth <= 25 UNION ALL FROM a1 UNION ALL FROM a2 UNION ALL FROM a3 UNION ALL FROM a4
""")  # fmt: skip
def health_alerts(s):
    return health.health_alerts(s("workflow"), s("activity"), missing(s), s.now, STALE)


@query(f"SELECT topic, count(*) AS n FROM activity WHERE status = 'dead_lettered' AND coalesce(root_activity_id, id) NOT IN ({RESOLVED}) GROUP BY topic")
def health_dead_letters(s):
    return metrics.unresolved_dead_letters(s("activity")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.wait_reference_id AS child_id, p.id AS parent_id, c.status AS child_status FROM workflow p JOIN workflow c ON c.id = p.wait_reference_id WHERE p.wait_kind = 'child' AND p.status IN ('waiting_child', 'paused')")
def waiting_parents(s):
    return lineage.waiting_parents(s("workflow"))


@query("""
WITH RECURSIVE c AS (SELECT id AS origin, id, 0 AS depth FROM workflow UNION ALL SELECT origin, w.id, depth + 1 FROM c JOIN workflow w ON w.restarted_from_workflow_id = c.id)
SELECT origin, id, depth FROM c WHERE id NOT IN (SELECT restarted_from_workflow_id FROM workflow WHERE restarted_from_workflow_id IS NOT NULL)
""")
def restart_chain(s):
    return lineage.newest_generation(s("workflow"))


@query("""
WITH RECURSIVE c AS (SELECT id AS origin, id, 0 AS depth FROM workflow
  UNION ALL SELECT origin, coalesce(parent_workflow_id, restarted_from_workflow_id), depth + 1 FROM c JOIN workflow w ON w.id = c.id WHERE coalesce(parent_workflow_id, restarted_from_workflow_id) IS NOT NULL)
SELECT origin, id, depth FROM c
""")  # fmt: skip
def ancestors(s):
    return lineage.ancestors(s("workflow"))


@query("""
WITH first AS (SELECT parent_workflow_id AS p, id AS c FROM workflow WHERE deduplication_key = 'child:' || parent_workflow_id || ':' || parent_command_sequence),
one AS (SELECT p AS origin, c AS id, 1 AS depth FROM first WHERE p <= 500), two AS (SELECT origin, w.id, 2 AS depth FROM one JOIN workflow w ON w.restarted_from_workflow_id = one.id)
SELECT * FROM one UNION SELECT * FROM two
""")
def owned_descendants(s):
    return lineage.owned_descendants(s("workflow"), s("workflow").where("id <= 500").select("id"))


@query(f"""
WITH seen AS (
  SELECT topic, id, attempt_count < max_attempts AS fit, row_number() OVER (PARTITION BY topic ORDER BY available_at, CASE WHEN available_at = 0 THEN workflow_id ELSE id END, id) AS place
  FROM ({AWAITED}) x WHERE available_at <= :now AND EXISTS (SELECT 1 FROM {ACT_DEF_SQL} WHERE d.kind = x.kind AND d.version = x.version)
), numbered AS (SELECT *, sum(fit::INT) OVER (PARTITION BY topic ORDER BY place) AS nth FROM seen WHERE place <= 32
), want AS (
  SELECT topic, least(count(*) FILTER (fit), max(least(greatest(c.max_concurrency - coalesce(f.n, 0), 0), l.capacity))) AS want
  FROM numbered JOIN topic_lock c USING (topic) JOIN (VALUES {values(LOCAL)}) l(topic, capacity) USING (topic)
  LEFT JOIN (SELECT topic, count(*) AS n FROM activity WHERE status IN ('running', 'cancelling') AND lease_expires_at > :now GROUP BY topic) f USING (topic) GROUP BY topic
), gets AS (SELECT topic, greatest(least(want, 30 - coalesce(sum(want) OVER (ORDER BY topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS gets FROM want)
SELECT topic, id AS activity_id, place, CASE WHEN fit THEN 'claim' ELSE 'quarantine_attempt_cap' END AS decision FROM numbered JOIN gets USING (topic) WHERE NOT fit OR nth <= gets
""".replace("c.max_concurrency -", "40 * c.max_concurrency -"))  # fmt: skip
def claim_plan(s):
    caps = s("topic_lock").withColumn("max_concurrency", F.col("max_concurrency") * 40)  # the stored caps are all in use
    local = s.spark.createDataFrame(LOCAL, "topic string, capacity int")
    return work.claim_plan(s("activity"), s("workflow"), caps, activity_defs(s), local, s.now, batch=30)


@query(f"SELECT id AS workflow_id, available_at FROM workflow w WHERE status = 'ready' AND available_at <= :now AND EXISTS (SELECT 1 FROM {WF_DEF_SQL} WHERE d.kind = w.kind AND d.version = w.version) ORDER BY available_at, id LIMIT 32")
def workflow_claim_plan(s):
    return work.workflow_claim_plan(s("workflow"), workflow_defs(s), s.now)


@query("SELECT id AS workflow_id, 'ready' AS to_status, :now::BIGINT AS available_at FROM workflow WHERE status = 'running' AND lease_expires_at <= :now")
def recover_plan(s):
    return work.recover_workflows(s("workflow"), s.now)


def delay_sql(seed: str, attempt: str) -> str:
    """Milliseconds of the stored policy: 2 s fixed, or 40 s doubled up to 300 s with 20 per cent of jitter; null for a fixed delay of nothing."""
    pct = f"((('0x' || substr(sha256({seed}), 3, 2))::INT * 256 + ('0x' || substr(sha256({seed}), 1, 2))::INT) % 101)"
    base = f"least(40 * (1 << greatest({attempt} - 1, 0)), 300)"
    x = f"(({base} * 20 // 100) * (2 * {pct} - 100))"
    return f"(CASE WHEN retry_policy_json LIKE '%\"delay_secs\":0%' THEN NULL WHEN retry_policy_json LIKE '%Fixed%' THEN 2000 ELSE 1000 * ({base} + sign({x}) * (abs({x}) // 100)) END)"


@query(f"""
WITH y AS (
  SELECT a.*, w.id AS wid, CASE WHEN a.status = 'cancelling' THEN 'cancelled' WHEN attempt_count < max_attempts THEN 'pending' ELSE 'dead_lettered' END AS to_status
  FROM activity a LEFT JOIN workflow w ON w.id = a.workflow_id AND w.wait_reference_id = a.id AND w.status = 'waiting_activity'
  WHERE a.status IN ('running', 'cancelling') AND (a.lease_expires_at <= :now OR a.lease_expires_at IS NULL)
)
SELECT id AS activity_id, status AS from_status, to_status, 'lease_expired' AS reason,
       CASE WHEN to_status = 'pending' THEN :now + coalesce({delay_sql("'activity:' || id || ':lease_recovery:' || attempt_count", "attempt_count")}, 0) END::BIGINT AS available_at,
       to_status = 'dead_lettered' AND wid IS NOT NULL AS blocks_workflow FROM y
""")  # fmt: skip
def reconcile_plan(s):
    return work.reconcile_plan(s("activity"), s("workflow"), s.now)


@query("SELECT id AS workflow_id, available_at, 'timer_fired' AS event FROM workflow WHERE status = 'sleeping' AND wait_kind = 'timer' AND available_at <= :now")
def due_timers(s):
    return work.due_timers(s("workflow"), s.now)


@query("""
SELECT a.id AS approval_id, a.workflow_id, a.expires_at, w.id IS NOT NULL AS awaited FROM approval a
LEFT JOIN workflow w ON w.id = a.workflow_id AND w.wait_reference_id = a.id AND w.wait_kind = 'approval' AND w.status IN ('waiting_approval', 'paused') WHERE a.status = 'pending' AND a.expires_at <= :now
""")
def due_approvals(s):
    return work.due_approvals(s("approval"), s("workflow"), s.now)


@query("SELECT workflow_id, min(delivery_sequence) AS delivery_sequence, arg_min(event_type, delivery_sequence) AS event_type FROM workflow_event e JOIN workflow w ON w.id = e.workflow_id WHERE delivery_sequence > delivered_event_sequence GROUP BY 1")
def next_event(s):
    return work.next_events(s("workflow"), s("workflow_event"))


@query("SELECT workflow_id, max(sequence) + 1 AS next_sequence FROM workflow_event GROUP BY 1")
def event_sequence_floor(s):
    return work.sequence_floor(s("workflow_event"))


OUTCOMES = "CASE id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'retryable' ELSE 'permanent' END"


@query(f"""
WITH o AS (SELECT *, {OUTCOMES} AS outcome FROM activity WHERE status IN ('running', 'cancelling')),
x AS (SELECT *, CASE WHEN status = 'cancelling' THEN 'cancelled' WHEN outcome = 'succeeded' THEN 'succeeded' WHEN outcome = 'retryable' AND attempt_count < max_attempts THEN 'pending' ELSE 'dead_lettered' END AS to_status FROM o)
SELECT id AS activity_id, to_status, CASE WHEN to_status = 'pending' THEN :now + {delay_sql("'activity:' || id || ':retry:' || attempt_count", "attempt_count")} END::BIGINT AS available_at FROM x
""")  # fmt: skip
def finish_plan(s):
    a = s("activity")
    return work.finish_plan(a.where(F.col("status").isin("running", "cancelling")).select(F.col("id").alias("activity_id"), F.expr(OUTCOMES).alias("outcome")), a, s.now)


@query("""
WITH x AS (SELECT id, activation_attempts + 1 AS n, max_activation_attempts AS most, sha256('workflow:' || id || ':activation:' || (activation_attempts + 1)) AS h FROM workflow WHERE status IN ('running', 'failed')),
y AS (SELECT *, least(1 << (n - 1), 60) AS base, 2 * ((('0x' || substr(h, 3, 2))::INT * 256 + ('0x' || substr(h, 1, 2))::INT) % 101) - 100 AS sway FROM x)
SELECT id AS workflow_id, n AS attempts, CASE WHEN n >= least(most, 8) THEN 'failed' ELSE 'ready' END AS to_status,
       (:now + 1000 * (base + sign((base * 20 // 100) * sway) * (abs((base * 20 // 100) * sway) // 100)))::BIGINT AS available_at FROM y
""")
def activation_failure_plan(s):
    wf = s("workflow")
    return work.activation_failure_plan(wf, wf.where("status IN ('running', 'failed')").select("id"), s.now)


@query("""
SELECT a.id AS activity_id, w.id AS workflow_id, coalesce(a.root_activity_id, a.id) AS root_id, a.replacement_number + 1 AS replacement_number,
       'durable:activity:' || coalesce(a.root_activity_id, a.id) || ':correction:' || (a.replacement_number + 1) AS correction_key
FROM workflow w JOIN activity a ON a.id = w.wait_reference_id AND a.workflow_id = w.id WHERE w.status = 'blocked' AND w.wait_kind = 'activity' AND a.status = 'dead_lettered'
""")
def retry_plan(s):
    return work.retry_plan(s("activity"), s("workflow"))


@query("""
SELECT a.id AS approval_id, a.workflow_id, CASE WHEN a.status <> 'pending' THEN 'already_' || a.status WHEN a.expires_at <= :now THEN 'expired' WHEN w.id IS NOT NULL THEN 'resolve' ELSE 'no_longer_matches' END AS decision
FROM approval a LEFT JOIN workflow w ON w.id = a.workflow_id AND w.status IN ('waiting_approval', 'paused') AND w.wait_kind = 'approval' AND w.wait_reference_id = a.id AND w.kind = a.kind AND w.version = a.version
""")
def approval_plan(s):
    return work.approval_plan(s("approval"), s("workflow"), s.now)


@query("SELECT schedule_key, CASE WHEN paused_at IS NULL THEN 'pause' ELSE 'resume' END AS action, CASE WHEN paused_at IS NULL THEN 'paused' ELSE 'active' END AS next_status FROM schedule_state")
def schedule_pause_plan(s):
    return schedules.pause_plan(s("schedule_state"))


@query(f"""
WITH going AS (SELECT DISTINCT q.schedule_key FROM schedule_run q JOIN workflow w ON w.schedule_run_id = q.id WHERE w.status NOT IN {TERMINAL}),
q AS (SELECT schedule_key, id, row_number() OVER (PARTITION BY schedule_key ORDER BY scheduled_for, id) AS nth FROM schedule_run WHERE status = 'queued')
SELECT schedule_key, id AS run_id FROM q WHERE nth = 1 AND schedule_key NOT IN (SELECT schedule_key FROM going)
""")
def promotions(s):
    return schedules.promotions(s("schedule_run"), s("workflow"))


@query("""
SELECT id, error_category IS NOT NULL AS present, coalesce(strlen(error_category), 0) AS bytes, CASE WHEN error_category LIKE 'é%' THEN 'éé' ELSE substr(error_category, 1, 5) END AS cut_text,
       regexp_full_match(kind, '[a-z0-9][a-z0-9._-]*') AS topic_key, regexp_full_match(kind || '_', '[a-z0-9]+(_[a-z0-9]+)*') AS schedule_key FROM workflow
""")
def text_functions(s):
    summary = X.json_summary("error_category")
    return s("workflow").select("id", summary["present"].alias("present"), summary["bytes"].alias("bytes"), X.truncate_bytes(F.col("error_category"), 5).alias("cut_text"), X.valid_topic_key(F.col("kind")).alias("topic_key"), X.valid_schedule_key(F.concat("kind", F.lit("_"))).alias("schedule_key"))


@query(f"""
WITH t AS (SELECT 'activity' AS wait_kind, id, status FROM activity UNION ALL SELECT 'child', id, status FROM workflow UNION ALL SELECT 'approval', id, status FROM approval),
x AS (SELECT w.id, w.wait_kind AS k, t.status AS s FROM workflow w LEFT JOIN t ON t.wait_kind = w.wait_kind AND t.id = w.wait_reference_id WHERE w.status = 'paused'),
y AS (SELECT *, CASE WHEN k IS NULL THEN 'ready' WHEN k = 'timer' THEN 'sleeping' WHEN k = 'activity' AND s IN ('pending', 'running', 'cancelling') THEN 'waiting_activity' WHEN k = 'activity' AND s = 'dead_lettered' THEN 'blocked'
  WHEN k = 'activity' AND s = 'succeeded' THEN 'ready' WHEN k = 'child' AND s NOT IN {TERMINAL} THEN 'waiting_child' WHEN k = 'approval' AND s = 'pending' THEN 'waiting_approval' WHEN k = 'approval' AND s IS NOT NULL THEN 'ready' END AS to_status FROM x)
SELECT id AS workflow_id, to_status, CASE WHEN to_status IS NULL THEN coalesce(s, 'missing') || '_' || k END AS refusal FROM y
""")  # fmt: skip
def resume_plan(s):
    return work.resume_plan(s("workflow"), s("activity"), s("approval"))


@query("SELECT id, kind, version, status FROM workflow w WHERE status IN ('succeeded', 'failed', 'cancelled', 'paused', 'blocked') AND NOT EXISTS (SELECT 1 FROM workflow n WHERE n.restarted_from_workflow_id = w.id)")
def restart_eligible(s):
    return audits.restartable(s("workflow"))


@query("""
WITH q AS (SELECT DISTINCT kind, 'child:' || (id - 1) || ':5' AS deduplication_key FROM workflow WHERE id <= 400)
SELECT q.kind, q.deduplication_key, CASE WHEN w.id IS NULL THEN 'start' WHEN w.status IN ('failed', 'blocked') THEN 'restart' ELSE 'existing' END AS decision, w.id AS workflow_id FROM q LEFT JOIN workflow w ON w.kind = q.kind AND w.deduplication_key = q.deduplication_key
""")
def start_plan(s):
    requests = s("workflow").where("id <= 400").select("kind", F.concat(F.lit("child:"), (F.col("id") - 1).cast("string"), F.lit(":5")).alias("deduplication_key"))
    return work.start_plan(requests, s("workflow"), lineage.newest_generation(s("workflow")))


@query("""
SELECT schedule_key, max(scheduled_for) AS last, greatest(max(scheduled_for) + 1, :now) AS scheduled_for FROM schedule_run GROUP BY 1
""")
def run_now_plan(s):
    last = s("schedule_run").groupBy("schedule_key").agg(F.max("scheduled_for").alias("last"))
    return schedules.run_now_plan(s("schedule_run"), s.now).join(last, "schedule_key").select("schedule_key", "last", "scheduled_for")


@query("SELECT schedule_key, max(local_occurrence) AS floor FROM schedule_run WHERE local_occurrence NOT LIKE 'manual:%' GROUP BY 1")
def materialized_floor(s):
    return schedules.materialized_floor(s("schedule_run"))


def _due(s):
    return s("schedule_run").select("schedule_key", "local_occurrence", F.col("scheduled_for").alias("due_at"), F.when(F.col("id") % 97 == 0, "gap").otherwise("exact").alias("disposition"), "id").dropDuplicates(["schedule_key", "local_occurrence"])


def _policies(s):
    k = F.col("n_nationkey") % 3
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).otherwise(v[2])
    return s("nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("schedule_key"), pick("skip", "run_latest", "catch_up").alias("misfire"), F.lit(3_600_000_000).alias("grace"), F.lit(3).alias("catch_up"), F.when(F.col("n_nationkey") % 4 == 3, 1).otherwise(0).alias("following"), pick("allow", "skip_if_active", "queue_one").alias("overlap"))


@query("""
WITH due AS (SELECT schedule_key, local_occurrence, min(id) AS id, min(scheduled_for) AS due_at FROM schedule_run GROUP BY 1, 2),
p AS (SELECT 'nation_' || n_nationkey AS schedule_key, n_nationkey % 3 AS m, CASE WHEN n_nationkey % 4 = 3 THEN 1 ELSE 0 END AS following FROM nation),
r AS (SELECT d.*, m, following, CASE WHEN id % 97 <> 0 THEN sum(CASE WHEN id % 97 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY schedule_key ORDER BY local_occurrence DESC) END AS nth FROM due d JOIN p USING (schedule_key)),
o AS (SELECT *, CASE WHEN nth IS NULL OR m = 0 AND due_at + 3600000000 < :now OR m = 2 AND nth > 3 - following THEN 'skip' WHEN m = 1 AND (nth > 1 OR following > 0) THEN 'coalesce' ELSE 'start' END AS outcome FROM r)
SELECT schedule_key, count(*) AS inspected, count(*) FILTER (outcome = 'start') AS started, count(*) FILTER (outcome = 'skip') AS skipped, count(*) FILTER (outcome = 'coalesce') AS coalesced FROM o GROUP BY 1
""")  # fmt: skip
def misfire_report(s):
    due = s("schedule_run").groupBy("schedule_key", "local_occurrence").agg(F.min("id").alias("id"), F.min("scheduled_for").alias("due_at")).withColumn("disposition", F.when(F.col("id") % 97 == 0, "gap").otherwise("exact"))
    return schedules.materialization_report(schedules.classify_misfires(due, _policies(s), s.now)).drop("queued")


@query("""
WITH e AS (SELECT workflow_id, delivery_sequence AS d, CAST(coalesce(json_extract_string(metadata_json, '$.data.command_sequence'), '0') AS INT) AS c, row_number() OVER (PARTITION BY workflow_id ORDER BY delivery_sequence) AS n
  FROM workflow_event WHERE delivery_sequence IS NOT NULL),
m AS (SELECT *, CASE WHEN d <> n THEN 'delivery_order' WHEN c > 0 AND NOT EXISTS (SELECT 1 FROM activity a WHERE a.workflow_id = e.workflow_id AND a.command_sequence = c) THEN 'unknown_command' END AS wrong FROM e)
SELECT workflow_id, coalesce(min(n) FILTER (wrong IS NOT NULL) - 1, count(*)) AS applied, arg_min(wrong, n) FILTER (wrong IS NOT NULL) AS failure FROM m GROUP BY 1
""")
def replay_log(s):
    return log.replay(s("workflow_event"), s("activity").select("workflow_id", "command_sequence", "kind"))


@query("SELECT activity_id, attempt_number, heartbeat_at FROM activity_attempt WHERE finished_at IS NULL AND heartbeat_at <= :now - 86400000")
def silent_attempts(s):
    return log.silent_attempts(s("activity_attempt"), s.now, 86_400_000)


@query("SELECT id, octet_length(encode(payload_json)) AS payload_bytes, 'wf:' || workflow_id || ':step:' || command_sequence AS step_key, lpad(id::VARCHAR, 20, '0') AS padded, created_at // 3600000 * 3600000 AS hour_start, sha256(payload_json) AS digest FROM activity")
def scalar_functions(s):
    a = s("activity")
    return a.select("id", X.byte_length("payload_json").alias("payload_bytes"), X.step_key(F.col("workflow_id"), F.col("command_sequence")).alias("step_key"), F.lpad(F.col("id").cast("string"), 20, "0").alias("padded"), X.hour_start(F.col("created_at")).alias("hour_start"), F.sha2("payload_json", 256).alias("digest"))


SLOTS = "('running', 'cancelling')"
AUDITS = {
    "audit_i1": (lambda s: audits.lease_fields(s("workflow"), s("activity")), f"""
SELECT id AS entity_id, 'workflow' AS detail FROM workflow WHERE (status = 'running') <> (lease_token IS NOT NULL AND lease_expires_at IS NOT NULL) OR (status <> 'running' AND (lease_token IS NOT NULL OR lease_expires_at IS NOT NULL))
UNION ALL SELECT id, 'activity' FROM activity WHERE (status IN {SLOTS}) <> (lease_token IS NOT NULL AND lease_expires_at IS NOT NULL) OR (status NOT IN {SLOTS} AND (lease_token IS NOT NULL OR lease_expires_at IS NOT NULL))"""),
    "audit_i5": (lambda s: audits.delivery(s("workflow"), s("workflow_event")), """
WITH n AS (SELECT w.id, w.status, count(e.delivery_sequence) AS n FROM workflow w LEFT JOIN workflow_event e ON e.workflow_id = w.id AND e.delivery_sequence > w.delivered_event_sequence GROUP BY 1, 2)
SELECT workflow_id AS entity_id, 'duplicate_delivery' AS detail FROM workflow_event WHERE delivery_sequence IS NOT NULL GROUP BY workflow_id, delivery_sequence HAVING count(*) > 1
UNION ALL SELECT id, 'several_undelivered' FROM n WHERE n > 1 UNION ALL SELECT id, 'ready_without_event' FROM n WHERE status = 'ready' AND n = 0"""),
    "audit_i7": (lambda s: audits.wait_coupling(s("workflow")), f"""
SELECT id AS entity_id, status AS detail FROM workflow WHERE (wait_kind IS NULL) <> (wait_reference_id IS NULL) OR status = 'waiting_activity' AND wait_kind IS DISTINCT FROM 'activity' OR status = 'waiting_child' AND wait_kind IS DISTINCT FROM 'child'
OR status = 'sleeping' AND wait_kind IS DISTINCT FROM 'timer' OR status = 'waiting_approval' AND wait_kind IS DISTINCT FROM 'approval' OR (status IN ('ready', 'running') OR status IN {TERMINAL}) AND wait_kind IS NOT NULL"""),
    "audit_i11": (lambda s: audits.open_attempts(s("activity"), s("activity_attempt")), f"""
WITH n AS (SELECT a.id, count(t.activity_id) AS n, count(*) FILTER (t.lease_token = a.lease_token) AS same FROM activity a LEFT JOIN activity_attempt t ON t.activity_id = a.id AND t.outcome IS NULL WHERE a.status IN {SLOTS} GROUP BY 1)
SELECT id AS entity_id, n::VARCHAR AS detail FROM n WHERE n <> 1 OR same <> 1"""),
    "audit_i12": (lambda s: audits.attempt_numbers(s("activity"), s("activity_attempt")), """
WITH n AS (SELECT activity_id, count(*) AS n, min(attempt_number) AS lo, max(attempt_number) AS hi, count(DISTINCT attempt_number) AS d FROM activity_attempt GROUP BY 1)
SELECT id AS entity_id, coalesce(n, 0)::VARCHAR AS detail FROM activity LEFT JOIN n ON activity_id = id WHERE coalesce(n, 0) <> attempt_count OR lo <> 1 OR hi <> n OR d <> n OR attempt_count > max_attempts"""),
    "audit_i15": (lambda s: audits.activity_coupling(s("workflow"), s("activity")), """
SELECT w.id AS entity_id, a.status AS detail FROM workflow w LEFT JOIN activity a ON a.id = w.wait_reference_id WHERE w.wait_kind = 'activity' AND w.status IN ('waiting_activity', 'blocked')
AND NOT coalesce(a.workflow_id = w.id AND CASE WHEN w.status = 'blocked' THEN a.status = 'dead_lettered' ELSE a.status IN ('pending', 'running', 'cancelling') END, false)"""),
    "audit_i17": (lambda s: audits.topic_caps(s("activity"), s("topic_lock"), s.now), f"""
SELECT count(*) AS entity_id, topic AS detail FROM activity JOIN topic_lock c USING (topic) WHERE status IN {SLOTS} AND lease_expires_at > :now GROUP BY topic HAVING count(*) > max(c.max_concurrency)"""),
    "audit_i18": (lambda s: audits.duplicate_keys(s("workflow")), """
SELECT min(id) AS entity_id, deduplication_key AS detail FROM workflow WHERE deduplication_key IS NOT NULL GROUP BY kind, deduplication_key HAVING count(*) > 1"""),
    "audit_i19": (lambda s: audits.successors(s("workflow")), f"""
SELECT n.restarted_from_workflow_id AS entity_id, max(w.status) AS detail FROM workflow n LEFT JOIN workflow w ON w.id = n.restarted_from_workflow_id WHERE n.restarted_from_workflow_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 OR NOT coalesce(max(w.status) IN {TERMINAL}, false)"""),
    "audit_i21": (lambda s: audits.pending_approvals(s("workflow"), s("approval")), """
SELECT a.id AS entity_id, a.kind AS detail FROM approval a WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM workflow w WHERE w.id = a.workflow_id AND w.wait_kind = 'approval' AND w.status IN ('waiting_approval', 'paused') AND w.wait_reference_id = a.id)"""),
    "audit_i24": (lambda s: audits.ended_children(s("workflow")), f"""
SELECT p.id AS entity_id, c.status AS detail FROM workflow p JOIN workflow c ON c.id = p.wait_reference_id WHERE p.wait_kind = 'child' AND p.status IN ('waiting_child', 'paused') AND c.status IN {TERMINAL}"""),
    "audit_i26": (lambda s: audits.duplicate_occurrences(s("schedule_run")), """
SELECT min(id) AS entity_id, local_occurrence AS detail FROM schedule_run GROUP BY schedule_key, local_occurrence HAVING count(*) > 1"""),
    "audit_i27": (lambda s: audits.cursor_floor(s("schedule_state"), s("schedule_run")), """
SELECT max(q.id) AS entity_id, schedule_key AS detail FROM schedule_state st JOIN schedule_run q USING (schedule_key) WHERE local_occurrence NOT LIKE 'manual:%' GROUP BY schedule_key HAVING max(next_local_occurrence) <= max(local_occurrence)"""),
    "audit_i29": (lambda s: audits.queued_runs(s("schedule_run")), """
SELECT min(id) AS entity_id, schedule_key AS detail FROM schedule_run WHERE status = 'queued' GROUP BY schedule_key HAVING count(*) > 1"""),
    "audit_i35": (lambda s: audits.payload_limits(s("workflow")), """
SELECT id AS entity_id, unnest(list_filter([CASE WHEN strlen(input_json) > 262144 THEN 'input_json' END, CASE WHEN strlen(state_json) > 262144 THEN 'state_json' END, CASE WHEN strlen(result_json) > 65536 THEN 'result_json' END,
  CASE WHEN strlen(error_category) > 64 THEN 'error_category' END], lambda x: x IS NOT NULL)) AS detail FROM workflow"""),
}
for _name, (_f, _sql) in AUDITS.items():
    _f.__name__ = _name
    query(_sql)(_f)
