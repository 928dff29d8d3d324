from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowlens.functions import calendar, cursor, exprs
from flowlens.plans import schedules, work
from flowlens.streaming import log


@given(st.integers(0, 2**62), st.integers(1, 2**62))
def test_cursor_round_trip(at, id_):
    assert cursor.decode_number(cursor.encode("workflows", at, str(id_)), "workflows") == (at, id_)


@pytest.mark.parametrize("bad", ["", "%%%", "e30", cursor.encode("other", 1, "2"), "A" * 600])
def test_cursor_rejects(bad):
    with pytest.raises(cursor.CursorError):
        cursor.decode_number(bad, "workflows")


def test_timeline_cursor():
    tie = "3:" + ":".join(f"{x:020d}" for x in (7, 1, 2))
    assert cursor.decode_timeline(cursor.encode("timeline", 5, tie), "timeline") == (5, 3, (7, 1, 2))
    with pytest.raises(cursor.CursorError):
        cursor.decode_timeline(cursor.encode("timeline", 5, "1:1"), "timeline")


def test_limits():
    assert cursor.bounded_limit(None) == 50
    for bad in (0, 101):
        with pytest.raises(ValueError):
            cursor.bounded_limit(bad)


def test_fnv():
    assert exprs.fnv1a(b"") == "cbf29ce484222325" and exprs.fnv1a(b"a") == "af63dc4c8601ec8c"


def test_truncate_bytes(spark):
    texts = ["", "abc", "aé", "éé", "日本語", "a日本", "𝄞𝄞", "ab𝄞"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(0, 9):
        got = [r[0] for r in df.select(exprs.truncate_bytes(F.col("t"), most)).collect()]
        assert got == [t.encode()[:most].decode(errors="ignore") for t in texts]


def test_backoff_matches_integers(spark):
    import hashlib

    cases = [(i, m, j, n) for i in (1, 40, 10**12) for m in (60, 300, exprs.MOST_DELAY) for j in (0, 20, 100) for n in (1, 2, 7, 70) if i <= m]
    rows = [(f'{{"backoff":{{"Exponential":{{"initial_secs":{i},"max_secs":{m},"jitter_percent":{j}}}}}}}', n) for i, m, j, n in cases]
    delay = exprs.backoff(F.col("p"), F.col("n"), F.concat(F.lit("s"), F.col("n").cast("string")))
    got = [r[0] for r in spark.createDataFrame(rows, "p string, n int").select(delay).collect()]
    for (i, m, j, n), g in zip(cases, got, strict=True):
        base = min(i * 2 ** (n - 1), m)
        h = hashlib.sha256(f"s{n}".encode()).digest()
        x = base * j // 100 * (2 * ((h[0] + 256 * h[1]) % 101) - 100)
        assert g == 1000 * max(0, base + (x // 100 if x >= 0 else -(-x // 100))), (i, m, j, n)


def test_backoff_by_hand_and_out_of_bounds(spark):
    plain = '{"backoff":{"Exponential":{"initial_secs":%d,"max_secs":%d,"jitter_percent":%d}}}'
    rows = [('{"backoff":{"Fixed":{"delay_secs":12}}}', 3), (plain % (5, 60, 0), 1), (plain % (5, 60, 0), 9)]
    rows += [(x, 1) for x in ('{"backoff":{"Fixed":{"delay_secs":0}}}', '{"backoff":{"Fixed":{"delay_secs":18446744073709551615}}}', plain % (0, 1, 0), plain % (5, 1, 0), plain % (1, 2, 101), "{}", "no", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, n int").select(exprs.backoff(F.col("p"), F.col("n"), F.lit("x"))).collect()]
    assert got == [12_000, 5_000, 60_000] + [None] * 8


def test_keys(spark):
    keys = ["a", "a.", "a-b", "a_b", "_a", "a_", "a__b", "A", "", "1.2", "é"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = df.select(exprs.valid_topic_key(F.col("k")), exprs.valid_schedule_key(F.col("k"))).collect()
    assert [k for k, r in zip(keys, got, strict=True) if r[0]] == ["a", "a.", "a-b", "a_b", "a_", "a__b", "1.2"]
    assert [k for k, r in zip(keys, got, strict=True) if r[1]] == ["a", "a_b"]



def test_hours_round_down(spark):
    got = spark.sql("SELECT explode(array(3599999L, 100000000L, -1L)) AS t").select(exprs.hour_start(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 97_200_000, -3_600_000]


def test_daylight_saving():
    ms = lambda *a: int(datetime(*a, tzinfo=calendar.UTC).timestamp() * 1000)
    gap = calendar.resolve(datetime(2026, 3, 8, 2, 30), "America/Denver")
    assert (gap.local, gap.disposition, gap.due_at) == ("2026-03-08T02:30:00", "gap", ms(2026, 3, 8, 9))
    cron = calendar.Cron("0 30 1 * * *")
    first = calendar.next_after(cron, "America/Denver", ms(2026, 11, 1, 7))
    assert (first.local, first.disposition) == ("2026-11-01T01:30:00", "ambiguous_earlier")
    assert calendar.next_after(cron, "America/Denver", first.due_at).local == "2026-11-02T01:30:00"


def test_gap_end_column(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-03-08 02:30:00' AS a").select(F.col("a").cast("timestamp").alias("a"))
    assert df.select(schedules.gap_end_utc(F.col("a"), "America/Denver")).first()[0] == int(datetime(2026, 3, 8, 9, tzinfo=calendar.UTC).timestamp() * 1000)


@settings(max_examples=25, deadline=None)
@given(st.datetimes(datetime(2024, 1, 1), datetime(2027, 1, 1)))
def test_cron_moves_forward(t):
    nxt = calendar.Cron("0 0 */6 * * MON-FRI").after(t)
    assert nxt > t.replace(microsecond=0) and nxt.hour % 6 == 0 and nxt.weekday() < 5


def test_occurrences_and_misfires(spark):
    now = int(datetime(2026, 3, 10, 12, tzinfo=calendar.UTC).timestamp() * 1000)
    rows = spark.createDataFrame([(k, "0 0 0 * * *", "UTC", "2026-03-07T12:00:00") for k in ("a", "b", "c")], "schedule_key string, cron string, zone string, after_local string")
    due = schedules.due_occurrences(rows, now)
    pol = spark.createDataFrame([("a", "run_latest", 0, 0, 0, "allow"), ("b", "skip", 43_200_000, 0, 0, "skip_if_active"), ("c", "catch_up", 0, 2, 0, "queue_one")], "schedule_key string, misfire string, grace long, catch_up int, following int, overlap string")
    got = schedules.classify_misfires(due, pol, now)
    by = {k: [r.outcome for r in got.where(F.col("schedule_key") == k).orderBy("local_occurrence").collect()] for k in "abc"}
    assert by == {"a": ["coalesce", "coalesce", "start"], "b": ["skip", "skip", "start"], "c": ["skip", "start", "start"]}


@pytest.mark.parametrize(("policy", "want"), [("allow", (3, 0, 0)), ("skip_if_active", (1, 0, 2)), ("queue_one", (1, 1, 1))])
def test_overlap(spark, policy, want):
    due = spark.createDataFrame([("k", f"2026-01-0{i}T00:00:00", i, "start", None) for i in (1, 2, 3)], "schedule_key string, local_occurrence string, due_at long, outcome string, reason string")
    pol = spark.createDataFrame([("k", policy)], "schedule_key string, overlap string")
    none = spark.createDataFrame([], "schedule_key string, active boolean, queued boolean")
    r = schedules.materialization_report(schedules.apply_overlap(due, pol, none)).first()
    assert (r.started, r.queued, r.skipped) == want


def test_finish_plan(spark):
    act = spark.createDataFrame([(1, "running", 1, 3), (2, "running", 3, 3), (3, "cancelling", 1, 3), (4, "running", 1, 3)], "id long, status string, attempt_count int, max_attempts int").withColumn("retry_policy_json", F.lit('{"backoff":{"Fixed":{"delay_secs":5}}}'))
    out = spark.createDataFrame([(1, "retryable"), (2, "retryable"), (3, "succeeded"), (4, "succeeded")], "activity_id long, outcome string")
    got = {r.activity_id: (r.to_status, r.available_at) for r in work.finish_plan(out, act, 100).collect()}
    assert got == {1: ("pending", 5100), 2: ("dead_lettered", None), 3: ("cancelled", None), 4: ("succeeded", None)}


def test_replay_fails_closed(spark):
    ev = spark.createDataFrame([(1, 1, "{}", "started"), (1, 2, '{"data":{"command_sequence":9}}', "x"), (1, 3, "{}", "y"), (2, 1, "{}", "started"), (2, 3, "{}", "z")], "workflow_id long, delivery_sequence int, metadata_json string, event_type string")
    got = {r.workflow_id: (r.applied, r.failure) for r in log.replay(ev, spark.createDataFrame([(1, 1)], "workflow_id long, command_sequence int")).collect()}
    assert got == {1: (1, "unknown_command"), 2: (1, "delivery_order")}


def test_windowed_errors(spark):
    from flowlens.operators.health import windowed_errors

    rows = spark.createDataFrame([("p", t) for t in (0, 50, 100, 101, 150, 400)] + [("q", 7)], "process string, at long")
    got = sorted(tuple(r) for r in windowed_errors(rows, 100, 2).collect())
    assert got == [("p", 0, 3, True), ("p", 101, 2, False), ("p", 400, 1, False), ("q", 7, 1, False)]


def test_streaming_throughput_equals_batch(spark, sf, tmp_path):
    from flowlens.operators.metrics import hourly_throughput
    from flowlens.registry import topics
    from flowlens.sources.derived import Snapshot
    from flowlens.sources.schemas import schema

    s = Snapshot(spark, sf)
    s("activity").write.parquet(f"{tmp_path}/in")
    stream = log.streaming_throughput(spark.readStream.schema(schema("activity")).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("throughput").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    got = {(r.topic, r.bucket_start): r.completed for r in spark.table("throughput").collect()}
    want = {(r.topic, r.bucket_start): r.completed for r in hourly_throughput(topics(s), s("activity"), s.now).collect() if r.completed}
    assert all(got.get(k) == v for k, v in want.items()) and want


def test_streaming_dedup(spark, tmp_path):
    rows = [(1, 1, 1000), (1, 1, 1000), (1, 2, 2000)]
    spark.createDataFrame(rows, "workflow_id long, sequence int, created_at long").write.parquet(f"{tmp_path}/in")
    stream = log.deduplicated_events(spark.readStream.schema("workflow_id long, sequence int, created_at long").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 2


def test_closures_end_at_cycles(spark):
    from flowlens.operators.lineage import _closure

    step = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "id long, next long")
    start = spark.createDataFrame([(1, 1, 0), (7, 7, 0)], "origin long, id long, depth int")
    got = sorted((r.origin, r.id) for r in _closure(start, step, "all").collect())
    assert got == [(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)]


def test_operators_plans(spark):
    wf = spark.createDataFrame([(1, "flow", 1, "paused", "approval", 5), (2, "flow", 1, "paused", "child", 3), (3, "flow", 1, "failed", None, None), (4, "flow", 1, "paused", "activity", 9), (5, "flow", 1, "paused", None, None), (6, "flow", 2, "waiting_approval", "approval", 6), (7, "flow", 1, "paused", "activity", 99)], "id long, kind string, version int, status string, wait_kind string, wait_reference_id long")
    act = spark.createDataFrame([(9, "cancelled")], "id long, status string")
    appr = spark.createDataFrame([(5, 1, "resolved", None, "flow", 1), (6, 6, "pending", None, "flow", 1), (7, 6, "pending", 50, "flow", 2)], "id long, workflow_id long, status string, expires_at long, kind string, version int")
    got = {r.workflow_id: r.to_status or r.refusal for r in work.resume_plan(wf, act, appr).collect()}
    assert got == {1: "ready", 2: "failed_child", 4: "cancelled_activity", 5: "ready", 7: "missing_activity"}
    assert {r.approval_id: r.decision for r in work.approval_plan(appr, wf, 100).collect()} == {5: "already_resolved", 6: "no_longer_matches", 7: "expired"}


def test_in_flight_counts_unsettled_leases(spark):
    act = spark.createDataFrame([(1, "t", "running", 200), (2, "t", "running", 50), (3, "t", "running", 50), (4, "t", "pending", None)], "id long, topic string, status string, lease_expires_at long")
    assert [r.in_flight for r in work.in_flight(act, 100).collect()] == [1]
    assert [r.in_flight for r in work.in_flight(act, 100, act.where("id = 2").select("id")).collect()] == [2]
