import pytest
from oracle import both

from flowlens import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    got, want = both(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert got == want


def test_all_queries_have_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys()


def test_plans_have_no_nested_loops(spark, sf):
    for name in ("topic_metrics", "health_dead_letters", "claim_plan"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_topic_metrics_at_sf001(spark):
    got = {r.topic: r for r in registry.QUERIES["topic_metrics"](spark, "/root/testdata/sf0.01").collect()}
    want = {"click": (64, 41, 28, 69), "error": (56, 48, 23, 78), "purchase": (67, 42, 23, 78), "signup": (62, 38, 34, 72), "view": (64, 53, 17, 78)}
    assert {t: (r.active, r.ready, r.retry_scheduled, r.dead_letters) for t, r in got.items()} == want
    assert [t for t, r in got.items() if r.configuration_mismatch] == ["view"]


def test_no_query_compares_nothing_with_nothing():
    """At the size at which results are compared, each SQL gives rows."""
    from oracle import connect

    con = connect("/root/testdata/sf0.01")
    empty = [name for name, sql in sorted(registry.ORACLE_SQL.items()) if not con.execute(f"SELECT count(*) FROM ({sql}) q").fetchone()[0]]
    assert not empty
