from __future__ import annotations

import __spark_entry__ as entry


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(s) > 40
    assert entry.entry(spark).columns == ["claimed", "points", "violations", "avg_measured"]


def test_native_plans(spark):
    """The flagship stays in the JVM, joins by lattice cell and reads only what it needs."""
    plan = entry.queries()["audit_by_tier"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
    assert "props" not in plan
