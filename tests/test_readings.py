from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspan.operators import readings as R

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "id long, session_id string, recorded_at timestamp, modem_reported_at timestamp, rsrp double, rsrq double, sinr double, network_type string, cell_id string, lon double, lat double"


def frame(spark, rows):
    """(session, seconds, modem seconds or None, rsrp or None)"""
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    return spark.createDataFrame([(i, s, at(t), at(m), v, None, None, "none" if v is None else "LTE", "c1", -81.7 + i * 1e-4, 32.4) for i, (s, t, m, v) in enumerate(rows)], SCHEMA)


def test_unchanged_values(spark):
    r = R.rereads(frame(spark, [("a", 0, None, -95.0), ("a", 3, None, -95.0), ("a", 6, None, -99.0), ("a", 9, None, -99.0)])).first()
    assert (r.rereads, r.independent, r.reread_share) == (2, 2, 0.5)


def test_shared_modem_stamp_and_sessions(spark):
    df = frame(spark, [("a", 0, 0, -90.0), ("a", 3, 0, -91.0), ("a", 6, 5, -92.0), ("b", 0, None, -92.0)])
    rows = {x.session_id: x for x in R.per_session(df).collect()}
    assert (rows["a"].rereads, rows["a"].modem_rows, rows["a"].modem_distinct) == (1, 3, 2)
    assert rows["b"].rereads == 0


def test_dead_zone_run_collapses_and_order_is_by_time(spark):
    df = frame(spark, [("a", 9, None, None), ("a", 0, None, None), ("a", 3, None, None), ("a", 6, None, -100.0)])
    assert sorted(x.id for x in R.run_starts(df).collect()) == [0, 1, 3]


def test_empty(spark):
    empty = frame(spark, [("a", 0, None, -1.0)]).where("id < 0")
    t, r, f = R.totals(empty).first(), R.rereads(empty).first(), R.fingerprint(empty).first()
    assert t.total == 0 and t.rsrp_avg is None and r.reread_share is None and (f.row_count, f.max_id) == (0, 0)
    assert R.run_starts(empty).count() == 0 and R.per_session(empty).count() == 0


def test_metric_rules(spark):
    df = frame(spark, [("a", 0, None, -95.0), ("a", 3, None, None)])
    assert [x.value for x in R.metric_rows(df, "rsrp", -125.0).orderBy("id").collect()] == [-95.0, -125.0]
    assert R.metric_rows(df, "sinr", -125.0).count() == 0
    with pytest.raises(ValueError):
        R.check_metric("rsrp; drop table")


def test_session_floor_counts_raw_rows(spark):
    df = frame(spark, [("a", 0, None, -95.0), ("a", 3, None, -95.0), ("a", 6, None, -95.0), ("b", 0, None, -90.0)])
    assert [x.id for x in R.modelling_rows(df, min_session_rows=3).collect()] == [0]
    assert [tuple(x) for x in R.excluded_sessions(df, 3).collect()] == [("b", 1)]


@pytest.mark.parametrize(("tolerance", "want"), [(1.0, [(0, 100.0, 5.0, "s2"), (1, 0.0, 15.0, "s0")])])
def test_collapse(spark, tolerance, want):
    p = spark.createDataFrame([(0, 0.0, 0.0, 10.0, "s0", "c"), (1, 0.3, 0.2, 20.0, "s1", "c"), (2, -100.0, 100.0, 5.0, "s2", "c")], "id long, x double, y double, value double, session string, cell string")
    rows = R.collapse_coincident(p, tolerance).orderBy("pt_idx").collect()
    assert [(r.pt_idx, r.value, r.session) for r in rows] == [(w[0], w[2], w[3]) for w in want]
    apart = R.collapse_coincident(p.where("id <> 1")).orderBy("pt_idx").collect()
    assert [r.id for r in apart] == [0, 2]


def test_migrations(spark):
    from larkspan import schemas

    v1 = spark.createDataFrame([], schemas.measurements(1))
    assert schemas.migrate(v1).columns == schemas.measurements().names
    assert schemas.migrate(schemas.migrate(v1), 1).columns == v1.columns
    with pytest.raises(ValueError):
        schemas.migrate(v1.drop("lon"))


def test_ingest_keeps_first_and_skips_stored(spark):
    batch = spark.createDataFrame([("k1", 0), ("k1", 1), ("k2", 2), ("k3", 3)], "sample_id string, pos int")
    stored = spark.createDataFrame([("k2",)], "sample_id string")
    assert tuple(R.ingest_counts(batch, stored).first()) == (4, 2, 2)
    assert R.first_per_key(batch).agg(F.sum("pos")).first()[0] == 5
