from __future__ import annotations

import pytest

from larkspan.functions.geo import with_bounds
from larkspan.operators import claims as C
from larkspan.plans import runs
from larkspan.sources import gpkg


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


HEXES = [(-80, 1, "hexA", box(-81.75, 32.40, -81.74, 32.41)), (-100, 1, "hexB", box(-81.74, 32.40, -81.73, 32.41)), (-60, 0, "hexA0", box(-81.75, 32.40, -81.74, 32.41)), (-50, 1, "hexFar", box(-80.0, 33.0, -79.99, 33.01))]


@pytest.fixture(params=[True, False])
def filing(request, spark, tmp_path):
    path = str(tmp_path / "filing.gpkg")
    gpkg.write(path, [*HEXES, (-70, 1, "empty", [])], envelope=request.param)
    gpkg.register(spark)
    return spark.read.format("gpkg").option("path", path)


def points(spark):
    return spark.createDataFrame([(10, -81.745, 32.405, -95.0), (11, -81.744, 32.406, -70.0), (12, -81.735, 32.405, -123.0), (13, -81.60, 32.405, -110.0)], "id long, lon double, lat double, rsrp double")


def test_source(filing, spark):
    assert {r.h3_res9_id for r in filing.load().collect()} == {"hexA", "hexB", "hexA0", "hexFar"}
    assert {r.h3_res9_id for r in filing.option("bbox", "-81.8,32.3,-81.7,32.5").option("partitions", 3).load().where("environmnt = 1").collect()} == {"hexA", "hexB"}


def test_blobs():
    with pytest.raises(ValueError):
        gpkg.parse_blob(b"XX" + bytes(10))
    with pytest.raises(ValueError):
        gpkg.parse_blob(b"GP\0" + bytes([5 << 1]) + bytes(10))


def test_missing_columns(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.gpkg")
    gpkg.write(path, [])
    with sqlite3.connect(path) as c:
        c.execute("ALTER TABLE coverage RENAME COLUMN minsignal TO other")
    gpkg.register(spark)
    with pytest.raises(Exception, match="lacks minsignal"):
        spark.read.format("gpkg").option("path", path).load().collect()


def test_audit(filing, spark):
    audited = runs.audit(points(spark), filing.load())
    s = C.summary(audited).first()
    assert (s.total, s.n_inside, s.violations, s.worst_gap, s.worst_id) == (4, 3, 2, -23.0, 12)
    assert [tuple(r)[:3] for r in C.by_tier(audited).collect()] == [(-100.0, 1, 1), (-80.0, 2, 1)]
    assert [r.id for r in C.violations(audited).collect()] == [12, 10]


def test_shared_edge(spark):
    claims = with_bounds(spark.createDataFrame([(i, h[2], float(h[0]), h[1], h[3]) for i, h in enumerate(HEXES)], "hex_ord long, h3_res9_id string, minsignal double, environmnt int, ring array<struct<x: double, y: double>>")).where("environmnt = 1")
    edge = spark.createDataFrame([(1, -81.74, 32.405, -120.0)], "id long, lon double, lat double, rsrp double")
    a = C.evaluate(edge, claims).collect()
    assert len(a) == 1 and a[0].inside and a[0].h3 == "hexA"
    assert C.strict_matches(edge, claims).count() == 0 and C.boundary_only(edge, claims).count() == 1
    assert C.check_summary(edge, claims).first().boundary_only_points == 1


def test_no_claims(spark):
    none = spark.createDataFrame([], gpkg.SCHEMA)
    s = C.summary(runs.audit(points(spark), none)).first()
    assert (s.total, s.n_inside, s.share_of_inside, s.worst_gap) == (4, 0, None, None)
    assert "none" in runs.audit_text(s.asDict())


def test_publish(filing, spark, tmp_path):
    import json

    claims = filing.load().where("environmnt = 1")
    audited = runs.audit(points(spark), claims)
    report = runs.write_audit(audited, str(tmp_path))
    assert report["summary"]["violations"] == 2
    out = runs.publish(points(spark), claims, audited, str(tmp_path / "hexes.geojson"), least=2)
    doc = json.loads((tmp_path / "hexes.geojson").read_text())
    assert out.count() == 1 and len(doc["features"]) == 1 and doc["audited"]["violations"] == 2
    with pytest.raises(ValueError):
        runs.publish(points(spark), claims, audited.where("id <> 12"), str(tmp_path / "x.geojson"))
