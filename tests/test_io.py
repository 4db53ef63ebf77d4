from __future__ import annotations

import gzip
import json
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from larkspan.operators import readings, spatial
from larkspan.plans import runs
from larkspan.sinks import documents
from larkspan.sources import batches, geotiff, roads
from larkspan.sources.config import Config
from larkspan.streaming import ingest

U = "00000000-0000-4000-8000-{:012d}".format


def sample(n, **more):
    return {"sample_id": U(n), "recorded_at": "2024-01-01T12:00:00Z", "lat": 32.4, "lon": -81.7, "network_type": "LTE", "rsrp": -90.5} | more


def batch(samples, **more):
    return {"session_id": U(900), "carrier": "c", "samples": samples} | more


def body(doc):
    return doc if isinstance(doc, str) else json.dumps(doc)


CASES = [
    (batch([sample(1)]), []),
    (batch([sample(1, network_type="none", rsrp=None)]), []),
    (batch([sample(1, network_type="3G")]), ["network_type"]),
    (batch([sample(1, lat=91)]), ["lat"]),
    (batch([]), ["samples"]),
    (batch([sample(1)], carrier=""), ["carrier"]),
    (batch([sample(1, modem_reportd_at="2024-01-01T12:00:00Z")]), ["extra_key"]),
    (batch([sample(1, modem_reported_at="soon")]), ["modem_reported_at"]),
    (batch([sample(1, rsrp="loud")]), ["rsrp"]),
    (batch([sample(1, heading_deg=360)]), ["heading_deg"]),
    (batch([sample(1)], extra=1), ["extra_key"]),
    ("{oops", ["invalid_json"]),
    (batch([sample(i) for i in range(4)]), ["batch_too_large"]),
]


def test_validation(spark):
    df = spark.createDataFrame([(f"{i:02d}", body(d)) for i, (d, _) in enumerate(CASES)], "batch string, body string")
    got = {r.batch: r.errors for r in batches.verdicts(batches.parsed(df, max_batch=3)).collect()}
    assert [got[f"{i:02d}"] for i in range(len(CASES))] == [e for _, e in CASES]


def test_stream_is_idempotent(spark, tmp_path):
    land, table = tmp_path / "land", str(tmp_path / "table")
    land.mkdir()
    counts = []

    def run():
        q = ingest.start(spark, str(land), table, str(tmp_path / "cp"), rejects=str(tmp_path / "rejects"), on_counts=counts.append)
        q.awaitTermination(120)

    (land / "a.json").write_text(body(batch([sample(0), sample(1), sample(2), sample(1)])))
    run()
    with gzip.open(land / "b.json.gz", "wt") as f:
        f.write(body(batch([sample(i, carrier="") for i in (1, 2, 3, 4)], carrier="d")))
    (land / "c.json").write_text(body(batch([sample(9, lat=99)])))
    run()
    rows = spark.read.parquet(table)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4, 5] and rows.select("sample_id").distinct().count() == 5
    assert rows.where("carrier = 'd'").count() == 2
    assert [(c["received"], c["inserted"], c["skipped"]) for c in counts] == [(4, 3, 1), (4, 2, 2)]
    assert spark.read.json(str(tmp_path / "rejects")).count() == 1


def test_change_gate(spark, tmp_path):
    src = tmp_path / "src"
    rows = [("a", 1, 0, -90.0), ("a", 2, 3, -90.0), ("a", 3, 6, -91.0), ("b", 4, 0, -90.0), ("a", 5, 9, -91.0)]
    df = spark.createDataFrame([(s, i, v) for s, i, _, v in rows], "session_id string, id long, rsrp double").selectExpr("session_id", "id", "timestamp_seconds(1700000000 + id * 3) AS recorded_at", "rsrp", "CAST(NULL AS double) AS rsrq", "CAST(NULL AS double) AS sinr", "CAST(NULL AS timestamp) AS modem_reported_at")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = ingest.changed_readings(stream).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = sorted(r.id for r in spark.table("gate").collect())
    assert kept == [1, 3, 4] == sorted(r.id for r in readings.run_starts(df).collect())


def test_geotiff(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    a[1, 2] = np.nan
    d = geotiff.decode(geotiff.encode(a, 430_000.0, 3_580_000.0, 150.0, 32617, "x"))
    assert np.array_equal(d["band"], a, equal_nan=True) and (d["x0"], d["y0"], d["cell"], d["epsg"], d["description"]) == (430_000.0, 3_580_000.0, 150.0, 32617, "x")
    p = tmp_path / "s.tif"
    p.write_bytes(geotiff.encode(a, 0.0, 0.0, 10.0, 32617))
    s, _ = geotiff.read_surface(spark, str(p))
    assert s.where("stddev is null").count() == 1 and s.where("row = 2 and col = 3").first().y == 20.0


def test_reports(tmp_path):
    documents.write_report(str(tmp_path / "r.json"), {"a": float("nan"), "b": [np.float64(1.5), float("inf")]})
    assert documents.read_report(str(tmp_path / "r.json")) == {"a": None, "b": [1.5, None]}
    (tmp_path / "bad.json").write_text("{")
    assert documents.read_report(str(tmp_path / "bad.json")) is None and documents.range_of_report(str(tmp_path / "none.json")) is None


def test_gpx(tmp_path):
    s = [{"rank": 1, "visit_order": 2, "lat": 32.4, "lon": -81.7, "road_name": "A & B"}, {"rank": 2, "visit_order": 1, "lat": 32.5, "lon": -81.8, "road_name": None}]
    root = ET.fromstring(documents.gpx(s).split("\n", 1)[1])
    names = [e.text for e in root.iter() if e.tag.endswith("name")]
    assert names[0] == "T1" and "T2 A & B" in names
    assert not documents.write_gpx(str(tmp_path / "x.gpx"), []) and not (tmp_path / "x.gpx").exists()


def test_roads(spark, tmp_path):
    cache = str(tmp_path)
    calls = []

    def fetch(box):
        calls.append(box)
        if box[0] == 2:
            raise roads.NoRoads("none")
        if box[0] == 3:
            raise ValueError("Graph contains no edges, probably")
        return [([(0.0, 0.0), (1.0, 1.0)], " Main "), ([(0.0, 0.0), (1.0, 0.0)], "nan")]

    boxes = [(0, 0, 1, 1), (1, 0, 2, 1), (2, 0, 3, 1)]
    got = spatial.union_tiles(roads.roads_of_tiles(spark, boxes, cache, fetch)).orderBy("road_idx").collect()
    assert [r.name for r in got] == ["Main", None]
    roads.roads_of_tiles(spark, boxes, cache, fetch).count()
    assert len(calls) == 3
    with pytest.raises(ValueError):
        roads.roads_of_tiles(spark, [(3, 0, 4, 1)], cache, fetch)
    assert not roads.cache_file(cache, (3, 0, 4, 1)).exists()
    assert roads.covering_cache(cache, (0.2, 0.2, 0.8, 0.8)) == roads.cache_file(cache, boxes[0]) and roads.covering_cache(cache, (0.2, 0.2, 5, 5)) is None
    assert roads.is_empty_tile(ValueError("Graph contains no edges.")) and not roads.is_empty_tile(ValueError("timeout"))


def test_config():
    assert Config.from_env({}) == Config()
    c = Config.from_env({"LARKSPAN_KRIGING": "pathloss", "LARKSPAN_ANISOTROPY": "2:45", "LARKSPAN_DEDUPE_RUNS": "no", "LARKSPAN_NONE_FLOOR": "-125"}, cell_m=50.0)
    assert (c.kriging, c.anisotropy, c.dedupe_runs, c.none_floor, c.cell_m) == ("pathloss", (2.0, 45.0), False, -125.0, 50.0)
    for bad in ({"LARKSPAN_KRIGING": "x"}, {"LARKSPAN_ANISOTROPY": "2"}, {"LARKSPAN_DEDUPE_RUNS": "maybe"}, {"LARKSPAN_SUPPORT_RANGE_MULTIPLE": "-1"}):
        with pytest.raises(ValueError):
            Config.from_env(bad)


def test_refresh(spark, tmp_path):
    df = spark.createDataFrame([(1,), (5,)], "id long")
    state, done = str(tmp_path / "s.json"), []

    def fail():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        runs.refresh(df, state, fail)
    assert runs.refresh(df, state, lambda: done.append(1)) and not runs.refresh(df, state, lambda: done.append(2))
    assert runs.refresh(df, state, lambda: done.append(3), force=True) and done == [1, 3]
    assert not runs.should_refresh(None, {"row_count": 0, "max_id": 0}) and runs.should_refresh({"row_count": 2, "max_id": 5}, {"row_count": 3, "max_id": 6})


def test_whole_run(spark, tmp_path):
    from larkspan import fixtures

    m = fixtures.measurements(spark, "/root/testdata/sf0.001").where("id < 400")
    seen = []
    run = runs.interpolate(m, Config(cell_m=2000.0, folds=3, min_session_rows=1, support_range_multiple=0.5), folder=str(tmp_path), on_cv=seen.append)
    assert (tmp_path / "rsrp_stddev.tif").exists() and (tmp_path / "rsrp_report.json").exists() and seen and run.headline["scheme"] == "session"
    cache = tmp_path / "cache"
    out = runs.suggest_from_file(spark, str(tmp_path / "rsrp_stddev.tif"), str(cache), str(tmp_path), fetch=lambda b: [([(b[0], (b[1] + b[3]) / 2), (b[2], (b[1] + b[3]) / 2)], "R")], top_n=3, most_road_m=3000.0)
    assert (tmp_path / "rsrp_suggestions.geojson").exists() and len(out["suggestions"]) <= 3
