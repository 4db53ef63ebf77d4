from __future__ import annotations

import gzip
import json

import pytest

from larkspan import cli, fixtures, serving
from larkspan.plans import runs
from larkspan.sources import config, roads


def test_commands(spark, tmp_path, capsys):
    m, c = str(tmp_path / "m"), str(tmp_path / "c")
    fixtures.measurements(spark, "/root/testdata/sf0.001").write.parquet(m)
    fixtures.claims(spark).write.parquet(c)
    assert cli.main(["audit", m, c, "--out-dir", str(tmp_path)]) == 0 and "measurements" in capsys.readouterr().out
    assert json.loads((tmp_path / "claims_report.json").read_text())["summary"]["total"] > 0
    assert cli.main(["verify", m, c]) == 0 and json.loads(capsys.readouterr().out)["summary"]["n_inside"] > 0
    assert cli.main(["publish", m, c, "--out", str(tmp_path / "h.geojson")]) == 0
    capsys.readouterr()
    assert cli.main(["stats", m]) == 0 and json.loads(capsys.readouterr().out)["totals"]["total"] == 1000
    assert cli.main(["interpolate", m, "--metric", "height"]) == 1 and capsys.readouterr().err.startswith("error:")


def test_serving(tmp_path):
    p = tmp_path / "s.geojson"
    assert serving.respond(str(p))[0] == 404
    p.write_bytes(b'{"a":  1}')
    status, head, body = serving.respond(str(p))
    assert (status, body) == (200, b'{"a":  1}')
    assert serving.respond(str(p), if_none_match=head["ETag"])[0] == 304 and serving.respond(str(p), if_modified_since=head["Last-Modified"])[0] == 304
    assert serving.respond(str(p), if_none_match='"x"', if_modified_since=head["Last-Modified"])[0] == 200
    p.write_bytes(b"{")
    assert serving.respond(str(p))[0] == 500


def test_uploads_and_statistics(spark, tmp_path):
    table, uuid = str(tmp_path / "t"), "00000000-0000-4000-8000-{:012x}".format
    sample = {"sample_id": uuid(1), "recorded_at": "2024-01-01T00:00:00Z", "lat": 32.4, "lon": -81.7, "network_type": "LTE", "rsrp": -90.0}
    body = json.dumps({"session_id": uuid(9), "carrier": "c", "samples": [sample, sample | {"sample_id": uuid(2)}]}).encode()
    ask = lambda method, path, body=b"", **head: serving.answer(method, path, head, body, "", spark, table)
    status, _, out = ask("POST", "/v1/measurements", body)
    assert (status, json.loads(out)) == (200, {"received": 2, "inserted": 2, "skipped": 0})
    status, _, out = serving.answer("POST", "/v1/measurements", {"Content-Encoding": "gzip"}, gzip.compress(body), "", spark, table)
    assert (status, json.loads(out)) == (200, {"received": 2, "inserted": 0, "skipped": 2})
    assert json.loads(ask("GET", "/v1/stats")[2])["totals"]["total"] == 2
    status, _, out = ask("POST", "/v1/measurements", body.replace(b"32.4", b"132.4", 1))
    assert status == 400 and json.loads(out) == {"error": "validation_error", "detail": [{"sample": 0, "fields": ["lat"]}]}
    assert ask("POST", "/v1/measurements", b"{")[0] == 400 and ask("GET", "/healthz")[0] == 200 and ask("GET", "/x")[0] == 404


def test_overpass_ways():
    asked = []
    found = {"elements": [{"type": "way", "tags": {"name": "A"}, "geometry": [{"lon": 1.0, "lat": 2.0}, {"lon": 1.5, "lat": 2.0}]}, {"type": "way", "geometry": [{"lon": 1.0, "lat": 2.0}]}]}
    fetch = roads.overpass("drive", ask=lambda q: asked.append(q) or json.dumps(found).encode())
    assert fetch((1.0, 2.0, 3.0, 4.0)) == [([(1.0, 2.0), (1.5, 2.0)], "A")] and "(2.0,1.0,4.0,3.0)" in asked[0]
    with pytest.raises(roads.NoRoads):
        roads.overpass("all", ask=lambda q: b"{}")((0, 0, 1, 1))
    with pytest.raises(ValueError):
        roads.overpass("boat")


def test_refresh_makes_suggestions(spark, tmp_path):
    rows = fixtures.measurements(spark, "/root/testdata/sf0.001")
    rows = rows.where("id % 8 = 0")  # a dense system of some hundred points
    settings = config.Config.from_env(output_dir=str(tmp_path), cell_m=1000.0, folds=3, none_floor=None)
    fetch = lambda box: [([(box[0], (box[1] + box[3]) / 2), (box[2], (box[1] + box[3]) / 2)], "Road")]
    done = runs.refresh_all(rows, settings, "rsrp", str(tmp_path / "cache"), fetch)
    assert done["suggestions"] > 0 and (tmp_path / "rsrp_suggestions.geojson").exists()
    assert runs.refresh_all(rows, settings, "rsrp", str(tmp_path / "cache"), fetch) is None
    again = runs.suggest_recomputed(rows, settings, str(tmp_path / "cache"), str(tmp_path / "again"), "rsrp", fetch=fetch)
    assert len(again["suggestions"]) == done["suggestions"]
