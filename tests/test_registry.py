from __future__ import annotations

import pytest

from larkspan import fixtures
from larkspan.functions import registry
from larkspan.sources import extent, gpkg


def test_sql_functions(spark, tmp_path):
    registry.register(spark)
    row = spark.sql("SELECT utm_epsg(-81.7D, 32.4D), utm_epsg(180D, -1D), weakness_weight(-107.5D, 0.5D), road_name(' nan '), road_name(' A '), point_in_ring(0.5D, 0.5D, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D)))").first()
    assert list(row)[:2] == [32617, 32760] and row[2] == pytest.approx(1.25) and list(row)[3:5] == [None, "A"]
    tiles = spark.sql("SELECT kx, ky FROM road_tiles(-81.7501D, 32.4D, 250D)").collect()
    assert len(tiles) == 4
    path = str(tmp_path / "g.gpkg")
    gpkg.write(path, [(-80, 1, "a", [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)])])
    import sqlite3

    blob = sqlite3.connect(path).execute("SELECT geom FROM coverage").fetchone()[0]
    got = spark.createDataFrame([(bytearray(blob),), (None,)], "b binary").selectExpr("gpkg_parse(b) AS g").selectExpr("g.x1", "g.y1", "length(g.wkb) AS n").collect()
    assert tuple(got[0])[:2] == (1.0, 2.0) and got[1].n is None


def test_extent(spark, tmp_path):
    path = str(tmp_path / "claims")
    extent.load(fixtures.claims(spark), path, (-82, 32, -81, 33))
    assert extent.reuse(spark, path, (-81.9, 32.1, -81.5, 32.5)).count() > 0
    with pytest.raises(ValueError):
        extent.reuse(spark, path, (-83, 32.1, -81.5, 32.5))
