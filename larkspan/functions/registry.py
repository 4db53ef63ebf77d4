"""Functions for SQL text: ``register(spark)`` makes them known to a session.

``utm_epsg(lon, lat)``, ``weakness_weight(level, bias)``, ``road_name(text)``, ``point_in_ring(x, y, ring)`` are SQL
functions that the optimiser inlines; ``gpkg_parse(blob)`` is an Arrow function; ``road_tiles(lon, lat, buffer_m)`` is a table
function with a row ``kx, ky`` for each tile.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from larkspan.operators.spatial import METRES_PER_DEGREE
from larkspan.sources.gpkg import parse_blob

_SQL = {
    "utm_epsg(lon DOUBLE, lat DOUBLE) RETURNS INT": "CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(least(60, greatest(1, floor((lon + 180) / 6) + 1)) AS INT)",
    "weakness_weight(level DOUBLE, bias DOUBLE) RETURNS DOUBLE": "1 + bias * least(1.0D, greatest(0.0D, (-95.0D - level) / 25.0D))",
    "road_name(raw STRING) RETURNS STRING": "CASE WHEN trim(raw) <> '' AND lower(trim(raw)) <> 'nan' THEN trim(raw) END",
    "point_in_ring(px DOUBLE, py DOUBLE, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) RETURNS BOOLEAN": """size(filter(transform(ring, (p, i) -> struct(p AS a, get(ring, (i + 1) % size(ring)) AS b)),
      e -> (e.a.y > py) <> (e.b.y > py) AND px < (e.b.x - e.a.x) * (py - e.a.y) / (e.b.y - e.a.y) + e.a.x)) % 2 = 1""",
}


_BLOB = T.StructType([T.StructField("wkb", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1"))])


@F.pandas_udf(_BLOB)
def gpkg_parse(blobs: pd.Series) -> pd.DataFrame:
    rows = []
    for b in blobs:
        wkb, box = (None, None) if b is None else parse_blob(bytes(b))
        rows.append((wkb, *(box or (None,) * 4)))
    return pd.DataFrame(rows, columns=["wkb", "x0", "y0", "x1", "y1"])


@udtf(returnType=T.StructType([T.StructField("kx", T.LongType()), T.StructField("ky", T.LongType())]))
class RoadTiles:
    def eval(self, lon: float, lat: float, buffer_m: float):
        if lon is None or lat is None or buffer_m is None:
            return
        tile = 0.05
        dlat, dlon = buffer_m / METRES_PER_DEGREE, buffer_m / (METRES_PER_DEGREE * max(math.cos(math.radians(lat)), 1e-6))
        for kx in range(math.floor((lon - dlon) / tile), math.floor((lon + dlon) / tile) + 1):
            for ky in range(math.floor((lat - dlat) / tile), math.floor((lat + dlat) / tile) + 1):
                yield kx, ky


def register(spark: SparkSession) -> None:
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("gpkg_parse", gpkg_parse)
    spark.udtf.register("road_tiles", RoadTiles)
