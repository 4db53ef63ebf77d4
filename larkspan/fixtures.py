"""Adapters from the test tables to measurements, claims and roads, as plans and as the same SQL for the oracle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.runtime import table

_MEASUREMENTS = """
SELECT event_id AS id, user_id AS session_id, ts AS recorded_at, concat('c', CAST(user_id % 12 AS {string})) AS cell_id,
  CASE WHEN event_type = 'error' THEN 'none' WHEN event_type = 'purchase' THEN '5G-NR' ELSE 'LTE' END AS network_type,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(-70 - (event_id * event_id) % {spread} AS DOUBLE) END AS rsrp,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(-10 - event_id % 2 AS DOUBLE) END AS rsrq,
  CAST(NULL AS DOUBLE) AS sinr,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS modem_reported_at,
  -81.80{d} + ((event_id * 7919) % 1000) / 10000.0{d} AS lon, 32.35{d} + ((event_id * 104729) % 1000) / 10000.0{d} AS lat,
  'carrier' AS carrier, concat('s', CAST(event_id % 4000 AS {string})) AS sample_id
FROM {events}
"""


def measurements_sql(spread: int = 47) -> str:
    """For DuckDB."""
    return _MEASUREMENTS.format(string="VARCHAR", spread=spread, d="", events="events")


def measurements(spark: SparkSession, sf_dir: str, spread: int = 47) -> DataFrame:
    """Measurements made of ``events``; a small ``spread`` of levels gives many re-reads."""
    return spark.sql(_MEASUREMENTS.format(string="STRING", spread=spread, d="D", events="{events}"), events=table(spark, sf_dir, "events"))


# A lattice of hexes: columns, rows, radius in degrees, and its first centre; from the other latitude, a corner of hexes is a
# measured position.
COLS, ROWS, R, LON0, LAT0, EDGE_LAT0 = 16, 20, 0.004, -81.80, 32.35, 32.346
STEP_X, STEP_Y = round(R * math.sqrt(3), 6), 1.5 * R
CORNERS = [(round(R * math.sin(math.radians(60 * k)), 6), round(R * math.cos(math.radians(60 * k)), 6)) for k in range(6)]


def hexes(lat0: float = LAT0) -> list[tuple]:
    """(hex_ord, h3_res9_id, minsignal, environmnt, ring) of the filed hexes."""
    out = []
    for r in range(ROWS):
        for q in range(COLS):
            if r * q % 5 == 4:
                continue
            cx, cy = LON0 + q * STEP_X + (r % 2) * STEP_X / 2, lat0 + r * STEP_Y
            ring = [(round(cx + dx, 6), round(cy + dy, 6)) for dx, dy in CORNERS]
            out.append((r * COLS + q, f"h{r:02d}{q:02d}", float(-120 + 10 * ((r + q) % 6)), int((3 * r + q) % 11 != 5), ring))
    return out


def claims(spark: SparkSession, lat0: float = LAT0) -> DataFrame:
    rows = []
    for ord_, h3, level, env, ring in hexes(lat0):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        rows.append((ord_, h3, level, env, ring, min(xs), min(ys), max(xs), max(ys)))
    from larkspan.schemas import CLAIMS

    return spark.createDataFrame(rows, CLAIMS)


def claims_sql(lat0: float = LAT0) -> str:
    """``hex_edges``: an edge of a hex of environment 1 a row, with the hex's number, name, level and box."""
    values = []
    for ord_, h3, level, env, ring in hexes(lat0):
        if env != 1:
            continue
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        for k in range(6):
            a, b = ring[k], ring[(k + 1) % 6]
            values.append(f"({ord_},'{h3}',{level}::DOUBLE,{min(xs)}::DOUBLE,{min(ys)}::DOUBLE,{max(xs)}::DOUBLE,{max(ys)}::DOUBLE,{a[0]}::DOUBLE,{a[1]}::DOUBLE,{b[0]}::DOUBLE,{b[1]}::DOUBLE)")
    return f"SELECT * FROM (VALUES {', '.join(values)}) t(hex_ord, h3_res9_id, minsignal, x0, y0, x1, y1, ax, ay, bx, by_)"


#: Polylines in longitudes and latitudes, off the lattice of the measurements so that no two are equally near.
ROADS = [
    ("Main St", [(-81.80 + 0.01 * k, 32.40035) for k in range(11)]),
    ("Second Ave", [(-81.75045, 32.35 + 0.01 * k) for k in range(11)]),
    ("nan", [(-81.79013, 32.36), (-81.77013, 32.38027), (-81.76, 32.38027)]),
]


def roads(spark: SparkSession) -> DataFrame:
    from larkspan.functions.scalar import road_name
    from larkspan.sources.roads import SCHEMA

    rows = spark.createDataFrame([(i, line, name) for i, (name, line) in enumerate(ROADS)], SCHEMA)
    return rows.withColumn("name", road_name(F.col("name")))


#: Zone of the adapter's positions.
EPSG = 32617


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelling rows with planar coordinates."""
    from larkspan.operators.readings import modelling_rows, projected

    return projected(modelling_rows(measurements(spark, sf_dir), dedupe_runs=False, min_session_rows=1), EPSG)[0]


def field(spark: SparkSession, n: int = 300) -> DataFrame:
    """A planar field with waves, of ``n`` positions over 20 km, in sessions and radio cells: input for kriging."""
    i = F.col("id")
    x = 430_000.0 + (i * 7919) % 997 * 20.0
    y = 3_580_000.0 + (i * 104_729) % 991 * 20.0
    rows = spark.range(n).select(i.cast("long").alias("id"), x.alias("x"), y.alias("y"), (i % 6).cast("string").alias("session"), F.concat(F.lit("c"), (i % 4).cast("string")).alias("cell"))
    return rows.withColumn("value", -95 + 8 * F.sin(F.col("x") / 3000.0) + 6 * F.cos(F.col("y") / 4000.0) + (i * 31 % 11 - 5) * 0.2).withColumn("pt_idx", i)
