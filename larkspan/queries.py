"""Registered queries over the test tables, each with its DuckDB text where SQL can express it."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan import fixtures as X
from larkspan.functions import geo
from larkspan.functions.scalar import weakness_weight
from larkspan.operators import claims as C
from larkspan.operators import crossval, kriging, readings, spatial, suggest, variogram
from larkspan.plans import runs
from larkspan.runtime import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    """Registers a function under its name, with the oracle's SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql() if callable(sql) else sql
        return f

    return add


M = f"WITH m AS ({X.measurements_sql()})"
M3 = f"WITH m AS ({X.measurements_sql(3)})"
_SAME = """(lag(id) OVER w IS NOT NULL AND (coalesce(modem_reported_at = lag(modem_reported_at) OVER w, false)
  OR (rsrp IS NOT DISTINCT FROM lag(rsrp) OVER w AND rsrq IS NOT DISTINCT FROM lag(rsrq) OVER w AND sinr IS NOT DISTINCT FROM lag(sinr) OVER w)))"""
_RERUN = f"SELECT *, {_SAME} AS reread FROM m WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at, id)"


def _measurements(spark, sf, spread=47):
    return X.measurements(spark, sf, spread)


# --- readings -----------------------------------------------------------------------------------
@query(f"""{M} SELECT count(*) AS total, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE network_type = 'none') AS dead_zones, min(rsrp) AS rsrp_min, max(rsrp) AS rsrp_max,
  CAST(round(CAST(avg(rsrp) AS DECIMAL(38,10)), 2) AS DOUBLE) AS rsrp_avg, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, max(recorded_at) AS last_recorded_at FROM m""")
def stats_totals(spark, sf):
    return readings.totals(_measurements(spark, sf))


@query(f"""{M3}, r AS ({_RERUN}) SELECT session_id, count(*) AS samples, min(recorded_at) AS started_at, max(recorded_at) AS ended_at, count(*) FILTER (WHERE network_type = 'none') AS dead_zones,
  min(rsrp) AS rsrp_min, max(rsrp) AS rsrp_max, CAST(round(CAST(avg(rsrp) AS DECIMAL(38,10)), 2) AS DOUBLE) AS rsrp_avg, count(*) FILTER (WHERE reread) AS rereads,
  count(modem_reported_at) AS modem_rows, count(DISTINCT modem_reported_at) AS modem_distinct FROM r GROUP BY session_id""")
def stats_per_session(spark, sf):
    return readings.per_session(_measurements(spark, sf, 3))


@query(f"""{M3}, r AS ({_RERUN}), a AS (SELECT count(*) AS n, count(*) FILTER (WHERE reread) AS k, count(modem_reported_at) AS t FROM r)
SELECT n AS total, k AS rereads, n - k AS independent, round_even(k / nullif(n, 0), 4) AS reread_share, t AS with_modem_timestamp FROM a""")
def rereads(spark, sf):
    return readings.rereads(_measurements(spark, sf, 3))


@query(f"{M3}, r AS ({_RERUN}) SELECT id, session_id, rsrp FROM r WHERE NOT reread")
def run_start_dedupe(spark, sf):
    return readings.run_starts(_measurements(spark, sf, 3)).select("id", "session_id", "rsrp")


@query(f"{M} SELECT count(*) AS row_count, coalesce(max(id), 0) AS max_id FROM m")
def fingerprint(spark, sf):
    return readings.fingerprint(_measurements(spark, sf))


@query(f"{M} SELECT id, recorded_at FROM m WHERE recorded_at < TIMESTAMP '2024-01-15 00:00:00'")
def as_of_snapshot(spark, sf):
    return readings.as_of(_measurements(spark, sf).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz")), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "recorded_at")


_LEAST = 65


@query(f"{M} SELECT id, session_id FROM m WHERE rsrp IS NOT NULL AND session_id IN (SELECT session_id FROM m GROUP BY 1 HAVING count(*) >= {_LEAST})")
def min_session_semi(spark, sf):
    m = _measurements(spark, sf)
    return readings.large_sessions(readings.metric_rows(m), m, _LEAST).select("id", "session_id")


@query(f"{M} SELECT session_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) < {_LEAST} ORDER BY min(recorded_at)")
def excluded_sessions(spark, sf):
    return readings.excluded_sessions(_measurements(spark, sf), _LEAST)


@query(f"{M} SELECT id, coalesce(rsrp, -125.0) AS value FROM m WHERE rsrp IS NOT NULL OR network_type = 'none'")
def none_floor_load(spark, sf):
    return readings.metric_rows(_measurements(spark, sf), "rsrp", -125.0).select("id", "value")


@query(f"""{M3}, r AS ({_RERUN}) SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, coalesce(rsrp, -125.0) AS value, CAST(session_id AS VARCHAR) AS session, coalesce(cell_id, '') AS cell FROM r
WHERE NOT reread AND (rsrp IS NOT NULL OR network_type = 'none') AND session_id IN (SELECT session_id FROM m GROUP BY 1 HAVING count(*) >= {_LEAST})""")
def modelling_rows(spark, sf):
    rows = readings.modelling_rows(_measurements(spark, sf, 3), "rsrp", -125.0, True, _LEAST)
    return rows.withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@query(f"""{M3}, r AS ({_RERUN}), k AS (SELECT session_id FROM m GROUP BY 1 HAVING count(*) >= {_LEAST}), a AS (SELECT count(*) AS b, count(*) FILTER (WHERE NOT reread) AS n FROM r WHERE rsrp IS NOT NULL AND session_id IN (FROM k))
SELECT b AS n_before_dedupe, n AS n_raw, b - n AS n_dropped FROM a""")
def dedupe_counts(spark, sf):
    return readings.dedupe_counts(_measurements(spark, sf, 3), "rsrp", None, _LEAST)


@query(f"{M} SELECT sample_id, id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY id) AS n FROM m) WHERE n = 1")
def ingest_dedupe(spark, sf):
    return readings.first_per_key(_measurements(spark, sf), "sample_id", "id").select("sample_id", "id")


@query(f"{M} SELECT id, sample_id FROM m b WHERE id >= 3000 AND NOT EXISTS (SELECT 1 FROM m s WHERE s.id < 3000 AND s.sample_id = b.sample_id)")
def ingest_anti_join(spark, sf):
    m = _measurements(spark, sf)
    return readings.new_rows(m.where("id >= 3000"), m.where("id < 3000")).select("id", "sample_id")


@query(f"""{M}, i AS (SELECT count(DISTINCT sample_id) AS n FROM m b WHERE id >= 3000 AND NOT EXISTS (SELECT 1 FROM m s WHERE s.id < 3000 AND s.sample_id = b.sample_id)), r AS (SELECT count(*) AS k FROM m WHERE id >= 3000)
SELECT k AS received, n AS inserted, k - n AS skipped FROM r, i""")
def ingest_counts(spark, sf):
    m = _measurements(spark, sf)
    return readings.ingest_counts(m.where("id >= 3000"), m.where("id < 3000"), "sample_id", "id")


def _uploads(spark, sf):
    """A document a user with samples of its events; some break a rule."""
    e = table(spark, sf, "events")
    uuid = lambda n: F.format_string("%08x-0000-4000-8000-%012x", n, n)
    bad = F.col("event_id") % 97
    sample = F.to_json(
        F.struct(
            uuid(F.col("event_id")).alias("sample_id"),
            F.when(bad == 1, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("recorded_at"),
            F.when(bad == 2, 91.5).otherwise(32.4).alias("lat"), F.lit(-81.7).alias("lon"),
            F.when(bad == 3, "3G").otherwise("LTE").alias("network_type"), F.when(bad == 4, -1.0).alias("speed_mps"), F.when(bad == 5, "x").alias("surprise"),
        )
    )
    per = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(sample)), ",").alias("s"))
    body = F.concat(F.lit('{"session_id":"'), uuid(F.col("user_id")), F.lit('","carrier":"c","samples":['), F.col("s"), F.lit("]}"))
    return per.select(F.format_string("u%05d", "user_id").alias("batch"), body.alias("body"))


_FAULTS = {1: "recorded_at", 2: "lat", 3: "network_type", 4: "speed_mps", 5: "extra_key"}


@query(
    f"""WITH f AS (SELECT user_id, CASE event_id % 97 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _FAULTS.items())} END AS e FROM events)
SELECT printf('u%05d', user_id) AS batch, count(*) AS received, coalesce(string_agg(DISTINCT e, ',' ORDER BY e), '') AS errors FROM f GROUP BY user_id"""
)
def validation_errors(spark, sf):
    from larkspan.sources import batches

    return batches.verdicts(batches.parsed(_uploads(spark, sf))).withColumn("errors", F.array_join("errors", ","))


# --- claims -------------------------------------------------------------------------------------
def _hits(strict: bool) -> str:
    """Points with the hexes they are in, from edge crossings; on a boundary too unless strict."""
    edge = "(bx - ax) * (lat - ay) - (by_ - ay) * (lon - ax) = 0 AND lon BETWEEN least(ax, bx) AND greatest(ax, bx) AND lat BETWEEN least(ay, by_) AND greatest(ay, by_)"
    keep = "NOT on_edge AND crossings % 2 = 1" if strict else "on_edge OR crossings % 2 = 1"
    return f"""SELECT id, lon, lat, rsrp, hex_ord, h3_res9_id, minsignal FROM (SELECT p.id, p.lon, p.lat, p.rsrp, e.hex_ord, any_value(h3_res9_id) AS h3_res9_id, any_value(minsignal) AS minsignal,
  bool_or({edge}) AS on_edge, count(*) FILTER (WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax) AS crossings
  FROM p JOIN hex_edges e ON p.lon BETWEEN e.x0 AND e.x1 AND p.lat BETWEEN e.y0 AND e.y1 GROUP BY p.id, p.lon, p.lat, p.rsrp, e.hex_ord) WHERE {keep}"""


def _claims_sql(body: str, lat0: float = X.LAT0) -> str:
    return f"""{M}, p AS (SELECT id, lon, lat, rsrp FROM m WHERE rsrp IS NOT NULL), hex_edges AS ({X.claims_sql(lat0)}), loose AS ({_hits(False)}), strict AS ({_hits(True)}),
audit AS (SELECT p.id, p.lon, p.lat, p.rsrp, h.h3_res9_id AS h3, h.minsignal AS claimed, p.rsrp - h.minsignal AS gap, h.id IS NOT NULL AS inside, coalesce(p.rsrp - h.minsignal < 0, false) AS violation
  FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hex_ord) AS n FROM loose) h ON p.id = h.id AND h.n = 1),
best AS (SELECT *, rsrp - minsignal AS gap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY minsignal DESC, hex_ord) AS n FROM strict) WHERE n = 1),
hexes AS (SELECT h3_res9_id, first(minsignal ORDER BY hex_ord, id) AS claimed, count(*) AS n_measurements, round_even(avg(rsrp), 1) AS mean_rsrp, min(rsrp) AS min_rsrp, count(*) FILTER (WHERE rsrp < minsignal) AS n_violations,
  round_even(avg(rsrp - minsignal) FILTER (WHERE rsrp < minsignal), 2) AS mean_gap, min(rsrp - minsignal) FILTER (WHERE rsrp < minsignal) AS worst_gap, round_even(count(*) FILTER (WHERE rsrp < minsignal) / count(*), 4) AS violation_share FROM strict GROUP BY 1)
{body}"""


def _points(spark, sf):
    return _measurements(spark, sf).where("rsrp is not null").select("id", "lon", "lat", "rsrp")


def _claims(spark, lat0=X.LAT0):
    return C.claims_near(X.claims(spark, lat0), 1)


def _audit(spark, sf):
    return runs.audit(_measurements(spark, sf), X.claims(spark))


@query(_claims_sql("SELECT id, rsrp, h3, claimed, gap, inside, violation FROM audit"))
def audit_points(spark, sf):
    return _audit(spark, sf).drop("lon", "lat")


@query(_claims_sql("SELECT claimed, count(*) AS points, count(*) FILTER (WHERE violation) AS violations, round_even(avg(rsrp), 1) AS avg_measured FROM audit WHERE inside GROUP BY 1"))
def audit_by_tier(spark, sf):
    return C.by_tier(_audit(spark, sf))


@query(
    _claims_sql("""SELECT count(*) AS total, count(*) FILTER (WHERE inside) AS n_inside, count(*) FILTER (WHERE NOT inside) AS n_outside, count(*) FILTER (WHERE violation) AS violations,
  round_even(count(*) FILTER (WHERE violation) / nullif(count(*) FILTER (WHERE inside), 0), 4) AS share_of_inside, round_even(avg(gap) FILTER (WHERE violation), 2) AS avg_gap,
  min(gap) FILTER (WHERE violation) AS worst_gap, (SELECT id FROM audit WHERE violation ORDER BY gap, id LIMIT 1) AS worst_id FROM audit""")
)
def audit_summary(spark, sf):
    return C.summary(_audit(spark, sf))


@query(_claims_sql("SELECT id, gap FROM audit WHERE violation"))
def audit_worst(spark, sf):
    return C.violations(_audit(spark, sf)).select("id", "gap")


@query(_claims_sql("SELECT id, h3_res9_id AS h3, minsignal AS claimed, gap FROM best"))
def audit_distinct_on(spark, sf):
    return C.strict_matches(_points(spark, sf), _claims(spark)).select("id", "h3", "claimed", "gap")


@query(_claims_sql("SELECT DISTINCT id FROM loose WHERE id NOT IN (SELECT id FROM strict)", X.EDGE_LAT0))
def audit_boundary_only(spark, sf):
    return C.boundary_only(_points(spark, sf), _claims(spark, X.EDGE_LAT0)).select("id")


@query(
    _claims_sql("""SELECT (SELECT count(*) FROM p) AS total, count(*) AS n_inside, count(*) FILTER (WHERE gap < 0) AS violations, round_even(count(*) FILTER (WHERE gap < 0) / nullif(count(*), 0), 4) AS share_of_inside,
  round_even(count(*) FILTER (WHERE gap < 0) / nullif((SELECT count(*) FROM p), 0), 4) AS share_of_all, CAST(round(CAST(avg(gap) FILTER (WHERE gap < 0) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_gap,
  min(gap) FILTER (WHERE gap < 0) AS worst_gap, (SELECT count(DISTINCT id) FROM loose WHERE id NOT IN (SELECT id FROM strict)) AS boundary_only_points FROM best""", X.EDGE_LAT0)
)
def check_summary(spark, sf):
    return C.check_summary(_points(spark, sf), _claims(spark, X.EDGE_LAT0))


@query(_claims_sql("SELECT minsignal AS claimed, count(*) AS points, count(*) FILTER (WHERE gap < 0) AS violations, CAST(round(CAST(avg(rsrp) AS DECIMAL(38,10)), 1) AS DOUBLE) AS avg_measured FROM best GROUP BY 1"))
def check_by_tier(spark, sf):
    return C.check_by_tier(_points(spark, sf), _claims(spark))


@query(_claims_sql("SELECT * FROM hexes"))
def hex_publish(spark, sf):
    return C.per_hex(_points(spark, sf), _claims(spark))


@query(_claims_sql("SELECT h3_res9_id, n_measurements, n_violations, worst_gap FROM hexes WHERE n_violations >= 1 AND n_measurements >= 25"))
def hex_publish_floor(spark, sf):
    return C.published(C.per_hex(_points(spark, sf), _claims(spark)), 25).select("h3_res9_id", "n_measurements", "n_violations", "worst_gap")


@query(
    _claims_sql("""SELECT *, hex_points = audit_points AND hex_violations = audit_violations AS agrees FROM (SELECT CAST(coalesce(sum(n_measurements), 0) AS BIGINT) AS hex_points, CAST(coalesce(sum(n_violations), 0) AS BIGINT) AS hex_violations FROM hexes),
  (SELECT count(*) FILTER (WHERE inside) AS audit_points, count(*) FILTER (WHERE violation) AS audit_violations FROM audit)""")
)
def totals_reconcile(spark, sf):
    return C.reconcile(C.per_hex(_points(spark, sf), _claims(spark)), _audit(spark, sf))


@query(_claims_sql("SELECT DISTINCT hex_ord FROM hex_edges WHERE x1 >= -81.79 AND x0 <= -81.75 AND y1 >= 32.36 AND y0 <= 32.40"))
def claims_bbox(spark, sf):
    return C.claims_near(X.claims(spark), 1, (-81.79, 32.36, -81.75, 32.40)).select("hex_ord")


# --- points -------------------------------------------------------------------------------------
def _utm_sql(lon: str = "lon", lat: str = "lat") -> tuple[str, str]:
    """Easting and northing over columns xi, eta, and the SQL that makes those of a table."""
    x = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    y = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    k = geo.SCALE * geo.RADIUS
    return f"{geo.FALSE_EASTING} + {k!r} * ({x})", f"{k!r} * ({y})"


def _flat_sql(where: str = "rsrp IS NOT NULL") -> str:
    """``q``: id, value, session, cell, x, y of measurements in the zone of the fixtures."""
    x, y = _utm_sql()
    e = repr(geo.ECCENTRIC)
    return f"""{M}, t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t_, radians(lon + 81.0) AS lam FROM m WHERE {where}),
u AS (SELECT *, atan2(t_, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t_ * t_)) AS eta FROM t),
q AS (SELECT id, rsrp AS value, CAST(session_id AS VARCHAR) AS session, coalesce(cell_id, '') AS cell, lon, lat, {x} AS x, {y} AS y FROM u)"""


@query(f"{_flat_sql()} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM q")
def utm_project(spark, sf):
    return X.points(spark, sf).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"{_flat_sql()} SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM q")
def utm_round_trip(spark, sf):
    return readings.with_lonlat(X.points(spark, sf).drop("lon", "lat"), X.EPSG).select("id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(f"{_flat_sql()} SELECT round(min(x), 3) AS x_min, round(max(x), 3) AS x_max, round(min(y), 3) AS y_min, round(max(y), 3) AS y_max FROM q")
def cloud_bounds(spark, sf):
    b = readings.cloud_bounds(X.points(spark, sf))
    return b.select(*(F.round(c, 3).alias(c) for c in b.columns))


_SNAP = 700.0


@query(
    f"""{_flat_sql()} SELECT row_number() OVER (ORDER BY kx, ky) - 1 AS pt_idx, * EXCLUDE (kx, ky) FROM (SELECT round_even(x / {_SNAP}, 0) AS kx, round_even(y / {_SNAP}, 0) AS ky, min(id) AS id, round(avg(x), 3) AS x, round(avg(y), 3) AS y,
  round(avg(value), 6) AS value, arg_min(session, id) AS session, arg_min(cell, id) AS cell, count(*) AS n_members FROM q GROUP BY 1, 2)"""
)
def collapse_coincident(spark, sf):
    rows = readings.collapse_coincident(X.points(spark, sf), _SNAP)
    return rows.withColumns({"x": F.round("x", 3), "y": F.round("y", 3), "value": F.round("value", 6)}).withColumn("pt_idx", F.col("pt_idx").cast("long"))


@query(f"{_flat_sql()} SELECT cell, round(sum(x * pow(10, value / 10)) / sum(pow(10, value / 10)), 4) AS x, round(sum(y * pow(10, value / 10)) / sum(pow(10, value / 10)), 4) AS y, count(*) AS n FROM q WHERE cell <> '' GROUP BY 1 HAVING count(*) >= 20")
def towers(spark, sf):
    return spatial.estimate_towers(X.points(spark, sf)).select("cell", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "n")


_TOWERS = "w AS (SELECT cell, sum(x * pow(10, value / 10)) / sum(pow(10, value / 10)) AS tx, sum(y * pow(10, value / 10)) / sum(pow(10, value / 10)) AS ty FROM q WHERE cell <> '' GROUP BY 1 HAVING count(*) >= 20), d AS (SELECT q.id, any_value(value) AS value, greatest(min(sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))), 30.0) AS tower_m FROM q, w GROUP BY 1)"


def _with_towers(spark, sf):
    p = X.points(spark, sf)
    return spatial.nearest_tower(p, spatial.estimate_towers(p))


@query(f"{_flat_sql()}, {_TOWERS} SELECT id, round(tower_m, 3) AS tower_m FROM d")
def nearest_tower(spark, sf):
    return _with_towers(spark, sf).select("id", F.round("tower_m", 3).alias("tower_m"))


@query(f"{_flat_sql()}, {_TOWERS} SELECT round(regr_intercept(value, log10(tower_m)), 5) AS intercept, round(regr_slope(value, log10(tower_m)), 5) AS slope FROM d")
def ols_trend(spark, sf):
    return spatial.trend(_with_towers(spark, sf)).select(F.round("intercept", 5).alias("intercept"), F.round("slope", 5).alias("slope"))


#: Readings this near to each other are one modelled point.
_NEAR = 25.0


def _merged_sql(snap: float) -> str:
    """``c``: the modelled points, merged on a lattice."""
    return f"""{_flat_sql()}, c AS (SELECT min(id) AS id, avg(x) AS x, avg(y) AS y, avg(value) AS value, arg_min(session, id) AS session FROM q GROUP BY round_even(x / {snap}, 0), round_even(y / {snap}, 0))"""


def _variogram_sql(edges: str) -> str:
    return f"""{_merged_sql(_NEAR)}, pairs AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, 0.5 * (a.value - b.value) * (a.value - b.value) AS s FROM c a JOIN c b ON a.id < b.id),
e AS (SELECT min(d) FILTER (WHERE d > 0) AS lo, max(d) AS hi FROM pairs), edges AS ({edges}), bins AS (SELECT k, v AS v0, lead(v) OVER (ORDER BY k) AS v1 FROM edges)
SELECT CAST(k AS INTEGER) AS bin, round(avg(d), 3) AS lag, round(avg(s), 4) AS semivariance, count(*) AS pairs FROM pairs JOIN bins ON d >= v0 AND d < v1 WHERE d > 0 GROUP BY k HAVING count(*) >= 10"""


def _rounded_bins(df):
    return df.select("bin", F.round("lag", 3).alias("lag"), F.round("semivariance", 4).alias("semivariance"), "pairs")


@query(_variogram_sql("SELECT k, 12000.0 * k / 15 AS v FROM e, range(16) r(k)"))
def variogram_linear(spark, sf):
    return _rounded_bins(variogram.empirical(readings.collapse_coincident(X.points(spark, sf), _NEAR), 15, "linear", 12000.0))


@query(_variogram_sql("SELECT k, CASE WHEN k = 0 THEN greatest(25.0, lo) WHEN k = 15 THEN 12000.0 ELSE pow(10, log10(greatest(25.0, lo)) + (log10(12000.0) - log10(greatest(25.0, lo))) * k / 15) END AS v FROM e, range(16) r(k)"))
def variogram_log(spark, sf):
    return _rounded_bins(variogram.empirical(readings.collapse_coincident(X.points(spark, sf), _NEAR), 15, "log", 12000.0))


# --- grids, surfaces, roads ---------------------------------------------------------------------
_CELL = 400.0
_GRID = f"""b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q), g AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, x0 + c * {_CELL} AS gx, y0 + r * {_CELL} AS gy FROM b,
  range(CAST(ceil((b.y1 + {_CELL} - b.y0) / {_CELL}) AS BIGINT)) rr(r), range(CAST(ceil((b.x1 + {_CELL} - b.x0) / {_CELL}) AS BIGINT)) cc(c))"""


def _grid(spark, sf):
    return spatial.make_grid(X.points(spark, sf), _CELL)


@query(f"{_flat_sql()}, {_GRID} SELECT row, col, round(gx, 3) AS x, round(gy, 3) AS y FROM g")
def grid_build(spark, sf):
    return _grid(spark, sf).select("row", "col", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"{_flat_sql()}, {_GRID} SELECT row, col, EXISTS (SELECT 1 FROM q WHERE sqrt((q.x - gx) * (q.x - gx) + (q.y - gy) * (q.y - gy)) <= 150.0) AS supported FROM g")
def support_mask(spark, sf):
    return spatial.support_mask(_grid(spark, sf), X.points(spark, sf), 150.0).select("row", "col", "supported")


# a surface by formula: a hole where (row + col) % 7 = 0
def _surface(spark, sf):
    g = _grid(spark, sf)
    known = (F.col("row") + F.col("col")) % 7 != 0
    sd = F.when(known, 4.0 + (F.col("row") * 31 + F.col("col") * 17) % 23 * 0.25)
    return g.withColumns({"mean": F.when(known, -90.0 - (F.col("row") * 13 + F.col("col") * 7) % 41), "variance": sd * sd, "stddev": sd})


_SURFACE = f"""{_GRID}, s AS (SELECT row, col, gx AS x, gy AS y, CASE WHEN (row + col) % 7 <> 0 THEN -90.0 - (row * 13 + col * 7) % 41 END AS mean,
  CASE WHEN (row + col) % 7 <> 0 THEN 4.0 + ((row * 31 + col * 17) % 23) * 0.25 END::DOUBLE AS stddev FROM g)"""


@query(f"{_flat_sql()}, {_SURFACE} SELECT min(mean)::DOUBLE AS mean_min, max(mean)::DOUBLE AS mean_max, round(avg(mean), 6) AS mean_avg, min(stddev) AS stddev_min, max(stddev) AS stddev_max, round(avg(stddev), 6) AS stddev_avg, count(mean) AS n_predicted FROM s")
def surface_stats(spark, sf):
    return spatial.surface_stats(_surface(spark, sf)).withColumns({"mean_avg": F.round("mean_avg", 6), "stddev_avg": F.round("stddev_avg", 6)})


@query(f"{_flat_sql()}, {_SURFACE} SELECT row, col, stddev FROM s WHERE stddev >= (SELECT quantile_cont(stddev, 0.7) FROM s WHERE stddev IS NOT NULL)")
def candidate_cells(spark, sf):
    return spatial.candidate_cells(_surface(spark, sf), 0.7).select("row", "col", "stddev")


@query(
    f"""{_flat_sql()}, {_SURFACE}, c AS (SELECT * FROM s WHERE stddev >= (SELECT quantile_cont(stddev, 0.9) FROM s WHERE stddev IS NOT NULL))
SELECT c.row, c.col, round(sum(exp(-3.0 * sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) / 1500.0) * s.stddev * s.stddev), 4) AS score FROM c JOIN s ON s.stddev IS NOT NULL AND sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) <= 1500.0 GROUP BY 1, 2"""
)
def evr_scores(spark, sf):
    s = _surface(spark, sf)
    return spatial.expected_reduction(spatial.candidate_cells(s, 0.9), s, 1500.0, _CELL).select("row", "col", F.round("score", 4).alias("score"))


@query(f"{_flat_sql()}, {_SURFACE} SELECT row, col, round(1 + 0.5 * least(1.0, greatest(0.0, (-95.0 - mean) / 25.0)), 6)::DOUBLE AS weight FROM s WHERE mean IS NOT NULL")
def weakness(spark, sf):
    return _surface(spark, sf).where("mean is not null").select("row", "col", F.round(weakness_weight(F.col("mean")), 6).alias("weight"))


@query(
    f"""{_flat_sql()}, {_SURFACE}, h AS (SELECT max(row) AS hr, max(col) AS hc FROM s), n AS (SELECT id, least(hr, greatest(0, CAST(round_even((y - y0) / {_CELL}, 0) AS INTEGER))) AS r, least(hc, greatest(0, CAST(round_even((x - x0) / {_CELL}, 0) AS INTEGER))) AS c FROM q, b, h)
SELECT id, s.stddev AS at_stddev FROM n JOIN s ON s.row = r AND s.col = c"""
)
def sample_nearest(spark, sf):
    s = _surface(spark, sf)
    e = s.agg(F.min("x"), F.min("y"), F.max("row"), F.max("col")).first()
    return spatial.sample_nearest(X.points(spark, sf), s, e[0], e[1], e[2] + 1, e[3] + 1, _CELL).select("id", "at_stddev")


def _segments(spark):
    def flat(p):
        x, y = geo.utm_forward(p["x"], p["y"], X.EPSG)
        return F.struct(x.alias("x"), y.alias("y"))

    return spatial.road_segments(X.roads(spark).withColumn("line", F.transform("line", flat)))


def _segments_sql() -> str:
    values = []
    for i, (name, line) in enumerate(X.ROADS):
        x, y = geo.utm_forward_np([p[0] for p in line], [p[1] for p in line], X.EPSG)
        for k in range(len(line) - 1):
            values.append(f"({i},{k},{'NULL' if name == 'nan' else repr(name)},{x[k]!r}::DOUBLE,{y[k]!r}::DOUBLE,{x[k + 1]!r}::DOUBLE,{y[k + 1]!r}::DOUBLE)".replace("np.float64(", "").replace(")::DOUBLE", "::DOUBLE"))
    return f"SELECT * FROM (VALUES {', '.join(values)}) t(road_idx, seg_idx, name, x1, y1, x2, y2)"


@query(
    lambda: f"""{_flat_sql()}, g AS ({_segments_sql()}), f AS (SELECT q.id, g.*, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t, x, y FROM q, g),
d AS (SELECT *, sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)) AS d FROM f)
SELECT id, round(d, 3) AS road_m, name AS road_name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, road_idx, seg_idx) AS n FROM d WHERE d <= 250.0) WHERE n = 1"""
)
def nearest_road(spark, sf):
    return spatial.nearest_road(X.points(spark, sf), _segments(spark), 250.0).select("id", F.round("road_m", 3).alias("road_m"), "road_name")


@query(
    f"""{M}, r AS (SELECT id, k.kx, l.ky FROM m, LATERAL (SELECT unnest(range(CAST(floor((lon - 250.0 / (111320.0 * cos(radians(lat)))) / 0.05) AS BIGINT), CAST(floor((lon + 250.0 / (111320.0 * cos(radians(lat)))) / 0.05) AS BIGINT) + 1)) AS kx) k,
  LATERAL (SELECT unnest(range(CAST(floor((lat - 250.0 / 111320.0) / 0.05) AS BIGINT), CAST(floor((lat + 250.0 / 111320.0) / 0.05) AS BIGINT) + 1)) AS ky) l)
SELECT CAST(row_number() OVER (ORDER BY min(id), kx, ky) AS INTEGER) AS tile, kx, ky, count(*) OVER () AS wanted FROM r GROUP BY kx, ky"""
)
def road_tiles(spark, sf):
    p = _measurements(spark, sf).select(F.col("id").alias("pos"), "lon", "lat")
    return spatial.road_tiles(p, 250.0).select("tile", "kx", "ky", "wanted")


@query(f"SELECT * FROM (VALUES (0, {X.ROADS[0][0]!r}, {len(X.ROADS[0][1])}), (1, {X.ROADS[1][0]!r}, {len(X.ROADS[1][1])}), (2, NULL, {len(X.ROADS[2][1])})) t(road_idx, name, points)")
def road_tile_union(spark, sf):
    r = X.roads(spark)
    tiles = r.withColumn("tile", F.lit(0)).unionByName(r.where("road_idx < 2").withColumn("tile", F.lit(1)))
    return spatial.union_tiles(tiles).select(F.col("road_idx").cast("int").alias("road_idx"), "name", F.size("line").alias("points"))


# --- validation ---------------------------------------------------------------------------------
def _cloud(spark, sf, snap=700.0):
    """All readings with a level, merged on a lattice to points that dense systems take."""
    return kriging.cloud(readings.collapse_coincident(X.points(spark, sf), snap))


@query(f"{_merged_sql(700.0)} SELECT session, CAST(dense_rank() OVER (ORDER BY session) - 1 AS INTEGER) AS fold, count(*) AS n FROM c GROUP BY 1")
def session_folds(spark, sf):
    c = _cloud(spark, sf)
    rows = spark.createDataFrame(c.assign(fold=crossval.label_folds(c["session"])))
    return rows.groupBy("session", F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_merged_sql(700.0)}, bt AS (SELECT CAST(floor((x - min(x) OVER ()) / 2000) AS BIGINT) * 1000003 + CAST(floor((y - min(y) OVER ()) / 2000) AS BIGINT) AS tile FROM c) SELECT tile, count(*) AS n FROM bt GROUP BY 1")
def block_tiles(spark, sf):
    c = _cloud(spark, sf)
    return spark.createDataFrame(c.assign(tile=crossval.block_tiles(c["x"], c["y"]))).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT o_orderkey % 5 AS fold, o_totalprice / 1000 AS actual, o_totalprice / 1000 + (o_orderkey * 37 % 101 - 50) / 10.0 AS predicted, (o_orderkey % 7) / 1.0 AS kstd FROM orders),
e AS (SELECT *, predicted - actual AS e, CASE WHEN kstd > 0 THEN (predicted - actual) / kstd END AS z FROM r)
SELECT count(*) AS n, count(DISTINCT fold) AS folds, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(abs(e)), 5) AS mae, round(avg(e), 5) AS bias, round(corr(actual, predicted), 5) AS r, round(1 - sum(e * e) / (var_pop(actual) * count(*)), 5) AS r2,
  round(avg(kstd), 5) AS mean_kriging_std, round(stddev_pop(e), 5) AS std_error, round(stddev_pop(z), 5) AS std_std_resid, round(avg(CASE WHEN abs(z) <= 1 THEN 1.0 WHEN z IS NOT NULL THEN 0.0 END), 5) AS within_1s, round(avg(CASE WHEN abs(z) <= 2 THEN 1.0 WHEN z IS NOT NULL THEN 0.0 END), 5) AS within_2s,
  CASE WHEN 1 - sum(e * e) / (var_pop(actual) * count(*)) >= 0.5 THEN 'strong' WHEN 1 - sum(e * e) / (var_pop(actual) * count(*)) >= 0.2 THEN 'moderate' WHEN 1 - sum(e * e) / (var_pop(actual) * count(*)) > 0 THEN 'weak' ELSE 'none' END AS skill,
  CASE WHEN stddev_pop(z) BETWEEN 0.8 AND 1.25 THEN 'well-calibrated' WHEN stddev_pop(z) > 1.25 THEN 'overconfident' ELSE 'underconfident' END AS calibration FROM e"""
)
def cv_metrics(spark, sf):
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice") / 1000
    rows = o.select(F.lit("x").alias("config"), F.lit("x").alias("scheme"), (F.col("o_orderkey") % 5).alias("fold"), price.alias("actual"), (price + (F.col("o_orderkey") * 37 % 101 - 50) / 10.0).alias("predicted"), ((F.col("o_orderkey") % 7) / 1.0).alias("kstd"))
    m = crossval.metrics(rows)
    return m.select("n", "folds", *(F.round(c, 5).alias(c) for c in ("rmse", "mae", "bias", "r", "r2", "mean_kriging_std", "std_error", "std_std_resid", "within_1s", "within_2s")), "skill", "calibration")


@query(
    lambda: "SELECT CAST(l_partkey % 50 AS BIGINT) AS d, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in {"linear": "(0.2 * d_ + 1.0)", "power": "(0.5 * pow(d_, 1.2) + 1.0)", "spherical": "(CASE WHEN d_ <= 30.0 THEN 9.0 * (1.5 * d_ / 30.0 - 0.5 * pow(d_ / 30.0, 3)) ELSE 9.0 END + 1.0)", "exponential": "(9.0 * (1 - exp(-d_ / 10.0)) + 1.0)", "gaussian": "(9.0 * (1 - exp(-pow(d_ / (30.0 * 4.0 / 7.0), 2))) + 1.0)", "hole_effect": "(9.0 * (1 - (1 - d_ / 10.0) * exp(-d_ / 10.0)) + 1.0)"}.items()) + " FROM (SELECT DISTINCT l_partkey % 50 AS l_partkey, CAST(l_partkey % 50 AS DOUBLE) AS d_ FROM lineitem)"
)
def variogram_models(spark, sf):
    from larkspan.functions.scalar import variogram as v

    d = F.col("d").cast("double")
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("d")).distinct()
    args = {"linear": (0.2, 1.0, 1.0), "power": (0.5, 1.2, 1.0)}
    return rows.select("d", *(F.round(v(d, m, *args.get(m, (9.0, 30.0, 1.0))), 6).alias(m.replace("-", "_")) for m in variogram.MODELS))


# --- kriging: not expressible in SQL ------------------------------------------------------------
@query()
def krige_grid(spark, sf):
    points = readings.collapse_coincident(X.points(spark, sf), 700.0)
    model = kriging.fit_cloud(kriging.factory("ordinary", model="exponential")(), kriging.cloud(points))
    grid = spatial.support_mask(spatial.make_grid(points, 500.0), points, kriging.support_radius(model, 0.3))
    return kriging.predict_grid(grid, model)


@query()
def variogram_fit(spark, sf):
    cloud = _cloud(spark, sf)
    rows = []
    for m in variogram.MODELS:
        model = kriging.fit_cloud(kriging.factory("ordinary", model=m)(), cloud)
        p = [float(v) for v in model.params]
        rows.append((m, p[0], p[1] if len(p) > 2 else None, p[-1], model.report()["rmse"]))
    return spark.createDataFrame(rows, "model string, first double, second double, nugget double, rmse double")


def _cv(scheme):
    def run(spark, sf):
        held = crossval.validate(spark, _cloud(spark, sf), {"mode": "ordinary", "model": "exponential"}, 5, 0, 4000.0, (scheme,))
        return crossval.metrics(held)

    run.__name__ = f"cv_{scheme}"
    return run


for _scheme in crossval.SCHEMES:
    query()(_cv(_scheme))


@query()
def pathloss(spark, sf):
    # finer, so that each radio cell keeps points enough to place its tower
    points = readings.collapse_coincident(X.points(spark, sf), 500.0)
    model = kriging.fit_cloud(kriging.factory("pathloss", model="exponential")(), kriging.cloud(points))
    return kriging.predict_grid(spatial.support_mask(spatial.make_grid(points, 1000.0), points, None), model)


@query()
def compare_models(spark, sf):
    return crossval.compare(spark, _cloud(spark, sf, 500.0), {}, 4)


@query()
def anisotropy_scan(spark, sf):
    return crossval.scan_anisotropy(spark, _cloud(spark, sf, 1000.0), {}, 3)


@query()
def suggest_targets(spark, sf):
    return runs.targets(_surface(spark, sf), X.roads(spark), X.EPSG, _CELL, 1500.0, apart_m=1000.0)


@query()
def route(spark, sf):
    r = suggest_targets(spark, sf)
    return r.select("visit_order", "rank", "road_name", F.round("x", 1).alias("x"), F.round("y", 1).alias("y")).orderBy("visit_order")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
