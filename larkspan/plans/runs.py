"""Whole runs: coverage audit, interpolation, suggestion of targets, refresh on change."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.geo import utm_forward
from larkspan.operators import claims as C
from larkspan.operators import crossval, kriging, readings, spatial, suggest
from larkspan.sinks import documents
from larkspan.sources import geotiff, roads
from larkspan.sources.config import Config


# --- audit --------------------------------------------------------------------------------------
def audit(measurements: DataFrame, claims: DataFrame, environment: int = 1) -> DataFrame:
    """Raw readings with a level against the claims around them."""
    points = measurements.where("rsrp is not null").select("id", "lon", "lat", "rsrp")
    box = C.bounds_of(points)
    near = C.claims_near(claims, environment, box) if box else claims.limit(0)
    return C.evaluate(points, near)


def audit_text(row: dict) -> str:
    """The summary of an audit in a few sentences."""
    if not row["n_inside"]:
        return f"Of {row['total']} measurements none lies in a claimed area."
    out = f"Of {row['total']} measurements {row['n_inside']} lie in claimed areas; {row['violations']} ({row['share_of_inside']:.1%}) are below the claimed level."
    return out + (f" On average they fall short by {-row['avg_gap']:.1f} dB, at worst by {-row['worst_gap']:.1f} dB (measurement {row['worst_id']})." if row["violations"] else "")


def write_audit(audited: DataFrame, folder: str, prefix: str = "claims") -> dict:
    """Report and violations of an audit as files; the report."""
    head = C.summary(audited).first().asDict()
    tiers = [r.asDict() for r in C.by_tier(audited).collect()]  # a row for each claimed level
    report = {"summary": head, "by_tier": tiers, "text": audit_text(head)}
    documents.write_report(f"{folder}/{prefix}_report.json", report)
    documents.write_collection(documents.violation_features(audited.where("violation")), f"{folder}/{prefix}_violations.geojson", total=head["violations"])
    return report


def publish(measurements: DataFrame, claims: DataFrame, audited: DataFrame, path: str, least: int = 3, moment=None) -> DataFrame:
    """Hexes with enough measurements as one file, after their totals are found to agree with the audit's."""
    rows = readings.as_of(measurements, moment).where("rsrp is not null")
    hexes = C.per_hex(rows, claims)
    C.require_reconciled(hexes, audited)
    out = C.published(hexes, least).join(claims.select("h3_res9_id", "ring").dropDuplicates(["h3_res9_id"]), "h3_res9_id")
    totals = hexes.agg(F.sum("n_measurements").alias("measurements"), F.sum("n_violations").alias("violations"), F.count(F.lit(1)).alias("hexes")).first().asDict()
    documents.write_collection(documents.hex_features(out), path, audited=totals, published={"hexes": out.count(), "min_measurements": least})
    return out


# --- interpolation ------------------------------------------------------------------------------
@dataclass
class Run:
    surface: DataFrame
    metrics: list[dict]
    model: object
    report: dict = field(default_factory=dict)
    paths: dict = field(default_factory=dict)

    @property
    def headline(self) -> dict | None:
        """The scheme by session if it ran, else the first."""
        by = {m["scheme"]: m for m in self.metrics}
        return by.get("session") or (self.metrics[0] if self.metrics else None)


def points_of(measurements: DataFrame, config: Config, metric: str = "rsrp") -> tuple[DataFrame, int]:
    rows = readings.modelling_rows(measurements, metric, config.none_floor, config.dedupe_runs, config.min_session_rows)
    flat, epsg = readings.projected(rows)
    return readings.collapse_coincident(flat), epsg


def interpolate(measurements: DataFrame, config: Config, metric: str = "rsrp", folder: str | None = None, on_cv: Callable[[dict], None] | None = None, validate: bool = True) -> Run:
    """Validation first, then fit, grid with its support, prediction, and files if a folder is given."""
    spark = measurements.sparkSession
    points, epsg = points_of(measurements, config, metric)
    cloud = kriging.cloud(points)
    if cloud.empty:
        raise ValueError("no points to model")
    rows = []
    if validate:
        held = crossval.validate(spark, cloud, config.model(), config.folds, config.seed, config.block_m)
        rows = [r.asDict() for r in crossval.metrics(held).collect()]
        for r in rows if on_cv else ():
            on_cv(r)
    model = kriging.fit_cloud(kriging.factory(**config.model())(), cloud)
    radius = kriging.support_radius(model, config.support_range_multiple)
    known = spark.createDataFrame(cloud)
    grid = spatial.support_mask(spatial.make_grid(known, config.cell_m), known, radius)
    surface = kriging.predict_grid(grid, model)
    run = Run(surface, rows, model)
    run.report = {"metric": metric, "epsg": epsg, "cross_validation": {r["scheme"]: r for r in rows}, "variogram": model.report(), "data": {"points": len(cloud), "min_session_rows": config.min_session_rows, "dedupe_runs": config.dedupe_runs}, "grid": {"cell_m": config.cell_m, "support_radius_m": radius}}
    if folder:
        surface = surface.persist()
        run.report["surface"] = spatial.surface_stats(surface).first().asDict()
        run.report["grid"]["cells"] = surface.count()
        run.report["data"]["excluded_sessions"] = readings.excluded_sessions(measurements, config.min_session_rows).count()
        run.paths = geotiff.write_surfaces(surface, folder, metric, config.cell_m, epsg)
        documents.write_report(f"{folder}/{metric}_report.json", run.report | {"outputs": run.paths})
        surface.unpersist()
    return run


# --- targets ------------------------------------------------------------------------------------
def targets(surface: DataFrame, lines: DataFrame, epsg: int, cell: float, range_m: float | None, top_n: int = 10, quantile: float = 0.70, most_road_m: float = 250.0, apart_m: float = 1200.0, weak_bias: float = 0.5) -> DataFrame:
    """Suggestions over a surface; ``lines`` are roads in longitudes and latitudes."""

    def flat(p):
        x, y = utm_forward(p["x"], p["y"], epsg)
        return F.struct(x.alias("x"), y.alias("y"))

    segments = spatial.road_segments(lines.withColumn("line", F.transform("line", flat)))
    scored = suggest.scored_candidates(surface, segments, cell, quantile, most_road_m, range_m, weak_bias).persist()
    try:
        return suggest.suggestions(scored, epsg, top_n, apart_m, range_m)
    finally:
        scored.unpersist()


def suggest_over(surface: DataFrame, place: dict, range_m: float | None, cache: str, folder: str, metric: str = "rsrp", fetch=None, refresh_roads: bool = False, **options) -> dict:
    """Suggestions over a deviation surface and the roads near its candidates, as GeoJSON and, if there are any, GPX."""
    spark = surface.sparkSession
    from larkspan.functions.geo import utm_inverse

    cells = spatial.candidate_cells(surface, options.get("quantile", 0.70))
    lon, lat = utm_inverse(F.col("x"), F.col("y"), place["epsg"])
    # the most uncertain cells claim their tiles first
    at = cells.select(F.struct(-F.col("stddev"), "row", "col").alias("pos"), lon.alias("lon"), lat.alias("lat"))
    tiles = spatial.road_tiles(at, options.get("most_road_m", 250.0)).orderBy("tile").collect()  # at most 96 rows
    boxes = [(t["lon0"], t["lat0"], t["lon1"], t["lat1"]) for t in tiles]
    lines = spatial.union_tiles(roads.roads_of_tiles(spark, boxes, cache, fetch, refresh_roads))
    out = targets(surface, lines, place["epsg"], place["cell"], range_m, **options)
    rows = [r.asDict() for r in out.orderBy("rank").collect()]  # top_n rows
    wanted = tiles[0]["wanted"] if tiles else 0
    documents.write_collection(documents.suggestion_features(out, metric), f"{folder}/{metric}_suggestions.geojson", tiles_fetched=len(boxes), tiles_wanted=wanted)
    documents.write_gpx(f"{folder}/{metric}_suggestions.gpx", rows, metric)
    return {"suggestions": rows, "tiles_fetched": len(boxes), "tiles_wanted": wanted, "range_m": range_m}


def suggest_from_file(spark: SparkSession, tif: str, cache: str, folder: str, metric: str = "rsrp", **options) -> dict:
    """:func:`suggest_over` a stored raster, with the range of the report beside it."""
    surface, place = geotiff.read_surface(spark, tif)
    return suggest_over(surface, place, documents.range_of_report(str(Path(tif).parent / f"{metric}_report.json")), cache, folder, metric, **options)


def suggest_recomputed(measurements: DataFrame, config: Config, cache: str, folder: str, metric: str = "rsrp", **options) -> dict:
    """:func:`suggest_over` a surface fitted anew, with the settings of an interpolation, its support mask included; nothing
    is validated or written of it."""
    run = interpolate(measurements, config, metric, validate=False)
    surface = run.surface.persist()
    try:
        return suggest_over(surface, {"epsg": run.report["epsg"], "cell": config.cell_m}, run.model.range_m, cache, folder, metric, **options)
    finally:
        surface.unpersist()


# --- refresh ------------------------------------------------------------------------------------
def should_refresh(before: dict | None, now: dict) -> bool:
    """Whether a table of this count and largest id differs from that of the last run; an empty one never calls for one."""
    if not now.get("row_count"):
        return False
    return not isinstance(before, dict) or (before.get("row_count"), before.get("max_id")) != (now["row_count"], now["max_id"])


def refresh(measurements: DataFrame, state_path: str, work: Callable[[], dict | None], force: bool = False) -> bool:
    """Runs ``work`` if the table has changed; the state, taken before, is stored only after it has succeeded, with what
    ``work`` returns."""
    now = readings.fingerprint(measurements).first().asDict()
    if not force and not should_refresh(documents.read_report(state_path), now):
        return False
    more = work()
    documents.write_report(state_path, now | {"refreshed_at": time.time()} | (more if isinstance(more, dict) else {}))
    return True


def refresh_all(measurements: DataFrame, config: Config, metric: str, cache: str, fetch=None, force: bool = False) -> dict | None:
    """Surfaces, then suggestions over them, if the table has changed; the headline of the validation and the number of
    suggestions, or None."""
    done: dict = {}

    def work() -> dict:
        run = interpolate(measurements, config, metric, config.output_dir)
        found = suggest_from_file(measurements.sparkSession, run.paths["stddev"], cache, config.output_dir, metric, fetch=fetch)
        head = run.headline or {}
        done.update(kriging=config.kriging, scheme=head.get("scheme"), rmse=head.get("rmse"), suggestions=len(found["suggestions"]))
        return done

    return done if refresh(measurements, f"{config.output_dir}/state.json", work, force) else None
