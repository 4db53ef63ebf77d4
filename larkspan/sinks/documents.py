"""GeoJSON, GPX and JSON reports. Figures without a value are null, never NaN."""

from __future__ import annotations

import json
import math
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(lon: Column, lat: Column, properties: Column) -> Column:
    """A point feature as JSON text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def violation_features(violations: DataFrame) -> DataFrame:
    """``gap, id, feature`` of violating points, to be written in order of the first two."""
    p = F.struct("id", F.col("h3").alias("h3_res9_id"), F.col("claimed").alias("claimed_dbm"), F.col("rsrp").alias("measured_dbm"), F.col("gap").alias("gap_db"))
    return violations.select("gap", "id", feature(F.col("lon"), F.col("lat"), p).alias("feature")).orderBy("gap", "id")


def hex_features(hexes: DataFrame) -> DataFrame:
    """``worst_gap, h3_res9_id, feature`` of published hexes with a ``ring``; six decimals of coordinates."""
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(*(c for c in hexes.columns if c != "ring"))
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})
    return hexes.select("worst_gap", "h3_res9_id", body.alias("feature")).orderBy("worst_gap", "h3_res9_id")


def suggestion_features(suggestions: DataFrame, metric: str = "rsrp") -> DataFrame:
    """``rank, feature`` of suggested targets."""
    p = F.struct("rank", "visit_order", F.bround("stddev", 3).alias("stddev"), F.bround("score", 3).alias("score"), "road_name", F.bround("road_m", 1).alias("road_distance_m"), F.lit(metric).alias("metric"), F.lit(unit(metric)).alias("unit"))
    return suggestions.select("rank", feature(F.col("lon"), F.col("lat"), p).alias("feature")).orderBy("rank")


def unit(metric: str) -> str:
    return "dBm" if metric in ("rsrp", "rsrq") else metric


def write_collection(features: DataFrame, path: str, **header) -> None:
    """One document; rows come to the driver one partition at a time."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as f:
        f.write(json.dumps(clean({"type": "FeatureCollection"} | header))[:-1] + ', "features": [')
        for i, row in enumerate(features.select("feature").toLocalIterator()):
            f.write((",\n" if i else "\n") + row[0])
        f.write("\n]}\n")


def clean(value):
    """Nested values with numbers that JSON lacks as None."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.item() if hasattr(value, "item") else value


def write_report(path: str, report: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(clean(report), indent=2, allow_nan=False, default=str) + "\n")


def read_report(path: str) -> dict | None:
    """A report or a state; None if it is missing or no JSON object."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def range_of_report(path: str) -> float | None:
    return ((read_report(path) or {}).get("variogram") or {}).get("range_m") or None


def gpx(suggestions: list[dict], metric: str = "rsrp") -> str:
    """Way points and a route through them in order of visit, or of rank where there is none."""
    order = sorted(suggestions, key=lambda s: s.get("visit_order") or s["rank"])
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gpx version="1.1" creator="larkspan" xmlns="http://www.topografix.com/GPX/1/1">']
    for tag, close in (("wpt", ""), ("rtept", "</rte>")):
        if tag == "rtept":
            out.append(f"<rte><name>{escape(metric)} targets</name>")
        for k, s in enumerate(order, 1):
            name = f"T{k} {s.get('road_name') or ''}".strip()
            out.append(f"<{tag} lat={quoteattr(format(s['lat'], '.6f'))} lon={quoteattr(format(s['lon'], '.6f'))}><name>{escape(name)}</name></{tag}>")
        out.append(close)
    return "\n".join([*(x for x in out if x), "</gpx>"]) + "\n"


def write_gpx(path: str, suggestions: list[dict], metric: str = "rsrp") -> bool:
    """False, and no file, if there is nothing to visit."""
    if not suggestions:
        return False
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(gpx(suggestions, metric))
    return True
