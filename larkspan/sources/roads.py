"""Roads from cached GeoJSON: by bounding box or by tile, with a pluggable fetch for what is not cached."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.scalar import road_name
from larkspan.operators.spatial import inside_bounds

Box = tuple[float, float, float, float]
SCHEMA = "road_idx long, line array<struct<x: double, y: double>>, name string"
# Messages by which a provider says that a tile has no roads.
EMPTY_MESSAGES = ("Found no graph nodes within the requested polygon.", "Graph contains no edges.", "Graph contains no nodes.")


class NoRoads(Exception):
    """What a fetch raises for a box without roads."""


#: Public interpreter of OpenStreetMap queries, and classes of ways by network.
OVERPASS = "https://overpass-api.de/api/interpreter"
DRIVABLE = "motorway|trunk|primary|secondary|tertiary|unclassified|residential|living_street|road"
NETWORKS = {"drive": f"^({DRIVABLE})(_link)?$", "drive_service": f"^({DRIVABLE}|service)(_link)?$", "all": "."}


def overpass(network: str = "drive", url: str = OVERPASS, timeout: float = 180.0, ask: Callable[[str], bytes] | None = None) -> Callable[[Box], list]:
    """A fetch of ways by their class; ``ask`` sends a query and returns the answer's bytes."""
    if network not in NETWORKS:
        raise ValueError(f"unknown network {network!r}; one of {', '.join(NETWORKS)}")

    def post(query: str) -> bytes:
        with urllib.request.urlopen(url, urllib.parse.urlencode({"data": query}).encode(), timeout=timeout) as answer:
            return answer.read()

    def fetch(box: Box) -> list[tuple[list[tuple[float, float]], str | None]]:
        west, south, east, north = box
        found = json.loads((ask or post)(f'[out:json][timeout:{timeout:.0f}];way["highway"~"{NETWORKS[network]}"]({south},{west},{north},{east});out geom;'))
        lines = [([(p["lon"], p["lat"]) for p in e["geometry"]], e.get("tags", {}).get("name")) for e in found.get("elements", []) if e.get("type") == "way" and len(e.get("geometry", ())) > 1]
        if not lines:
            raise NoRoads(f"no roads in {box}")
        return lines

    return fetch


def cache_file(cache: str, box: Box) -> Path:
    return Path(cache) / ("roads_" + "_".join(f"{v:.4f}" for v in box) + ".geojson")


def write_cache(path: Path, lines: list[tuple[list[tuple[float, float]], str | None]]) -> None:
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "LineString", "coordinates": [list(p) for p in line]}} for line, n in lines]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``road_idx, line, name`` in longitudes and latitudes."""
    schema = "features array<struct<properties: struct<name: string>, geometry: struct<coordinates: array<array<double>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("i", "f"))
    line = F.transform("f.geometry.coordinates", lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return rows.select(F.col("i").cast("long").alias("road_idx"), line.alias("line"), road_name(F.col("f.properties.name")).alias("name"))


def is_empty_tile(error: BaseException) -> bool:
    """Whether an error says that there are no roads, and not that the fetch failed; near misses count as failures."""
    return isinstance(error, NoRoads) or any(t.__name__ == "InsufficientResponseError" for t in type(error).__mro__) or str(error).strip() in EMPTY_MESSAGES


def roads_of(spark: SparkSession, box: Box, cache: str, fetch: Callable[[Box], list] | None = None, refresh: bool = False) -> DataFrame:
    """Roads of a box, from the cache if it has them."""
    path = cache_file(cache, box)
    if refresh or not path.exists():
        if fetch is None:
            raise FileNotFoundError(f"{path} is not cached and no fetch is given")
        write_cache(path, fetch(box))
    return read_geojson(spark, str(path))


def roads_of_tiles(spark: SparkSession, boxes: list[Box], cache: str, fetch: Callable[[Box], list] | None = None, refresh: bool = False) -> DataFrame:
    """Roads of all tiles with their ``tile``; tiles without roads are cached as such, failures propagate uncached."""
    out = None
    for k, box in enumerate(boxes):
        try:
            rows = roads_of(spark, box, cache, fetch, refresh)
        except Exception as e:
            if not is_empty_tile(e):
                raise
            write_cache(cache_file(cache, box), [])
            continue
        rows = rows.withColumn("tile", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], SCHEMA + ", tile int") if out is None else out


def covering_cache(cache: str, box: Box) -> Path | None:
    """The first cached file whose box, by its name, holds another."""
    for p in sorted(Path(cache).glob("roads_*.geojson")):
        m = re.fullmatch(r"roads_(-?[\d.]+)_(-?[\d.]+)_(-?[\d.]+)_(-?[\d.]+)", p.stem)
        if m and inside_bounds(tuple(float(v) for v in m.groups()), box):
            return p
    return None
