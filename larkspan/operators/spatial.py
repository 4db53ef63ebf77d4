"""Lattice joins and surface operators: nearest roads and towers, support masks, score windows, tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.geo import segment_nearest


# --- grids --------------------------------------------------------------------------------------
def make_grid(points: DataFrame, cell: float = 150.0, pad: float = 0.0) -> DataFrame:
    """Cell centres ``row, col, x, y`` from the least coordinates on, south to north, until the far edges are covered."""
    if cell <= 0:
        raise ValueError("cells need a size")
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    b = b.where("x0 is not null").select((F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), F.ceil((F.col("x1") + pad + cell - (F.col("x0") - pad)) / cell).alias("cols"), F.ceil((F.col("y1") + pad + cell - (F.col("y0") - pad)) / cell).alias("rows"))
    rows = b.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    return cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (F.col("x0") + F.col("col") * cell).alias("x"), (F.col("y0") + F.col("row") * cell).alias("y"))


def _neighbours(kx: str, ky: str, reach: int = 1):
    """The lattice cell of a row and those around it."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((F.col(kx) + i).alias("kx"), (F.col(ky) + j).alias("ky")))))


def support_mask(grid: DataFrame, points: DataFrame, radius: float | None) -> DataFrame:
    """``grid`` with ``supported``: whether a point is within ``radius``, inclusive. Without a radius all cells are.

    Points go to the nine lattice cells around theirs, one row for each lattice cell and position; a semi-join on lattice cells
    then looks at distances.
    """
    if radius is None:
        return grid.withColumn("supported", F.lit(True))
    if radius <= 0:
        return grid.withColumn("supported", F.lit(False))
    own = grid.withColumns({"__kx": F.floor(F.col("x") / radius), "__ky": F.floor(F.col("y") / radius)})
    near = points.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct().withColumns({"kx": F.floor(F.col("px") / radius), "ky": F.floor(F.col("py") / radius)})
    near = near.withColumn("c", F.explode(_neighbours("kx", "ky"))).select("px", "py", F.col("c.kx").alias("__kx"), F.col("c.ky").alias("__ky"))
    close = F.sqrt((own["x"] - near["px"]) * (own["x"] - near["px"]) + (own["y"] - near["py"]) * (own["y"] - near["py"])) <= radius
    found = own.join(near, (own["__kx"] == near["__kx"]) & (own["__ky"] == near["__ky"]) & close, "left_semi").select("row", "col", F.lit(True).alias("__in"))
    return grid.join(found, ["row", "col"], "left").withColumn("supported", F.coalesce("__in", F.lit(False))).drop("__in")


# --- towers -------------------------------------------------------------------------------------
def estimate_towers(points: DataFrame, least: int = 20, value: str = "value") -> DataFrame:
    """Mean position of each labelled cell, weighted by received power, in order of the label."""
    w = F.pow(F.lit(10.0), F.col(value) / 10.0)
    rows = points.where("cell is not null and cell <> ''").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(F.col("x") * w).alias("wx"), F.sum(F.col("y") * w).alias("wy"))
    return rows.where((F.col("n") >= least) & (F.col("w") > 0)).select("cell", (F.col("wx") / F.col("w")).alias("x"), (F.col("wy") / F.col("w")).alias("y"), "n").orderBy("cell")


def nearest_tower(points: DataFrame, towers: DataFrame, least_m: float = 30.0) -> DataFrame:
    """``points`` with ``tower_m``: distance to the nearest tower, at least ``least_m``.

    Towers are one row for a radio cell; they become one array, of which each point takes the least distance, so
    that no row of a product is made.
    """
    listed = towers.agg(F.collect_list(F.struct("x", "y")).alias("__t"))
    d = F.array_min(F.transform("__t", lambda t: F.sqrt((F.col("x") - t["x"]) * (F.col("x") - t["x"]) + (F.col("y") - t["y"]) * (F.col("y") - t["y"]))))
    return points.crossJoin(F.broadcast(listed)).withColumn("tower_m", F.greatest(d, F.lit(float(least_m)))).drop("__t")


def trend(points: DataFrame) -> DataFrame:
    """One row: intercept and slope of the value on log10 of the tower distance."""
    d = F.log10("tower_m")
    return points.agg(F.regr_intercept("value", d).alias("intercept"), F.regr_slope("value", d).alias("slope"))


# --- surfaces -----------------------------------------------------------------------------------
def with_stddev(surface: DataFrame) -> DataFrame:
    """``surface`` with ``stddev``, null where the variance is."""
    return surface.withColumn("stddev", F.when(F.col("variance").isNotNull(), F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))))


def surface_stats(surface: DataFrame) -> DataFrame:
    """Least, greatest and mean of mean and stddev over predicted cells, and their number."""
    return surface.agg(*(f(c).alias(f"{c}_{n}") for c in ("mean", "stddev") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))), F.count("mean").alias("n_predicted"))


def candidate_cells(surface: DataFrame, quantile: float = 0.70) -> DataFrame:
    """Predicted cells whose stddev is at or above a quantile of all predicted ones."""
    if not 0 <= quantile < 1:
        raise ValueError("the quantile is in [0, 1)")
    known = surface.where("stddev is not null")
    return known.crossJoin(F.broadcast(known.agg(F.percentile("stddev", F.lit(quantile)).alias("__q")))).where("stddev >= __q").drop("__q")


def expected_reduction(candidates: DataFrame, surface: DataFrame, range_m: float, cell: float) -> DataFrame:
    """``candidates`` with ``score``: variance within ``range_m``, weighted by ``exp(-3 d / range)``.

    An equi-join on lattice cells as large as the range: a candidate meets nine of them.
    """
    size = max(range_m, cell)
    at = candidates.withColumns({"__kx": F.floor(F.col("x") / size), "__ky": F.floor(F.col("y") / size)}).withColumn("__c", F.explode(_neighbours("__kx", "__ky")))
    cells = surface.where("stddev is not null").select(F.col("x").alias("__x"), F.col("y").alias("__y"), (F.col("stddev") * F.col("stddev")).alias("__v"), F.floor(F.col("x") / size).alias("__sx"), F.floor(F.col("y") / size).alias("__sy"))
    d = F.sqrt((F.col("x") - F.col("__x")) * (F.col("x") - F.col("__x")) + (F.col("y") - F.col("__y")) * (F.col("y") - F.col("__y")))
    joined = at.join(cells, (F.col("__c.kx") == F.col("__sx")) & (F.col("__c.ky") == F.col("__sy")) & (d <= range_m))
    scores = joined.groupBy("row", "col").agg(F.sum(F.exp(-3.0 * d / range_m) * F.col("__v")).alias("score"))
    return candidates.join(scores, ["row", "col"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def sample_nearest(points: DataFrame, surface: DataFrame, x0: float, y0: float, rows: int, cols: int, cell: float, value: str = "stddev") -> DataFrame:
    """``points`` with the value of the nearest cell; indices round half to even and stay within the grid."""
    r = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.rint((F.col("y") - y0) / cell).cast("int")))
    c = F.least(F.lit(cols - 1), F.greatest(F.lit(0), F.rint((F.col("x") - x0) / cell).cast("int")))
    at = surface.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias(f"at_{value}"))
    return points.join(at, (r == F.col("__r")) & (c == F.col("__c")), "left").drop("__r", "__c")


# --- roads --------------------------------------------------------------------------------------
def road_segments(roads: DataFrame) -> DataFrame:
    """``road_idx, seg_idx, name, x1, y1, x2, y2`` of lines given as arrays of points."""
    pairs = F.transform(F.slice("line", F.lit(1), F.size("line") - 1), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get("line", i + 1)["x"].alias("x2"), F.get("line", i + 1)["y"].alias("y2")))
    return roads.where(F.size("line") >= 2).select("road_idx", "name", F.posexplode(pairs).alias("seg_idx", "s")).select("road_idx", "seg_idx", "name", "s.*")


def nearest_road(points: DataFrame, segments: DataFrame, most_m: float = 250.0, key: str = "id") -> DataFrame:
    """``points`` that have a road within ``most_m``, with the point of it that is nearest, its distance and name.

    Segments are listed in the lattice cells that their box, grown by ``most_m``, meets. Of equally near roads the first counts.
    """
    size = max(4 * most_m, 1.0)
    low, high = (lambda a, b: F.floor((F.least(a, b) - most_m) / size)), (lambda a, b: F.floor((F.greatest(a, b) + most_m) / size))
    listed = segments.withColumn("__kx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2")))).withColumn("__ky", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))))
    own = points.withColumns({"__px": F.floor(F.col("x") / size), "__py": F.floor(F.col("y") / size)})
    x, y, d = segment_nearest(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    joined = own.join(listed, (F.col("__px") == F.col("__kx")) & (F.col("__py") == F.col("__ky"))).withColumn("__d", d).where(F.col("__d") <= most_m)
    best = joined.groupBy(key).agg(F.min(F.struct("__d", "road_idx", "seg_idx", x.alias("rx"), y.alias("ry"), "name")).alias("r"))
    return points.join(best, key).select(*points.columns, F.col("r.rx").alias("road_x"), F.col("r.ry").alias("road_y"), F.col("r.__d").alias("road_m"), F.col("r.name").alias("road_name"), F.col("r.road_idx").alias("road_idx"))


METRES_PER_DEGREE = 111_320.0


def road_tiles(points: DataFrame, buffer_m: float, tile_deg: float = 0.05, most: int | None = 96) -> DataFrame:
    """Tiles ``kx, ky`` that points with a buffer meet, in the order in which points (by ``pos``) first claim them; the first
    ``most``, with the number wanted in all."""
    dlat = buffer_m / METRES_PER_DEGREE
    dlon = F.lit(buffer_m) / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    span = lambda c, d: F.sequence(F.floor((c - d) / tile_deg), F.floor((c + d) / tile_deg))
    rows = points.withColumn("kx", F.explode(span(F.col("lon"), dlon))).withColumn("ky", F.explode(span(F.col("lat"), F.lit(dlat))))
    tiles = rows.groupBy("kx", "ky").agg(F.min("pos").alias("pos"))
    n = tiles.agg(F.count(F.lit(1)).alias("wanted"))
    # tiles are few: their number is bounded by the area, not by the points
    ranked = tiles.crossJoin(F.broadcast(n)).withColumn("tile", F.row_number().over(Window.orderBy("pos", "kx", "ky")))
    out = ranked if most is None else ranked.where(F.col("tile") <= most)
    return out.select("tile", "kx", "ky", (F.col("kx") * tile_deg).alias("lon0"), (F.col("ky") * tile_deg).alias("lat0"), ((F.col("kx") + 1) * tile_deg).alias("lon1"), ((F.col("ky") + 1) * tile_deg).alias("lat1"), "wanted")


def union_tiles(tiles: DataFrame) -> DataFrame:
    """Roads of all tiles (``tile, road_idx, line, name``), of equal lines the first; numbered anew in that order."""
    first = tiles.groupBy(F.to_json("line").alias("__k")).agg(F.min(F.struct("tile", "road_idx", "line", "name")).alias("r")).select("r.*")
    return first.withColumn("road_idx", (F.row_number().over(Window.orderBy("tile", "road_idx")) - 1).cast("long")).select("road_idx", "line", "name")


def box_of_grid(x0: float, y0: float, x1: float, y1: float, epsg: int) -> tuple[float, float, float, float]:
    """Longitudes and latitudes that hold the four corners of a projected box."""
    import numpy as np

    from larkspan.functions.geo import utm_inverse_np

    lon, lat = utm_inverse_np(np.array([x0, x0, x1, x1]), np.array([y0, y1, y0, y1]), epsg)
    return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())


def inside_bounds(outer: tuple[float, ...], inner: tuple[float, ...]) -> bool:
    """Whether a box holds another; also used for the extent stamp of loaded claims."""
    return all(math.isfinite(v) for v in (*outer, *inner)) and outer[0] <= inner[0] and outer[1] <= inner[1] and outer[2] >= inner[2] and outer[3] >= inner[3]
