"""Geometry as Column expressions: transverse Mercator projection, rings, segments, lattices."""

from __future__ import annotations

import math
from fractions import Fraction as Q

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 ellipsoid and UTM, and the series of Krueger to the sixth power of the third flattening.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_FORWARD = [
    [Q(1, 2), Q(-2, 3), Q(5, 16), Q(41, 180), Q(-127, 288), Q(7891, 37800)],
    [0, Q(13, 48), Q(-3, 5), Q(557, 1440), Q(281, 630), Q(-1983433, 1935360)],
    [0, 0, Q(61, 240), Q(-103, 140), Q(15061, 26880), Q(167603, 181440)],
    [0, 0, 0, Q(49561, 161280), Q(-179, 168), Q(6601661, 7257600)],
    [0, 0, 0, 0, Q(34729, 80640), Q(-3418889, 1995840)],
    [0, 0, 0, 0, 0, Q(212378941, 319334400)],
]
_INVERSE = [
    [Q(1, 2), Q(-2, 3), Q(37, 96), Q(-1, 360), Q(-81, 512), Q(96199, 604800)],
    [0, Q(1, 48), Q(1, 15), Q(-437, 1440), Q(46, 105), Q(-1118711, 3870720)],
    [0, 0, Q(17, 480), Q(-37, 840), Q(-209, 4480), Q(5569, 90720)],
    [0, 0, 0, Q(4397, 161280), Q(-11, 504), Q(-830251, 7257600)],
    [0, 0, 0, 0, Q(4583, 161280), Q(-108847, 3991680)],
    [0, 0, 0, 0, 0, Q(20648693, 638668800)],
]
_LATITUDE = [
    [2, Q(-2, 3), -2, Q(116, 45), Q(26, 45), Q(-2854, 675)],
    [0, Q(7, 3), Q(-8, 5), Q(-227, 45), Q(2704, 315), Q(2323, 945)],
    [0, 0, Q(56, 15), Q(-136, 35), Q(-1262, 105), Q(73814, 2835)],
    [0, 0, 0, Q(4279, 630), Q(-332, 35), Q(-399572, 14175)],
    [0, 0, 0, 0, Q(4174, 315), Q(-144838, 6237)],
    [0, 0, 0, 0, 0, Q(601676, 22275)],
]
N3 = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64 + N3**6 / 256)
ECCENTRIC = 2 * math.sqrt(N3) / (1 + N3)


def series(table: list[list]) -> list[float]:
    return [sum(float(c) * N3 ** (k + 1) for k, c in enumerate(row)) for row in table]


ALPHA, BETA, DELTA = series(_FORWARD), series(_INVERSE), series(_LATITUDE)


def utm_epsg(lon: float, lat: float, clamp: bool = True) -> int:
    """Code of the zone of a position; unclamped, longitude 180 is in a zone 61."""
    zone = int(math.floor((lon + 180) / 6)) + 1
    if clamp:
        zone = min(60, max(1, zone))
    return (32600 if lat >= 0 else 32700) + zone


def utm_epsg_column(lon: Column, lat: Column) -> Column:
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))
    return F.when(lat >= 0, 32600).otherwise(32700) + zone


def _central(epsg: int) -> tuple[float, float]:
    zone = epsg % 100
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is no UTM zone on WGS 84")
    return zone * 6 - 183.0, FALSE_NORTHING if epsg // 100 == 327 else 0.0


def utm_forward(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing."""
    middle, north = _central(epsg)
    lam, sin = F.radians(lon - middle), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - ECCENTRIC * F.atanh(ECCENTRIC * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * RADIUS * x, north + SCALE * RADIUS * y


def utm_inverse(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude."""
    middle, north = _central(epsg)
    xi, eta = (y - north) / (SCALE * RADIUS), (x - FALSE_EASTING) / (SCALE * RADIUS)
    u, v = xi, eta
    for j, b in enumerate(BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return middle + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def utm_forward_np(lon, lat, epsg: int):
    """As :func:`utm_forward`, on arrays."""
    import numpy as np

    middle, north = _central(epsg)
    lam, sin = np.radians(np.asarray(lon, float) - middle), np.sin(np.radians(np.asarray(lat, float)))
    t = np.sinh(np.arctanh(sin) - ECCENTRIC * np.arctanh(ECCENTRIC * sin))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return FALSE_EASTING + SCALE * RADIUS * x, north + SCALE * RADIUS * y


def utm_inverse_np(x, y, epsg: int):
    import numpy as np

    middle, north = _central(epsg)
    xi, eta = (np.asarray(y, float) - north) / (SCALE * RADIUS), (np.asarray(x, float) - FALSE_EASTING) / (SCALE * RADIUS)
    u = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    v = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    chi = np.arcsin(np.sin(u) / np.cosh(v))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    return middle + np.degrees(np.arctan2(np.sinh(v), np.cos(u))), np.degrees(lat)


# --- rings --------------------------------------------------------------------------------------
def _edges(ring: Column) -> Column:
    """Each vertex with the next, the last with the first."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(ring, (i + 1) % n)["x"].alias("bx"), F.get(ring, (i + 1) % n)["y"].alias("by")))


def ring_position(x: Column, y: Column, ring: Column) -> Column:
    """2 inside, 1 on the boundary, 0 outside; for any simple polygon given as an array of vertices."""
    edges = _edges(ring)

    def on(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return (cross == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crosses(e: Column) -> Column:
        return ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])

    return F.when(F.exists(edges, on), 1).when(F.size(F.filter(edges, crosses)) % 2 == 1, 2).otherwise(0)


def with_bounds(df, ring: str = "ring"):
    """``df`` with the ring's bounding box as ``x0``, ``y0``, ``x1``, ``y1``."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return df.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})


def overlaps(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a bounding box meets another; touching counts."""
    return (x1 >= box[0]) & (x0 <= box[2]) & (y1 >= box[1]) & (y0 <= box[3])


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Lattice cells (array of structs kx, ky) that a box meets."""
    xs, ys = (F.sequence(F.floor(a / size), F.floor(b / size)) for a, b in ((x0, x1), (y0, y1)))
    return F.flatten(F.transform(xs, lambda kx: F.transform(ys, lambda ky: F.struct(kx.alias("kx"), ky.alias("ky")))))


def segment_nearest(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Point of a segment nearest to (px, py), and its distance."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    x, y = ax + t * dx, ay + t * dy
    return x, y, F.sqrt((px - x) * (px - x) + (py - y) * (py - y))
