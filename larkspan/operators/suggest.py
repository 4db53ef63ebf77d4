"""Where to measure next: drivable targets by expected gain, apart from each other, in an order to drive them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.geo import utm_inverse
from larkspan.functions.scalar import weakness_weight
from larkspan.operators.spatial import candidate_cells, expected_reduction, nearest_road, sample_nearest

_FIELDS = "rank int, row int, col int, x double, y double, lon double, lat double, stddev double, road_name string, road_m double, score double, visit_order int"


def scored_candidates(surface: DataFrame, segments: DataFrame, cell: float, quantile: float = 0.70, most_road_m: float = 250.0, range_m: float | None = None, weak_bias: float = 0.5) -> DataFrame:
    """Candidate cells with a road near them: ``x, y`` on the road, the deviation there, and the score of going there.

    With a range the score is the expected reduction of variance, else the deviation; weak levels weigh more.
    """
    edge = surface.agg(F.min("x"), F.min("y"), F.max("row"), F.max("col")).first()
    if edge[0] is None:
        return surface.sparkSession.createDataFrame([], "row int, col int, x double, y double, stddev double, road_name string, road_m double, score double")
    cells = candidate_cells(surface, quantile).withColumn("id", F.col("row").cast("long") * (edge[3] + 1) + F.col("col"))
    on = nearest_road(cells, segments, most_road_m).withColumns({"x": F.col("road_x"), "y": F.col("road_y")})
    on = sample_nearest(on, surface, edge[0], edge[1], edge[2] + 1, edge[3] + 1, cell).where("at_stddev is not null")
    scored = expected_reduction(on, surface, range_m, cell) if range_m else on.withColumn("score", F.col("at_stddev"))
    if "mean" in surface.columns:
        scored = scored.withColumn("score", F.col("score") * F.coalesce(weakness_weight(F.col("mean"), weak_bias), F.lit(1.0)))
    return scored.select("row", "col", "x", "y", F.col("at_stddev").alias("stddev"), "road_name", "road_m", "score")


def choose(candidates: DataFrame, top_n: int = 10, apart_m: float = 1200.0, range_m: float | None = None) -> list[dict]:
    """Greedy picks: the best remaining score at a distance from all before; with a range, what a pick covers counts less
    after it. The score of a pick is the one before any discount. Ties go to the first row and column.

    Each step is an aggregation of the scored candidates that returns one row.
    """
    chosen: list[dict] = []
    now = candidates.where("score > 0").withColumn("left", F.col("score"))
    for _ in range(top_n):
        best = now.orderBy(F.desc("left"), "row", "col").limit(1).collect()
        if not best or best[0]["left"] <= 0:
            break
        p = best[0].asDict()
        p.pop("left")
        chosen.append(p)
        d = F.sqrt((F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"]))
        now = now.where(d >= apart_m)
        if range_m:
            now = now.withColumn("left", F.col("left") * (1 - F.exp(-3.0 * d / range_m)))
    return chosen


def order_route(xs: list[float], ys: list[float], start: int = 0) -> list[int]:
    """An open tour from ``start``: the nearest unvisited next, then reversals of stretches as long as one shortens it."""
    n = len(xs)
    d = lambda a, b: math.hypot(xs[a] - xs[b], ys[a] - ys[b])
    tour, rest = [start] if n else [], [i for i in range(n) if i != start]
    while rest:
        k = min(rest, key=lambda i: (d(tour[-1], i), i))
        rest.remove(k)
        tour.append(k)
    better = True
    while better:
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                old = d(tour[i - 1], tour[i]) + (d(tour[j], tour[j + 1]) if j + 1 < n else 0)
                new = d(tour[i - 1], tour[j]) + (d(tour[i], tour[j + 1]) if j + 1 < n else 0)
                if new < old - 1e-9:
                    tour[i : j + 1] = tour[i : j + 1][::-1]
                    better = True
    return tour


def suggestions(candidates: DataFrame, epsg: int, top_n: int = 10, apart_m: float = 1200.0, range_m: float | None = None) -> DataFrame:
    """Ranked targets with position, road and visiting order."""
    picks = choose(candidates, top_n, apart_m, range_m)
    tour = order_route([p["x"] for p in picks], [p["y"] for p in picks])
    place = {k: i + 1 for i, k in enumerate(tour)}
    rows = [(i + 1, p["row"], p["col"], p["x"], p["y"], None, None, p["stddev"], p["road_name"], p["road_m"], p["score"], place[i]) for i, p in enumerate(picks)]
    df = candidates.sparkSession.createDataFrame(rows, _FIELDS)
    lon, lat = utm_inverse(F.col("x"), F.col("y"), epsg)
    return df.withColumns({"lon": lon, "lat": lat})


def ranked(rows: DataFrame, by: list, name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in an order."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*by)))
