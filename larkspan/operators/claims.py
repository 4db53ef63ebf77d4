"""Claimed coverage against measurements: point-in-hex joins under three containment rules, gaps, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.geo import cells_of_box, overlaps, ring_position
from larkspan.functions.scalar import round_decimal, share

#: Lattice of the join, in the units of the coordinates; about the size of a hex.
CELL = 0.01
#: Margins around measurements within which claims are loaded, for the audit and for its check.
AUDIT_MARGIN, CHECK_MARGIN = 0.01, 0.02


def bounds_of(points: DataFrame, margin: float = AUDIT_MARGIN) -> tuple[float, float, float, float] | None:
    """Bounding box of the points with a margin; None without points. Four numbers to the driver."""
    x0, y0, x1, y1 = points.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    return None if x0 is None else (x0 - margin, y0 - margin, x1 + margin, y1 + margin)


def claims_near(claims: DataFrame, environment: int | None = 1, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Claims of an environment whose bounding box meets ``box``."""
    if environment is not None:
        claims = claims.where(F.col("environmnt") == environment)
    return claims if box is None else claims.where(overlaps(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), box))


def hits(points: DataFrame, claims: DataFrame, boundary: bool, how: str = "inner", cell: float = CELL) -> DataFrame:
    """Points with each claim they are in, or also on the boundary of.

    An equi-join on lattice cells: each claim is listed in the cells its box meets, each point in its own, and the ring is
    only looked at within the box. The planner broadcasts the claims where they are small; skewed cells are split by
    adaptive execution.
    """
    listed = claims.withColumn("__cell", F.explode(cells_of_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell))).select("hex_ord", "h3_res9_id", "minsignal", "ring", "x0", "y0", "x1", "y1", F.col("__cell.kx").alias("__cx"), F.col("__cell.ky").alias("__cy"))
    own = points.withColumns({"__kx": F.floor(F.col("lon") / cell), "__ky": F.floor(F.col("lat") / cell)})
    near = (F.col("__kx") == F.col("__cx")) & (F.col("__ky") == F.col("__cy")) & F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    inside = ring_position(F.col("lon"), F.col("lat"), F.col("ring")) >= (1 if boundary else 2)
    return own.join(listed, near & inside, how).drop("__kx", "__ky", "__cx", "__cy", "x0", "y0", "x1", "y1", "ring")


def evaluate(points: DataFrame, claims: DataFrame) -> DataFrame:
    """The audit: ``id, lon, lat, rsrp, h3, claimed, gap, inside, violation`` for every point.

    A boundary counts as inside; of several claims the one first in the filing's order counts.
    """
    joined = hits(points.select("id", "lon", "lat", "rsrp"), claims, boundary=True, how="left")
    one = joined.groupBy("id", "lon", "lat", "rsrp").agg(F.min_by(F.struct("h3_res9_id", "minsignal"), "hex_ord").alias("hit"))
    gap = F.col("rsrp") - F.col("hit.minsignal")
    inside = F.col("hit").isNotNull()
    return one.select("id", "lon", "lat", "rsrp", F.col("hit.h3_res9_id").alias("h3"), F.col("hit.minsignal").alias("claimed"), F.when(inside, gap).alias("gap"), inside.alias("inside"), F.coalesce(inside & (gap < 0), F.lit(False)).alias("violation"))


def strict_matches(points: DataFrame, claims: DataFrame) -> DataFrame:
    """The check of the audit: one row for each point strictly inside a claim, the highest claimed level first."""
    joined = hits(points.select("id", "lon", "lat", "rsrp"), claims, boundary=False)
    best = joined.groupBy("id", "lon", "lat", "rsrp").agg(F.max(F.struct("minsignal", (-F.col("hex_ord")).alias("o"), "h3_res9_id")).alias("hit"))
    return best.select("id", "lon", "lat", "rsrp", F.col("hit.h3_res9_id").alias("h3"), F.col("hit.minsignal").alias("claimed"), (F.col("rsrp") - F.col("hit.minsignal")).alias("gap"))


def boundary_only(points: DataFrame, claims: DataFrame) -> DataFrame:
    """Points on a claim's boundary that are inside none."""
    touching = hits(points, claims, boundary=True).select(*points.columns).dropDuplicates(["id"])
    return touching.join(hits(points, claims, boundary=False).select("id"), "id", "left_anti")


def summary(audit: DataFrame) -> DataFrame:
    """One row over :func:`evaluate`; the worst point is the first of the smallest gap in order of id."""
    inside, bad = F.col("inside"), F.col("violation")
    worst = F.min(F.when(bad, F.struct("gap", "id", "lon", "lat", "rsrp", "claimed")))
    return audit.agg(F.count(F.lit(1)).alias("total"), F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"), F.count_if(bad).alias("violations"), F.avg(F.when(bad, F.col("gap"))).alias("a"), worst.alias("w")).select(
        "total", "n_inside", "n_outside", "violations", share(F.col("violations"), F.col("n_inside")).alias("share_of_inside"), F.bround("a", 2).alias("avg_gap"), F.col("w.gap").alias("worst_gap"), F.col("w.id").alias("worst_id")
    )


def by_tier(audit: DataFrame) -> DataFrame:
    """Points, violations and average level by claimed level."""
    rows = audit.where("inside").groupBy("claimed").agg(F.count(F.lit(1)).alias("points"), F.count_if("violation").alias("violations"), F.bround(F.avg("rsrp"), 1).alias("avg_measured"))
    return rows.orderBy("claimed")


def check_summary(points: DataFrame, claims: DataFrame) -> DataFrame:
    """The same figures from strict containment, with shares of all and the points on boundaries alone."""
    found = strict_matches(points, claims)
    bad = F.col("gap") < 0
    one = found.agg(F.count(F.lit(1)).alias("n_inside"), F.count_if(bad).alias("violations"), round_decimal(F.avg(F.when(bad, F.col("gap"))), 2).alias("avg_gap"), F.min(F.when(bad, F.col("gap"))).alias("worst_gap"))
    total = points.agg(F.count(F.lit(1)).alias("total"))
    edge = boundary_only(points, claims).agg(F.count(F.lit(1)).alias("boundary_only_points"))
    rows = total.crossJoin(one).crossJoin(edge)
    return rows.select("total", "n_inside", "violations", share(F.col("violations"), F.col("n_inside")).alias("share_of_inside"), share(F.col("violations"), F.col("total")).alias("share_of_all"), "avg_gap", "worst_gap", "boundary_only_points")


def check_by_tier(points: DataFrame, claims: DataFrame) -> DataFrame:
    rows = strict_matches(points, claims).groupBy("claimed").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("gap") < 0).alias("violations"), round_decimal(F.avg("rsrp"), 1).alias("avg_measured"))
    return rows.orderBy("claimed")


def violations(audit: DataFrame) -> DataFrame:
    """Violating points, the worst first."""
    return audit.where("violation").orderBy("gap", "id")


def per_hex(points: DataFrame, claims: DataFrame) -> DataFrame:
    """Figures of every hex with points strictly inside; a point in two hexes counts in both."""
    found = hits(points.select("id", "lon", "lat", "rsrp"), claims, boundary=False).withColumn("gap", F.col("rsrp") - F.col("minsignal"))
    bad = F.col("gap") < 0
    rows = found.groupBy("h3_res9_id").agg(
        F.min_by("minsignal", F.struct("hex_ord", "id")).alias("claimed"),
        F.count(F.lit(1)).alias("n_measurements"),
        F.bround(F.avg("rsrp"), 1).alias("mean_rsrp"),
        F.min("rsrp").alias("min_rsrp"),
        F.count_if(bad).alias("n_violations"),
        F.bround(F.avg(F.when(bad, F.col("gap"))), 2).alias("mean_gap"),
        F.min(F.when(bad, F.col("gap"))).alias("worst_gap"),
    )
    return rows.withColumn("violation_share", share(F.col("n_violations"), F.col("n_measurements")))


def published(hexes: DataFrame, least: int = 3) -> DataFrame:
    """Hexes with a violation and enough measurements to publish, the worst first."""
    return hexes.where((F.col("n_violations") >= 1) & (F.col("n_measurements") >= least)).orderBy("worst_gap", "h3_res9_id")


def reconcile(hexes: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: points and violations by hex and by audit, and whether they agree; to be looked at before the floor."""
    a = hexes.agg(F.coalesce(F.sum("n_measurements"), F.lit(0)).alias("hex_points"), F.coalesce(F.sum("n_violations"), F.lit(0)).alias("hex_violations"))
    b = audit.agg(F.count_if("inside").alias("audit_points"), F.count_if("violation").alias("audit_violations"))
    return a.crossJoin(b).withColumn("agrees", (F.col("hex_points") == F.col("audit_points")) & (F.col("hex_violations") == F.col("audit_violations")))


def require_reconciled(hexes: DataFrame, audit: DataFrame) -> None:
    r = reconcile(hexes, audit).first()
    if not r["agrees"]:
        raise ValueError(f"hexes have {r['hex_points']} points and {r['hex_violations']} violations, the audit {r['audit_points']} and {r['audit_violations']}")


def map_frame(hexes: DataFrame, central: float = 0.95, pad: float = 900.0) -> DataFrame:
    """One row: the box of the central share of hex centres (x, y) with a pad."""
    low, high = (1 - central) / 2, (1 + central) / 2
    return hexes.agg(*((F.percentile(c, F.lit(q)) + s * pad).alias(f"{c}{n}") for c in ("x", "y") for n, q, s in ((0, low, -1), (1, high, 1))))


def gap_column(rsrp: Column, claimed: Column) -> Column:
    return rsrp - claimed
