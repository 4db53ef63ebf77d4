"""Operators on measurements: re-reads, statistics, loading for modelling, idempotent ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.geo import utm_epsg, utm_forward, utm_inverse
from larkspan.functions.scalar import round_decimal, share
from larkspan.schemas import METRICS

TRIPLE = ("rsrp", "rsrq", "sinr")


# --- re-reads -----------------------------------------------------------------------------------
def _reread(order: Window) -> Column:
    """Whether a row repeats the one before it in its session: the same known modem time, or the same three values, where
    null equals null."""
    modem = F.col("modem_reported_at")
    same_stamp = F.coalesce(modem == F.lag(modem).over(order), F.lit(False))
    same_values = F.lit(True)
    for m in TRIPLE:
        same_values = same_values & F.col(m).eqNullSafe(F.lag(m).over(order))
    return (F.row_number().over(order) > 1) & (same_stamp | same_values)


def with_rereads(readings: DataFrame) -> DataFrame:
    """``readings`` with boolean ``reread``. To be applied before any filter: neighbours are those of all rows."""
    return readings.withColumn("reread", _reread(Window.partitionBy("session_id").orderBy("recorded_at", "id")))


def run_starts(readings: DataFrame) -> DataFrame:
    """Rows that are not re-reads."""
    return with_rereads(readings).where(~F.col("reread")).drop("reread")


# --- statistics ---------------------------------------------------------------------------------
def totals(readings: DataFrame) -> DataFrame:
    """One row of counts, ranges and bounds over all rows; zeros and nulls if there are none."""
    return readings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(F.col("network_type") == "none").alias("dead_zones"),
        F.min("rsrp").alias("rsrp_min"),
        F.max("rsrp").alias("rsrp_max"),
        round_decimal(F.avg("rsrp"), 2).alias("rsrp_avg"),
        *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")),
        F.max("recorded_at").alias("last_recorded_at"),
    )


def per_session(readings: DataFrame) -> DataFrame:
    """Counts, times, levels and re-reads of each session."""
    return with_rereads(readings).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("recorded_at").alias("started_at"),
        F.max("recorded_at").alias("ended_at"),
        F.count_if(F.col("network_type") == "none").alias("dead_zones"),
        F.min("rsrp").alias("rsrp_min"),
        F.max("rsrp").alias("rsrp_max"),
        round_decimal(F.avg("rsrp"), 2).alias("rsrp_avg"),
        F.count_if("reread").alias("rereads"),
        F.count("modem_reported_at").alias("modem_rows"),
        F.count_distinct("modem_reported_at").alias("modem_distinct"),
    )


def rereads(readings: DataFrame) -> DataFrame:
    """One row: re-reads, independent rows, the share of re-reads (null without rows), rows with a modem time."""
    n = F.col("total")
    rows = with_rereads(readings).agg(F.count(F.lit(1)).alias("total"), F.count_if("reread").alias("rereads"), F.count("modem_reported_at").alias("with_modem_timestamp"))
    return rows.select("total", "rereads", (n - F.col("rereads")).alias("independent"), share(F.col("rereads"), n).alias("reread_share"), "with_modem_timestamp")


def fingerprint(readings: DataFrame) -> DataFrame:
    """Count and largest id, by which a change of the table is noticed."""
    return readings.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("max_id"))


def as_of(readings: DataFrame, moment) -> DataFrame:
    """Rows recorded strictly before a moment; all if it is None."""
    return readings if moment is None else readings.where(F.col("recorded_at") < F.lit(moment))


# --- loading for modelling ----------------------------------------------------------------------
def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: one of {', '.join(METRICS)}")
    return metric


def metric_rows(readings: DataFrame, metric: str = "rsrp", none_floor: float | None = None) -> DataFrame:
    """Rows with a value of the metric as ``value``; with a floor, dead zones count with it (only for rsrp)."""
    check_metric(metric)
    if none_floor is None or metric != "rsrp":
        return readings.where(F.col(metric).isNotNull()).withColumn("value", F.col(metric).cast("double"))
    known = F.col(metric).isNotNull() | (F.col("network_type") == "none")
    return readings.where(known).withColumn("value", F.coalesce(F.col(metric), F.lit(none_floor)).cast("double"))


def session_sizes(readings: DataFrame) -> DataFrame:
    return readings.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("recorded_at").alias("started_at"))


def large_sessions(rows: DataFrame, readings: DataFrame, least: int) -> DataFrame:
    """``rows`` of sessions with at least ``least`` rows among the raw ``readings``."""
    return rows.join(session_sizes(readings).where(F.col("n") >= least).select("session_id"), "session_id", "left_semi")


def excluded_sessions(readings: DataFrame, least: int) -> DataFrame:
    """Sessions below the floor, in order of their start."""
    return session_sizes(readings).where(F.col("n") < least).orderBy("started_at", "session_id").select("session_id", "n")


def modelling_rows(readings: DataFrame, metric: str = "rsrp", none_floor: float | None = None, dedupe_runs: bool = True, min_session_rows: int = 3) -> DataFrame:
    """``id, lon, lat, value, session, cell``: run starts are found over all rows, then value and session floors apply."""
    rows = metric_rows(run_starts(readings) if dedupe_runs else readings, metric, none_floor)
    if min_session_rows > 1:
        rows = large_sessions(rows, readings, min_session_rows)
    return rows.select("id", "lon", "lat", "value", F.col("session_id").cast("string").alias("session"), F.coalesce("cell_id", F.lit("")).alias("cell"))


def dedupe_counts(readings: DataFrame, metric: str = "rsrp", none_floor: float | None = None, min_session_rows: int = 3) -> DataFrame:
    """One row: rows with the metric before and after re-reads are left out."""
    before = modelling_rows(readings, metric, none_floor, False, min_session_rows).agg(F.count(F.lit(1)).alias("n_before_dedupe"))
    after = modelling_rows(readings, metric, none_floor, True, min_session_rows).agg(F.count(F.lit(1)).alias("n_raw"))
    return before.crossJoin(after).select("n_before_dedupe", "n_raw", (F.col("n_before_dedupe") - F.col("n_raw")).alias("n_dropped"))


def projected(rows: DataFrame, epsg: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with ``x`` and ``y`` in the zone of their mean position, and the zone's code."""
    if epsg is None:
        lon, lat = rows.agg(F.avg("lon"), F.avg("lat")).first()
        if lon is None:
            raise ValueError("no points")
        epsg = utm_epsg(lon, lat)
    x, y = utm_forward(F.col("lon"), F.col("lat"), epsg)
    return rows.withColumns({"x": x, "y": y}), epsg


def collapse_coincident(points: DataFrame, tolerance: float = 1.0, order: str = "id") -> DataFrame:
    """One point for those that round to the same multiple of ``tolerance``: means of position and value, labels of the first.

    ``pt_idx`` counts from 0: in the order given if nothing merged, else in order of the lattice.
    """
    keyed = points.withColumns({"kx": F.rint(F.col("x") / tolerance), "ky": F.rint(F.col("y") / tolerance)})
    merged = keyed.groupBy("kx", "ky").agg(
        *(F.avg(c).alias(c) for c in ("x", "y", "value")),
        *(F.min_by(c, order).alias(c) for c in ("session", "cell")),
        F.min(order).alias(order),
        F.count(F.lit(1)).alias("n_members"),
    )
    some = merged.agg(F.coalesce(F.max("n_members"), F.lit(1)).alias("most"))
    merged = merged.crossJoin(F.broadcast(some))
    changed = F.col("most") > 1
    rank = Window.orderBy(F.when(changed, F.col("kx")), F.when(changed, F.col("ky")), order)
    return merged.withColumn("pt_idx", F.row_number().over(rank) - 1).select("pt_idx", order, "x", "y", "value", "session", "cell", "n_members")


def cloud_bounds(points: DataFrame) -> DataFrame:
    return points.agg(*(f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))


def with_lonlat(points: DataFrame, epsg: int) -> DataFrame:
    lon, lat = utm_inverse(F.col("x"), F.col("y"), epsg)
    return points.withColumns({"lon": lon, "lat": lat})


# --- ingest -------------------------------------------------------------------------------------
def first_per_key(rows: DataFrame, key: str = "sample_id", position: str = "pos") -> DataFrame:
    """The first row of each key in order of position."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose key is not stored."""
    return batch.join(stored.select(key), key, "left_anti")


def ingest_counts(batch: DataFrame, stored: DataFrame, key: str = "sample_id", position: str = "pos") -> DataFrame:
    """One row: received, inserted, skipped."""
    fresh = new_rows(first_per_key(batch, key, position), stored, key).agg(F.count(F.lit(1)).alias("inserted"))
    return batch.agg(F.count(F.lit(1)).alias("received")).crossJoin(fresh).select("received", "inserted", (F.col("received") - F.col("inserted")).alias("skipped"))
