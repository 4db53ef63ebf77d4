"""Empirical variograms over blocks of points, and bounded fits of their models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = ("linear", "power", "gaussian", "spherical", "exponential", "hole-effect")
#: Models whose second parameter is a range.
RANGED = ("gaussian", "spherical", "exponential", "hole-effect")
#: Points that meet as many others in one task.
BLOCK = 1000
LEAST_LAG, LEAST_PAIRS = 25.0, 10


def semivariance(d: np.ndarray, model: str, params) -> np.ndarray:
    """Model values; ``params``: partial sill, range, nugget; slope, nugget; or scale, exponent, nugget."""
    d = np.asarray(d, float)
    if model == "linear":
        return params[0] * d + params[1]
    sill, reach, nugget = params
    if model == "power":
        return sill * d**reach + nugget
    if model == "spherical":
        return np.where(d <= reach, sill * (1.5 * d / reach - 0.5 * (d / reach) ** 3), sill) + nugget
    if model == "exponential":
        return sill * (1 - np.exp(-3 * d / reach)) + nugget
    if model == "gaussian":
        return sill * (1 - np.exp(-((d / (4 * reach / 7)) ** 2))) + nugget
    if model == "hole-effect":
        return sill * (1 - (1 - 3 * d / reach) * np.exp(-3 * d / reach)) + nugget
    raise ValueError(f"unknown variogram model {model!r}")


def _block_pairs(points: DataFrame, work, schema: str) -> DataFrame:
    """``work(x, y, v, other x, y, v, same block)`` for every two blocks of points, each pair of points in one of them."""
    n = points.count()
    blocks = max(1, -(-n // BLOCK))
    own = points.select("x", "y", "value", F.pmod(F.xxhash64("x", "y", "value"), F.lit(blocks)).cast("int").alias("own"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("x", "y", "value", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        a, b = g[g["own"] == i], g[g["own"] == j]
        return work(*(a[c].to_numpy() for c in ("x", "y", "value")), *(b[c].to_numpy() for c in ("x", "y", "value")), i == j)

    return dealt.groupBy("i", "j").applyInPandas(run, schema)


def _distances(x, y, x2, y2, same):
    """Rows of distances with the index of each pair, a row of the first block at a time."""
    for k in range(len(x)):
        start = k + 1 if same else 0
        yield k, start, np.hypot(x2[start:] - x[k], y2[start:] - y[k])


def distance_range(points: DataFrame) -> tuple[float | None, float | None]:
    """Least positive and greatest distance between points."""

    def work(x, y, v, x2, y2, v2, same):
        least, most = np.inf, 0.0
        for _, _, d in _distances(x, y, x2, y2, same):
            if len(p := d[d > 0]):
                least, most = min(least, p.min()), max(most, p.max())
        return pd.DataFrame({"least": [least], "most": [most]}) if most else pd.DataFrame({"least": [], "most": []}, dtype=float)

    return tuple(_block_pairs(points, work, "least double, most double").agg(F.min("least"), F.max("most")).first())


def edges(spacing: str, nlags: int, least: float, most: float, max_lag: float | None = None, min_lag: float = LEAST_LAG) -> np.ndarray:
    cap = min(max_lag, most) if max_lag else most
    if spacing == "linear":
        return np.linspace(0.0, cap, nlags + 1)
    if spacing == "log":
        low = max(min_lag, least)
        return np.array([low, cap]) if low >= cap else np.geomspace(low, cap, nlags + 1)
    if spacing == "even":  # equal bins between the least and the greatest distance
        return np.linspace(least, most, nlags + 1)
    raise ValueError(f"unknown spacing {spacing!r}")


def empirical(points: DataFrame, nlags: int = 25, spacing: str = "log", max_lag: float | None = None, min_lag: float = LEAST_LAG, min_pairs: int = LEAST_PAIRS) -> DataFrame:
    """``bin, lag, semivariance, pairs`` of the bins with enough pairs.

    Bins are closed below and open above, so pairs nearer than the first edge and those at the greatest distance fall out.
    """
    least, most = distance_range(points)
    if least is None:
        raise ValueError("no two points apart")
    bins = edges(spacing, nlags, least, most, max_lag, min_lag)

    def work(x, y, v, x2, y2, v2, same):
        n = len(bins) - 1
        sums = np.zeros((3, n))
        for k, start, d in _distances(x, y, x2, y2, same):
            b = np.searchsorted(bins, d, "right") - 1
            ok = (d > 0) & (b >= 0) & (b < n)
            half = 0.5 * (v2[start:] - v[k]) ** 2
            for row, w in enumerate((d, half, np.ones(len(d)))):
                sums[row] += np.bincount(b[ok], weights=w[ok], minlength=n)
        some = np.flatnonzero(sums[2])
        return pd.DataFrame({"bin": some.astype("int32"), "d": sums[0][some], "s": sums[1][some], "n": sums[2][some].astype("int64")})

    sums = _block_pairs(points, work, "bin int, d double, s double, n long").groupBy("bin").agg(F.sum("d").alias("d"), F.sum("s").alias("s"), F.sum("n").alias("pairs"))
    return sums.where(F.col("pairs") >= min_pairs).select("bin", (F.col("d") / F.col("pairs")).alias("lag"), (F.col("s") / F.col("pairs")).alias("semivariance"), "pairs")


def fit(lag: np.ndarray, semi: np.ndarray, model: str, reach_limit: float = 3.0) -> np.ndarray:
    """Parameters within bounds that minimise the soft absolute loss, from several starts."""
    lag, semi = np.asarray(lag, float), np.asarray(semi, float)
    low_s, top_s, top_d = semi.min(), semi.max(), lag.max()
    if model == "linear":
        slope = (top_s - low_s) / max(top_d - lag.min(), 1e-12)
        starts, low, high = [[slope, low_s]], [0, 0], [np.inf, top_s]
    elif model == "power":
        scale = (top_s - low_s) / max(top_d - lag.min(), 1e-12)
        starts, low, high = [[scale, 1.1, low_s]], [0, 0.001, 0], [np.inf, 1.999, top_s]
    else:
        starts = [[top_s - low_s, 0.25 * top_d, low_s], [0.5 * top_s, 0.75 * top_d, 0.5 * low_s], [top_s, 1.5 * top_d, 0.1 * low_s], [0.8 * (top_s - low_s), 0.1 * top_d, low_s]]
        low, high = [0, 1e-9 * top_d, 0], [10 * top_s, reach_limit * top_d, top_s]
    low, high = np.array(low, float), np.array(high, float)
    best, cost = None, np.inf
    for s in starts:
        p, c = _descend(np.clip(np.array(s, float), low, high), lag, semi, model, low, high)
        if c < cost - 1e-12:
            best, cost = p, c
    return best


def _descend(p, lag, semi, model, low, high):
    """Damped Gauss-Newton steps on reweighted residuals, projected on the bounds."""

    def residual(q):
        return semivariance(lag, model, q) - semi

    def loss(q):
        return float((np.sqrt(1 + residual(q) ** 2) - 1).sum())

    damp, now = 1e-3, loss(p)
    for _ in range(300):
        r = residual(p)
        step = np.maximum(np.abs(p), 1e-6) * 1e-6
        jac = np.column_stack([(residual(p + np.where(np.arange(len(p)) == k, step, 0)) - r) / step[k] for k in range(len(p))])
        w = 1 / np.sqrt(1 + r * r)
        free = ~(((p <= low) & (jac.T @ (w * r) > 0)) | ((p >= high) & (jac.T @ (w * r) < 0)))
        if not free.any():
            break
        j = jac[:, free]
        h = (j * w[:, None]).T @ j
        q = p.copy()
        q[free] -= np.linalg.lstsq(h + damp * np.diag(np.maximum(np.diag(h), 1e-18)), j.T @ (w * r), rcond=None)[0]
        q = np.clip(q, low, high)
        then = loss(q)
        if then < now:
            if now - then < 1e-13 * (1 + now):
                return q, then
            p, now, damp = q, then, max(damp / 4, 1e-12)
        else:
            damp *= 5
            if damp > 1e12:
                break
    return p, now


def as_dict(model: str, params: np.ndarray) -> dict:
    """Named parameters; the sill of a report is partial sill plus nugget."""
    if model == "linear":
        return {"slope": float(params[0]), "nugget": float(params[1])}
    if model == "power":
        return {"scale": float(params[0]), "exponent": float(params[1]), "nugget": float(params[2])}
    return {"partial_sill": float(params[0]), "range_m": float(params[1]), "nugget": float(params[2]), "sill": float(params[0] + params[2])}
