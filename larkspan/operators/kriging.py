"""Ordinary and path-loss regression kriging: one factorisation on the driver, predictions spread over the cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators import variogram as V

#: Points beyond which a dense system is refused; its memory grows with their square and its time with their cube.
MOST_POINTS = 20_000
#: Distances between cells and points that are held at a time (32 MB of doubles).
DISTANCES = 4_000_000


def _stretches(cells: int, points: int, size: int | None) -> list[slice]:
    """Cells in stretches of ``size``, or of as many as :data:`DISTANCES` allows."""
    size = size or max(1, DISTANCES // max(1, points))
    return [slice(i, i + size) for i in range(0, cells, size)]


def _even(x, y, scaling: float, angle: float, centre) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates rotated about the centre and stretched across the main axis."""
    if scaling == 1.0:
        return x, y
    a = np.radians(angle)
    dx, dy = x - centre[0], y - centre[1]
    return dx * np.cos(a) + dy * np.sin(a), (-dx * np.sin(a) + dy * np.cos(a)) * scaling


@dataclass
class Ordinary:
    """Ordinary kriging of fitted points."""

    model: str = "exponential"
    nlags: int = 25
    spacing: str = "log"
    max_lag: float | None = None
    scaling: float = 1.0
    angle: float = 0.0
    params: np.ndarray | None = None
    bins: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    x: np.ndarray = field(default=None, repr=False)
    y: np.ndarray = field(default=None, repr=False)
    z: np.ndarray = field(default=None, repr=False)
    inverse: np.ndarray = field(default=None, repr=False)
    centre: tuple[float, float] = (0.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> Ordinary:
        x, y, z = (np.asarray(a, float) for a in (x, y, z))
        if len(x) > MOST_POINTS:
            raise ValueError(f"{len(x)} points are too many for one dense system of at most {MOST_POINTS}")
        self.centre = ((x.max() + x.min()) / 2, (y.max() + y.min()) / 2)
        self.x, self.y = _even(x, y, self.scaling, self.angle, self.centre)
        self.z = z
        if self.params is None:
            lag, semi, pairs = empirical_np(self.x, self.y, z, self.nlags, self.spacing, self.max_lag)
            limit = 3.0
            if self.spacing != "even" and (len(lag) < 5 or self.scaling != 1.0):
                lag, semi, pairs = empirical_np(self.x, self.y, z, self.nlags, "even", None, least_pairs=1)
                limit = 1.0
            elif self.spacing == "even":
                limit = 1.0
            self.bins = (lag, semi, pairs)
            self.params = V.fit(lag, semi, self.model, limit)
        n = len(x)
        a = np.zeros((n + 1, n + 1))
        a[:n, :n] = -V.semivariance(np.hypot(self.x[:, None] - self.x[None], self.y[:, None] - self.y[None]), self.model, self.params)
        np.fill_diagonal(a, 0.0)
        a[n, :n] = a[:n, n] = 1.0
        self.inverse = np.linalg.pinv(a) if n < 3 else np.linalg.inv(a)
        return self

    def predict(self, x: np.ndarray, y: np.ndarray, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance; the same for any size of chunk."""
        if self.inverse is None:
            raise RuntimeError("predict needs a fitted model")
        if chunk is not None and chunk < 1:
            raise ValueError("a chunk has at least one cell")
        x, y = np.asarray(x, float), np.asarray(y, float)
        mean, var = np.empty(len(x)), np.empty(len(x))
        for part in _stretches(len(x), len(self.z), chunk):
            px, py = _even(x[part], y[part], self.scaling, self.angle, self.centre)
            d = np.hypot(px[:, None] - self.x[None], py[:, None] - self.y[None])
            b = np.ones((len(px), len(self.z) + 1))
            b[:, :-1] = np.where(d <= 1e-10, 0.0, -V.semivariance(d, self.model, self.params))
            w = b @ self.inverse.T
            mean[part], var[part] = w[:, :-1] @ self.z, -(w * b).sum(axis=1)
        return mean, var

    @property
    def range_m(self) -> float | None:
        return float(self.params[1]) if self.params is not None and self.model in V.RANGED else None

    def report(self) -> dict:
        out = {"model": self.model, **V.as_dict(self.model, self.params)}
        if self.bins is not None:
            lag, semi, pairs = self.bins
            off = V.semivariance(lag, self.model, self.params) - semi
            near = lag <= 500
            out |= {"bins": [{"lag_m": float(a), "semivariance": float(b), "pairs": int(c)} for a, b, c in zip(lag, semi, pairs, strict=True)], "rmse": float(np.sqrt((off**2).mean())), "rmse_500m": float(np.sqrt((off[near] ** 2).mean())) if near.any() else None}
        return out


def empirical_np(x, y, z, nlags: int, spacing: str, max_lag: float | None, least_lag: float = V.LEAST_LAG, least_pairs: int = V.LEAST_PAIRS):
    """The bins of :func:`larkspan.operators.variogram.empirical` for points in memory, as in the folds of a validation."""
    i, j = np.triu_indices(len(x), 1)
    d = np.hypot(x[i] - x[j], y[i] - y[j])
    ok = d > 0
    if not ok.any():
        raise ValueError("no two points apart")
    d, half = d[ok], 0.5 * (z[i[ok]] - z[j[ok]]) ** 2
    bins = V.edges(spacing, nlags, d.min(), d.max(), max_lag, least_lag)
    b = np.searchsorted(bins, d, "right") - 1
    ok = (b >= 0) & (b < len(bins) - 1)
    n = np.bincount(b[ok], minlength=len(bins) - 1)
    keep = n >= max(1, least_pairs)
    if not keep.any():
        raise ValueError("no lag has enough pairs")
    mean = lambda w: (np.bincount(b[ok], weights=w[ok], minlength=len(bins) - 1)[keep] / n[keep])
    return mean(d), mean(half), n[keep]


@dataclass
class PathLoss:
    """Kriging of what a trend of the level on the distance to the nearest tower leaves."""

    base: Ordinary
    least_samples: int = 20
    least_m: float = 30.0
    towers: np.ndarray = None
    intercept: float = 0.0
    slope: float = 0.0

    def fit(self, x, y, z, cell=None) -> PathLoss:
        if cell is None:
            raise ValueError("path loss needs the cell of each point")
        x, y, z, cell = np.asarray(x, float), np.asarray(y, float), np.asarray(z, float), np.asarray(cell, object)
        found = []
        for c in sorted({c for c in cell if c}):
            at = cell == c
            w = 10 ** (z[at] / 10)
            if at.sum() >= self.least_samples and w.sum() > 0:
                found.append(((x[at] * w).sum() / w.sum(), (y[at] * w).sum() / w.sum()))
        if not found:
            raise ValueError("no cell has enough points to place a tower")
        self.towers = np.array(found)
        d = np.log10(self.distance(x, y))
        self.slope, self.intercept = np.polyfit(d, z, 1) if np.ptp(d) > 0 else (0.0, z.mean())
        self.base.fit(x, y, z - self.trend(x, y))
        return self

    def distance(self, x, y) -> np.ndarray:
        return np.maximum(np.hypot(np.asarray(x)[:, None] - self.towers[:, 0], np.asarray(y)[:, None] - self.towers[:, 1]).min(axis=1), self.least_m)

    def trend(self, x, y) -> np.ndarray:
        return self.intercept + self.slope * np.log10(self.distance(x, y))

    def predict(self, x, y, chunk: int | None = None):
        if self.towers is None:
            raise RuntimeError("predict needs a fitted model")
        mean, var = self.base.predict(x, y, chunk)
        return mean + self.trend(x, y), var

    @property
    def range_m(self) -> float | None:
        return self.base.range_m

    def report(self) -> dict:
        return self.base.report() | {"towers": len(self.towers), "trend_intercept": float(self.intercept), "trend_slope": float(self.slope)}


def factory(mode: str = "ordinary", **settings):
    """Makes unfitted models of a mode; towers rule out an anisotropy."""
    if mode == "ordinary":
        return lambda: Ordinary(**settings)
    if mode == "pathloss":
        settings = {k: v for k, v in settings.items() if k not in ("scaling", "angle")}
        return lambda: PathLoss(Ordinary(**settings))
    raise ValueError(f"unknown kriging mode {mode!r}")


def cloud(points: DataFrame) -> pd.DataFrame:
    """The modelled points in order of their index. Their number is bounded by what one dense system takes."""
    rows = points.select("pt_idx", "x", "y", "value", "session", "cell").limit(MOST_POINTS + 1).toPandas()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points for one dense system")
    return rows.sort_values("pt_idx").reset_index(drop=True)


def fit_cloud(model, c: pd.DataFrame):
    args = [c[k].to_numpy() for k in ("x", "y", "value")]
    return model.fit(*args, cell=c["cell"].to_numpy()) if isinstance(model, PathLoss) else model.fit(*args)


def support_radius(model, multiple: float | None) -> float | None:
    """The range times a multiple; None if the multiple isn't positive or the model has no range."""
    return None if not multiple or multiple <= 0 or model.range_m is None else model.range_m * multiple


def predict_grid(grid: DataFrame, model) -> DataFrame:
    """``row, col, x, y, mean, variance, stddev``; null where ``supported`` is false, whose cells no model sees."""
    shared = grid.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mean, var = shared.value.predict(f["x"].to_numpy(), f["y"].to_numpy())
            yield f[["row", "col"]].assign(mean=mean, variance=var)

    known = grid.where("supported").select("row", "col", "x", "y").mapInPandas(run, "row int, col int, mean double, variance double")
    out = grid.select("row", "col", "x", "y").join(known, ["row", "col"], "left")
    return out.withColumn("stddev", F.when(F.col("variance").isNotNull(), F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))))
