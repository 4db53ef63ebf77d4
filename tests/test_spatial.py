from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import geo
from larkspan.operators import crossval, kriging, spatial, suggest, variogram


def test_utm(spark):
    assert geo.utm_epsg(-81.74, 32.40) == 32617 and geo.utm_epsg(-60, -33) == 32721 and geo.utm_epsg(180, 1) == 32660 and geo.utm_epsg(180, 1, clamp=False) == 32661
    x, y = geo.utm_forward_np([-81.0, -81.0], [0.0, 32.0], 32617)
    assert x == pytest.approx([500_000.0, 500_000.0]) and y[0] == pytest.approx(0, abs=1e-6)
    # meridian arc to 32 degrees, by numerical integration of the radius of curvature
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    phi = np.linspace(0, math.radians(32), 200_001)
    m = np.trapezoid(geo.SEMI_MAJOR * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert y[1] == pytest.approx(0.9996 * m, abs=1e-4)
    lon, lat = geo.utm_inverse_np(*geo.utm_forward_np([-82.4, -79.9], [-45.0, 60.0], 32617), 32617)
    assert lon == pytest.approx([-82.4, -79.9], abs=1e-9) and lat == pytest.approx([-45.0, 60.0], abs=1e-9)
    df = spark.createDataFrame([(-81.7, 32.4)], "lon double, lat double")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), 32617)
    assert list(df.select(e, n).first()) == pytest.approx([float(v) for v in geo.utm_forward_np(-81.7, 32.4, 32617)], abs=1e-6)


@pytest.mark.parametrize(("p", "want"), [((0.5, 0.5), 2), ((0.0, 0.5), 1), ((1.0, 1.0), 1), ((1.5, 0.5), 0), ((0.5, -0.1), 0)])
def test_ring(spark, p, want):
    df = spark.createDataFrame([(*p, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "x double, y double, ring array<struct<x: double, y: double>>")
    assert df.select(geo.ring_position(F.col("x"), F.col("y"), F.col("ring"))).first()[0] == want


def test_support_mask_is_brute_force(spark):
    pts = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    grid = spark.createDataFrame([(0, i, x, 0.0) for i, x in enumerate((0.0, 1000.0, 1000.1))], "row int, col int, x double, y double")
    assert [r.supported for r in spatial.support_mask(grid, pts, 1000.0).orderBy("col").collect()] == [True, True, False]
    assert not any(r.supported for r in spatial.support_mask(grid, pts, 0.0).collect()) and all(r.supported for r in spatial.support_mask(grid, pts, None).collect())


def cloud(n=120, seed=0):
    import pandas as pd

    r = np.random.default_rng(seed)
    x, y = r.uniform(0, 10_000, (2, n))
    z = -100 + 6e-4 * x + 4e-4 * y + r.normal(0, 0.5, n)
    return pd.DataFrame({"pt_idx": range(n), "x": x, "y": y, "value": z, "session": (x // 2500).astype(int).astype(str), "cell": ["c1" if a < 5000 else "c2" for a in x]})


def test_variogram_matches_brute_force(spark):
    c = cloud()
    df = spark.createDataFrame(c)
    lag, semi, pairs = kriging.empirical_np(c.x.to_numpy(), c.y.to_numpy(), c.value.to_numpy(), 12, "log", None)
    rows = variogram.empirical(df, 12, "log").orderBy("bin").collect()
    assert [r.pairs for r in rows] == pairs.tolist() and [r.lag for r in rows] == pytest.approx(lag) and [r.semivariance for r in rows] == pytest.approx(semi)


def test_blocks_of_pairs(spark, monkeypatch):
    df = spark.createDataFrame(cloud())
    whole = [tuple(r) for r in variogram.empirical(df, 8, "linear").orderBy("bin").collect()]
    monkeypatch.setattr(variogram, "BLOCK", 25)
    parts = [tuple(r) for r in variogram.empirical(df, 8, "linear").orderBy("bin").collect()]
    assert [p[3] for p in parts] == [w[3] for w in whole] and [p[2] for p in parts] == pytest.approx([w[2] for w in whole])


@pytest.mark.parametrize("model", variogram.MODELS)
def test_fit_recovers_parameters(model):
    d = np.linspace(50, 5000, 25)
    true = {"linear": (0.01, 2.0), "power": (0.02, 1.1, 2.0)}.get(model, (30.0, 2500.0, 3.0))
    got = variogram.fit(d, variogram.semivariance(d, model, true), model)
    assert variogram.semivariance(d, model, got) == pytest.approx(variogram.semivariance(d, model, true), rel=0.03, abs=0.3)


def test_kriging(spark):
    c = cloud()
    m = kriging.fit_cloud(kriging.Ordinary(model="exponential"), c)
    mean, var = m.predict(c.x.to_numpy(), c.y.to_numpy())
    assert mean == pytest.approx(c.value.to_numpy(), abs=1e-6) and var.min() > -1e-9
    gx, gy = np.meshgrid(np.arange(0, 10_000, 700.0), np.arange(0, 10_000, 700.0))
    a, b = m.predict(gx.ravel(), gy.ravel()), m.predict(gx.ravel(), gy.ravel(), chunk=7)
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])
    with pytest.raises(RuntimeError):
        kriging.Ordinary().predict([0.0], [0.0])
    with pytest.raises(ValueError):
        m.predict([0.0], [0.0], chunk=0)
    pts = spark.createDataFrame(c)
    grid = spatial.support_mask(spatial.make_grid(pts, 1000.0), pts, 400.0)
    s = kriging.predict_grid(grid, m)
    assert s.where("mean is not null").count() == grid.where("supported").count() < grid.count()


def test_pathloss_places_tower():
    x = np.linspace(0, 2000, 60)
    z = -60 - 20 * np.log10(np.maximum(np.abs(x - 1000), 30))
    m = kriging.PathLoss(kriging.Ordinary(model="exponential")).fit(x, np.zeros(60) + np.arange(60) % 3, z, ["c"] * 60)
    assert abs(m.towers[0][0] - 1000) < 400
    with pytest.raises(ValueError):
        kriging.PathLoss(kriging.Ordinary()).fit(x, x, z, [""] * 60)


def test_folds():
    f = crossval.random_folds(23, 5, 0)
    assert sorted(np.bincount(f)) == [4, 4, 5, 5, 5]
    with pytest.raises(ValueError):
        crossval.random_folds(3, 5)
    with pytest.raises(ValueError):
        crossval.label_folds(["a", "a"])
    b = crossval.block_folds([0, 100, 5000, 5100], [0, 100, 0, 0], 2000, 10)
    assert b[0] == b[1] != b[2] == b[3]


def test_validation(spark):
    c = cloud()
    held = crossval.validate(spark, c, {"mode": "ordinary", "model": "exponential"}, 4, 0, 3000.0)
    assert held.groupBy("scheme").count().where(f"count <> {len(c)}").count() == 0
    m = {r.scheme: r for r in crossval.metrics(held).collect()}
    assert set(m) == {"session", "block", "random"} and m["random"].rmse < 1.5 and m["random"].r2 > 0.7 and m["random"].skill == "strong"


def test_selection(spark):
    s = spark.createDataFrame([(0, i, i * 500.0, 0.0, 5.0 + (i == 3) + (i == 4) * 0.5) for i in range(12)], "row int, col int, x double, y double, score double").withColumns({"stddev": F.col("score"), "road_name": F.lit("A"), "road_m": F.lit(0.0)})
    picks = suggest.choose(s, 3, 1200.0)
    assert [p["col"] for p in picks] == [3, 0, 6]
    assert suggest.order_route([0, 5000, 1000, 4000, 2000, 3000], [0] * 6) == [0, 2, 4, 5, 3, 1]


def test_candidates(spark):
    s = spark.createDataFrame([(0, i, float(i), 0.0, None if i == 9 else float(i)) for i in range(10)], "row int, col int, x double, y double, stddev double")
    assert sorted(r.col for r in spatial.candidate_cells(s, 0.5).collect()) == [4, 5, 6, 7, 8]
    with pytest.raises(ValueError):
        spatial.candidate_cells(s, 1.0)
    assert spatial.candidate_cells(s.where("stddev is null")).count() == 0
