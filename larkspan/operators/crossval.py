"""Cross-validation: folds, a refit for each of them in parallel, accuracy and calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.kriging import factory, fit_cloud

SCHEMES = ("session", "block", "random")
_ROWS = "config string, scheme string, fold int, pt_idx long, actual double, predicted double, kstd double"


def random_folds(n: int, k: int = 10, seed: int = 0) -> np.ndarray:
    """Fold of each point: a seeded permutation in ``k`` nearly equal parts."""
    if not 2 <= k <= n:
        raise ValueError(f"{k} folds of {n} points")
    out = np.empty(n, int)
    for i, part in enumerate(np.array_split(np.random.RandomState(seed).permutation(n), k)):
        out[part] = i
    return out


def label_folds(labels) -> np.ndarray:
    """A fold for each distinct label, in sorted order."""
    names, folds = np.unique(np.asarray(labels, str), return_inverse=True)
    if len(names) < 2:
        raise ValueError("folds by label need two labels")
    return folds


def block_tiles(x, y, block: float = 2000.0) -> np.ndarray:
    """Label of the square tile of each point."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    return np.floor((x - x.min()) / block).astype(np.int64) * 1_000_003 + np.floor((y - y.min()) / block).astype(np.int64)


def block_folds(x, y, block: float = 2000.0, k: int = 10, seed: int = 0) -> np.ndarray:
    """Tiles dealt to folds in turn, in a seeded order."""
    tiles, of = np.unique(block_tiles(x, y, block), return_inverse=True)
    k = min(k, len(tiles))
    if k < 2:
        raise ValueError("all points are in one tile")
    turn = np.empty(len(tiles), int)
    turn[np.random.RandomState(seed).permutation(len(tiles))] = np.arange(len(tiles)) % k
    return turn[of]


def folds(c: pd.DataFrame, scheme: str, k: int = 10, seed: int = 0, block: float = 2000.0) -> np.ndarray:
    if scheme == "session":
        return label_folds(c["session"])
    if scheme == "block":
        return block_folds(c["x"], c["y"], block, k, seed)
    if scheme == "random":
        return random_folds(len(c), k, seed)
    raise ValueError(f"unknown scheme {scheme!r}")


def run_folds(spark, c: pd.DataFrame, plan: list[tuple[str, str, dict, np.ndarray]]) -> DataFrame:
    """One row for each held-out point of each (config, scheme, model settings, folds): every fold is a task of its own, with
    the points broadcast."""
    shared = spark.sparkContext.broadcast((c, plan))
    jobs = [(i, int(f)) for i, (_, _, _, of) in enumerate(plan) for f in np.unique(of)]
    rows = spark.createDataFrame(jobs, "job int, fold int").repartition(len(jobs), "job", "fold")

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        points, all_ = shared.value
        name, scheme, settings, of = all_[key[0]]
        held = of == key[1]
        model = fit_cloud(factory(**settings)(), points[~held].reset_index(drop=True))
        test = points[held]
        mean, var = model.predict(test["x"].to_numpy(), test["y"].to_numpy())
        return pd.DataFrame({"config": name, "scheme": scheme, "fold": int(key[1]), "pt_idx": test["pt_idx"].to_numpy(), "actual": test["value"].to_numpy(), "predicted": mean, "kstd": np.sqrt(np.maximum(var, 0))})

    return rows.groupBy("job", "fold").applyInPandas(run, _ROWS)


def validate(spark, c: pd.DataFrame, settings: dict, k: int = 10, seed: int = 0, block: float = 2000.0, schemes=SCHEMES, config: str = "run") -> DataFrame:
    """Held-out predictions under each scheme; folds by session are left out where there is only one session."""
    plan = []
    for s in schemes:
        try:
            plan.append((config, s, settings, folds(c, s, k, seed, block)))
        except ValueError:
            if s != "session":
                raise
    return run_folds(spark, c, plan)


def metrics(rows: DataFrame, by: tuple[str, ...] = ("config", "scheme")) -> DataFrame:
    """Accuracy and calibration of held-out predictions; population deviations, and null where a figure has no meaning.

    Rows without a positive kriging deviation count in its mean but not in the calibration.
    """
    e = F.col("predicted") - F.col("actual")
    z = F.when(F.col("kstd") > 0, e / F.col("kstd"))
    a = rows.withColumns({"e": e, "z": z}).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"),
        F.corr("actual", "predicted").alias("r"), F.sum(F.col("e") * F.col("e")).alias("sse"), (F.var_pop("actual") * F.count(F.lit(1))).alias("sst"),
        F.min("e").alias("min_error"), F.max("e").alias("max_error"), F.avg("kstd").alias("mean_kriging_std"), F.stddev_pop("e").alias("std_error"),
        F.avg("z").alias("mean_std_resid"), F.stddev_pop("z").alias("std_std_resid"),
        F.avg((F.abs("z") <= 1).cast("double")).alias("within_1s"), F.avg((F.abs("z") <= 2).cast("double")).alias("within_2s"),
    )
    r2 = 1 - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))
    skill = F.when(F.col("r2") >= 0.5, "strong").when(F.col("r2") >= 0.2, "moderate").when(F.col("r2") > 0, "weak").otherwise("none")
    calibrated = F.when(F.col("std_std_resid").between(0.8, 1.25), "well-calibrated").when(F.col("std_std_resid") > 1.25, "overconfident").otherwise("underconfident")
    return a.withColumn("r2", r2).withColumn("r", F.when(~F.isnan("r"), F.col("r"))).withColumns({"skill": skill, "calibration": calibrated}).drop("sse", "sst")


#: Stretches and angles that a scan tries besides none.
SCALINGS, ANGLES, GAIN = (1.5, 2.0, 3.0), (0, 30, 60, 90, 120, 150), 0.05


def scan_anisotropy(spark, c: pd.DataFrame, settings: dict, k: int = 10) -> DataFrame:
    """RMSE of each stretch and angle, all in one job; ``helps`` if it is better than none by more than ``GAIN``."""
    of = _quick_folds(c, k)
    plan = [("1.0:0", "scan", settings, of)] + [(f"{s}:{a}", "scan", settings | {"scaling": s, "angle": float(a)}, of) for s in SCALINGS for a in ANGLES]
    rows = metrics(run_folds(spark, c, plan)).select("config", "rmse", "r2")
    base = rows.where("config = '1.0:0'").select(F.col("rmse").alias("base"))
    return rows.crossJoin(F.broadcast(base)).withColumn("helps", F.col("rmse") < F.col("base") - GAIN).orderBy("rmse", "config")


def _quick_folds(c: pd.DataFrame, k: int) -> np.ndarray:
    try:
        return label_folds(c["session"])
    except ValueError:
        return random_folds(len(c), min(k, len(c)), 0)


def compare(spark, c: pd.DataFrame, settings: dict, k: int = 10, scan: bool = False) -> DataFrame:
    """Models by RMSE: three families of ordinary kriging, path loss where cells allow it, and the best stretch of a scan."""
    of = _quick_folds(c, k)
    plain = {a: b for a, b in settings.items() if a not in ("mode", "model", "scaling", "angle")}
    plan = [(f"ordinary/{m}", "compare", plain | {"model": m}, of) for m in ("exponential", "spherical", "gaussian")]
    if (c["cell"] != "").any():
        plan.append(("pathloss", "compare", plain | {"mode": "pathloss"}, of))
    if scan:
        best = scan_anisotropy(spark, c, plain, k).where("helps").limit(1).collect()
        if best:
            s, a = best[0]["config"].split(":")
            plan.append((f"ordinary/anisotropic {s}:{a}", "compare", plain | {"scaling": float(s), "angle": float(a)}, of))
    return metrics(run_folds(spark, c, plan)).select("config", "n", "rmse", "mae", "r2", "within_1s").orderBy("rmse", "config")
