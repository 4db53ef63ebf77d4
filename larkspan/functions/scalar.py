"""Scalar functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_decimal(x: Column, digits: int) -> Column:
    """Half away from zero on the decimal value of the number, as databases round exact numerics."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def round_even(x: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` rounded half to even; null where the whole is zero."""
    return F.bround(part / F.nullif(whole, F.lit(0)), digits)


def finite(x: Column) -> Column:
    """The number, or null for null, NaN and infinities."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def weakness_weight(predicted: Column, bias: float = 0.5) -> Column:
    """1 for a level of -95 or better, rising to ``1 + bias`` at -120."""
    return 1 + bias * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (-95.0 - predicted) / 25.0))


def road_name(raw: Column) -> Column:
    """Trimmed; null for missing, blank and ``nan``."""
    name = F.trim(raw)
    return F.when((name != "") & (F.lower(name) != "nan"), name)


def road_name_of_list(raw: Column) -> Column:
    """The first of a list that is not missing."""
    return F.get(F.filter(F.transform(raw, road_name), lambda x: x.isNotNull()), F.lit(0))


def variogram(d: Column, model: str, sill: Column | float, reach: Column | float, nugget: Column | float) -> Column:
    """Semivariance at distance ``d``; ``sill`` is the partial sill. Linear: slope ``sill``; power: scale and exponent."""
    sill, reach, nugget = (x if isinstance(x, Column) else F.lit(float(x)) for x in (sill, reach, nugget))
    h = d / (reach / 3.0)
    return {
        "linear": lambda: sill * d + nugget,
        "power": lambda: sill * F.pow(d, reach) + nugget,
        "spherical": lambda: F.when(d <= reach, sill * (1.5 * d / reach - 0.5 * F.pow(d / reach, F.lit(3.0)))).otherwise(sill) + nugget,
        "exponential": lambda: sill * (1 - F.exp(-h)) + nugget,
        "gaussian": lambda: sill * (1 - F.exp(-F.pow(d / (reach * 4.0 / 7.0), F.lit(2.0)))) + nugget,
        "hole-effect": lambda: sill * (1 - (1 - h) * F.exp(-h)) + nugget,
    }[model]()
