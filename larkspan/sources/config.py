"""Settings of a run, from arguments, environment and defaults in this order."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace  # noqa: F401  replace is also used by callers

PREFIX = "LARKSPAN_"
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


def parse_bool(text: str) -> bool:
    t = text.strip().lower()
    if t in TRUE or t in FALSE:
        return t in TRUE
    raise ValueError(f"{text!r} is neither true nor false")


def parse_anisotropy(text: str) -> tuple[float, float]:
    """``scaling:angle``."""
    a, sep, b = text.partition(":")
    try:
        scaling, angle = float(a), float(b)
    except ValueError:
        scaling = 0.0
    if not sep or not scaling > 0:
        raise ValueError(f"{text!r} is not SCALING:ANGLE with a positive scaling")
    return scaling, angle


def parse_multiple(text: str) -> float:
    """A finite number, zero to switch off."""
    v = float(text)
    if not 0 <= v < float("inf"):
        raise ValueError(f"{text!r} is not a number of zero or more")
    return v


def parse_mode(text: str) -> str:
    if text not in ("ordinary", "pathloss"):
        raise ValueError(f"unknown kriging mode {text!r}")
    return text


def parse_spacing(text: str) -> str:
    if text not in ("log", "linear", "even"):
        raise ValueError(f"unknown lag spacing {text!r}")
    return text


@dataclass(frozen=True)
class Config:
    output_dir: str = "output"
    kriging: str = "ordinary"
    none_floor: float | None = None
    anisotropy: tuple[float, float] = (1.0, 0.0)
    dedupe_runs: bool = True
    lag_spacing: str = "log"
    max_lag_m: float | None = None
    min_session_rows: int = 3
    support_range_multiple: float = 1.0
    max_batch: int = 5000
    cell_m: float = 150.0
    variogram_model: str = "exponential"
    nlags: int = 25
    folds: int = 10
    seed: int = 0
    block_m: float = 2000.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, **given) -> Config:
        """Given values win over the environment; unset and None ones leave the default."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            text = env.get(PREFIX + f.name.upper())
            if text is not None and text != "":
                found[f.name] = _PARSE.get(f.name, str)(text)
        return replace(cls(), **(found | {k: v for k, v in given.items() if v is not None}))

    def model(self) -> dict:
        """Settings for a model."""
        return {"mode": self.kriging, "model": self.variogram_model, "nlags": self.nlags, "spacing": self.lag_spacing, "max_lag": self.max_lag_m, "scaling": self.anisotropy[0], "angle": self.anisotropy[1]}


_PARSE = {
    "kriging": parse_mode, "none_floor": float, "anisotropy": parse_anisotropy, "dedupe_runs": parse_bool, "lag_spacing": parse_spacing, "max_lag_m": float, "min_session_rows": int,
    "support_range_multiple": parse_multiple, "max_batch": int, "cell_m": float, "nlags": int, "folds": int, "seed": int, "block_m": float,
}
