"""Seasonal AR(1) forecasts by series and seeded cash-flow simulation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.time import period_ordinal

# Fixed values of the model: weight of the recent drift, differences that it and phi need, bounds, bands.
RECENT_WEIGHT, RECENT, MOST_PHI = 0.35, 8, 0.6
LEAST_TRAIN, LEAST_POINTS = 6, 8
Z80, HALF_LIFE, POOLED, WIDER = 1.2815515655446004, 8.0, 12, 1.1
EDGE = 1e-4

SCALES = {
    "log": (lambda v: np.log(v), lambda y: np.exp(y), lambda v: v > 0),
    "logit": (lambda v: np.log(np.clip(v, EDGE, 1 - EDGE) / (1 - np.clip(v, EDGE, 1 - EDGE))), lambda y: 1 / (1 + np.exp(-y)), lambda v: (v > 0) & (v < 1)),
    "level": (lambda v: v, lambda y: y, lambda v: np.isfinite(v)),
}


@dataclass
class Fit:
    """Drift, fading deviation of the last difference, and season of a series on its scale."""

    season: np.ndarray
    mu: float
    phi: float
    t: float
    level: float
    off: float

    def at(self, t: np.ndarray) -> np.ndarray:
        h = np.maximum(0, t - self.t)
        fading = self.off * self.phi * (1 - self.phi**h) / (1 - self.phi) if self.phi > 1e-6 else 0.0
        return self.level + h * self.mu + fading + self.season[np.mod(t, len(self.season)).astype(int)]


def seasons(t: np.ndarray, y: np.ndarray, period: int) -> np.ndarray:
    """Mean distances of each phase from a moving average, drawn to zero where few, with a sum of zero."""
    if period <= 1 or len(y) < 2 * period:
        return np.zeros(1)
    k = np.arange(len(y))
    first, stop = np.maximum(0, k - period // 2), np.minimum(len(y), k + -(-period // 2))
    total = np.concatenate([[0.0], np.cumsum(y)])
    away, phase = y - (total[stop] - total[first]) / (stop - first), np.mod(t, period).astype(int)
    n = np.bincount(phase, minlength=period)
    mean = np.bincount(phase, away, period) / np.maximum(n, 1) * (n / (n + 2))
    return mean - mean.mean()


def fit(t: np.ndarray, y: np.ndarray, period: int, drift: float) -> Fit:
    """Of points at rising times t; a difference over a gap counts by the period."""
    season = seasons(t, y, period)
    z = y - season[np.mod(t, len(season)).astype(int)]
    d = np.diff(z) / np.diff(t)
    mu = RECENT_WEIGHT * (d[-RECENT:].mean() if len(d) else drift) + (1 - RECENT_WEIGHT) * drift
    phi = 0.0
    if len(d) >= RECENT and (spread := ((d[:-1] - d[:-1].mean()) ** 2).sum()) > 0:
        phi = float(np.clip(((d[:-1] - d[:-1].mean()) * (d[1:] - d[1:].mean())).sum() / spread, 0, MOST_PHI))
    return Fit(season, float(mu), phi, float(t[-1]), float(z[-1]), float(d[-1] - mu) if len(d) else 0.0)


def backtest(t: np.ndarray, y: np.ndarray, period: int, drift: float, ahead: int) -> pd.DataFrame:
    """cut, h, predicted, actual, error from rolling origins, up to ``ahead`` periods on."""
    least = max(LEAST_TRAIN, 2 * period if period > 1 else 0)
    tables = []
    for cut in range(least, len(y) - 1 if len(y) > least + 1 else least):
        h = t[cut:] - t[cut - 1]
        near = h <= ahead
        predicted = fit(t[:cut], y[:cut], period, drift).at(t[cut:][near])
        tables.append(pd.DataFrame({"cut": cut, "h": h[near], "predicted": predicted, "actual": y[cut:][near], "error": y[cut:][near] - predicted}))
    return pd.concat(tables, ignore_index=True) if tables else pd.DataFrame(columns=["cut", "h", "predicted", "actual", "error"], dtype=float)


def band(errors: pd.DataFrame, h: int, sigma: float) -> tuple[float, float]:
    """Tenth and ninetieth percentile of the error h periods on.

    Errors over the root of their horizon are one sample, later origins counting more; a small sample gives way to the
    errors at h, and these to a normal spread.
    """
    weight = 0.5 ** ((errors["cut"].max() - errors["cut"].to_numpy(float)) / HALF_LIFE)
    if len(errors) >= POOLED:
        one = errors["error"].to_numpy(float) / np.sqrt(errors["h"].to_numpy(float))
        bias = stats.js_weighted_quantile(one, weight, 0.5)
        away = np.abs(one - bias)
        radius = WIDER * max(stats.js_weighted_quantile(away, weight, 0.8), stats.js_weighted_quantile(away, np.ones(len(away)), 0.9))
        if radius > 0:
            return (bias - radius) * math.sqrt(max(1, h)), (bias + radius) * math.sqrt(max(1, h))
    own = (errors["h"] == h).to_numpy()
    found = errors["error"].to_numpy(float)[own]
    if len(found) >= 5:
        return stats.js_weighted_quantile(found, weight[own], 0.1), stats.js_weighted_quantile(found, weight[own], 0.9)
    spread = float(found.std(ddof=1)) if len(found) > 1 else sigma * math.sqrt(max(1, h))
    return -Z80 * spread, Z80 * spread


def coverage(errors: pd.DataFrame) -> float | None:
    """The share of the last 30 % of origins' errors that bands of the earlier ones hold; null of few."""
    if len(errors) < POOLED:
        return None
    cuts = np.unique(errors["cut"])
    split = cuts[int(len(cuts) * 0.7)]
    before, later = errors[errors["cut"] < split], errors[errors["cut"] >= split]
    if not len(before) or not len(later):
        return None
    bands = {h: band(before, h, 0.05) for h in later["h"].unique()}
    held = [bands[h][0] <= e <= bands[h][1] for h, e in zip(later["h"], later["error"], strict=True)]
    return float(np.mean(held))


def forecast(t: np.ndarray, v: np.ndarray, per_year: int, ahead: int, scale: str = "log", growth: float = 0.035, volatility: float = 0.08, seasonal: bool | None = None) -> pd.DataFrame:
    """horizon, value, low, high, method, quality, coverage of one series of values at whole periods t.

    The plain and the seasonal candidate are told apart by their errors from rolling origins. Short series go on at the
    long-run growth.
    """
    turn, back, fits = SCALES[scale]
    good = np.isfinite(v) & fits(np.where(np.isfinite(v), v, -1.0))
    t, y = t[good].astype(float), turn(v[good].astype(float))
    order = np.argsort(t, kind="stable")
    t, y = t[order], y[order]
    keep = np.append(np.diff(t) > 0, True) if len(t) else np.zeros(0, bool)  # of one period the last row
    t, y = t[keep], y[keep]
    drift = 0.0 if scale == "logit" else math.log1p(growth) / per_year
    h = np.arange(1, ahead + 1)
    tried = []
    if len(y) >= LEAST_POINTS:
        periods = [1] + ([per_year] if (per_year == 12 if seasonal is None else seasonal) and per_year > 1 else [])
        tried = [(float(e["error"].abs().mean()), n, period, e) for n, period in enumerate(periods) if len(e := backtest(t, y, period, drift, ahead))]
    if not tried:
        last, spread = (y[-1] if len(y) else np.nan), volatility * np.sqrt(h / per_year)
        center = last + h * drift
        return pd.DataFrame({"horizon": h, "value": back(center), "low": back(center - Z80 * spread), "high": back(center + Z80 * spread), "method": "prior", "quality": "low", "coverage": np.nan})
    _, _, period, errors = min(tried, key=lambda x: x[:2])
    made = fit(t, y, period, drift)
    d = np.diff(y) / np.diff(t)
    sigma = float(d.std(ddof=1)) if len(d) > 1 else 0.02
    center, edges = made.at(t[-1] + h), np.array([sorted(band(errors, k, sigma)) for k in h.tolist()])
    held, years = coverage(errors), (t[-1] - t[0]) / per_year
    quality = "high" if years >= 4 and len(errors) >= 20 and (held is None or held >= 0.6) else "medium" if years >= 1.5 else "low"
    method = "seasonal-ar1" if len(made.season) > 1 else "ar1"
    return pd.DataFrame({"horizon": h, "value": back(center), "low": back(center + edges[:, 0]), "high": back(center + edges[:, 1]), "method": method, "quality": quality, "coverage": np.nan if held is None else held})


def forecasts(series: DataFrame, key: str, period: str, value: str, ahead: int = 4, scale: str = "log", seasonal: bool | None = None) -> DataFrame:
    """key, horizon, value, low, high, method, quality, coverage for each series of months (YYYY-MM) or quarters (YYYY-Qn).

    One series has a row a period, so a group is small.
    """
    kind = dict(series.dtypes)[key]
    rows = series.select(key, period_ordinal(F.col(period)).alias("__t"), F.col(period).contains("Q").alias("__q"), F.col(value).cast("double").alias("__v")).filter("__t is not null")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = forecast(part["__t"].to_numpy(float), part["__v"].to_numpy(float), 4 if part["__q"].iloc[0] else 12, ahead, scale, seasonal=seasonal)
        out.insert(0, key, part[key].iloc[0])
        return out

    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, horizon int, value double, low double, high double, method string, quality string, coverage double")


class Mulberry:
    """The public 32-bit generator of that name with Box-Muller normals; its constants are fixed values."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def uniform(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = ((t ^ t >> 15) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    def normal(self) -> float:
        u = max(np.finfo(float).eps, self.uniform())
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self.uniform())


def irr(outlay: float, flows: np.ndarray) -> float | None:
    """By bisection in [-0.9999, 10], 80 steps; null without a change of sign."""
    n = np.arange(1, len(flows) + 1)
    worth = lambda r: float((flows / (1 + r) ** n).sum()) - outlay
    low, high = -0.9999, 10.0
    if worth(low) * worth(high) > 0:
        return None
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if worth(low) * worth(mid) > 0 else (low, mid)
    return (low + high) / 2


def simulate(items: DataFrame, key: str, paths: int = 400, years: int = 10, seed: int = 123, correlation: float = 0.25) -> DataFrame:
    """items(key, price, income, growth, growth_sd, income_growth, income_sd) -> key, irr_p10, irr_p50, irr_p90, shortfall, loss.

    Paths are dealt out as rows, so one item is many small tasks' work; each has the generator of its
    number. shortfall is the mean of the worst tenth, loss the share of negative returns.
    """
    spread = items.withColumn("__path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))

    @F.pandas_udf("double")
    def returns(n: pd.Series, price: pd.Series, income: pd.Series, g: pd.Series, gs: pd.Series, ig: pd.Series, is_: pd.Series) -> pd.Series:
        other = math.sqrt(1 - correlation * correlation)
        out = []
        for k, p, i, a, b, c, d in zip(n, price, income, g, gs, ig, is_, strict=True):
            rng = Mulberry(seed + 7919 * int(k))
            worth, rent, flows = p, i, []
            for _ in range(years):
                z1, z2 = rng.normal(), rng.normal()
                flows.append(rent)
                worth *= math.exp(a + b * z1)
                rent *= math.exp(c + d * (correlation * z1 + other * z2))
            flows[-1] += worth
            found = irr(p, np.array(flows))
            out.append(float("nan") if found is None else found)
        return pd.Series(out)

    r = spread.withColumn("irr", returns("__path", "price", "income", "growth", "growth_sd", "income_growth", "income_sd")).filter(~F.isnan("irr"))
    g = r.groupBy(key).agg(F.sort_array(F.collect_list("irr")).alias("v"), F.percentile("irr", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.avg((F.col("irr") < 0).cast("double")).alias("loss"))
    worst = F.slice("v", F.lit(1), F.greatest(F.lit(1), F.floor(F.size("v") * 0.1).cast("int")))
    mean = F.aggregate(worst, F.lit(0.0), lambda s, x: s + x) / F.size(worst)
    return g.select(key, F.col("q")[0].alias("irr_p10"), F.col("q")[1].alias("irr_p50"), F.col("q")[2].alias("irr_p90"), mean.alias("shortfall"), "loss")
