"""Curves, bounds and correlations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def curve(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Straight lines between knots (x, y) in order; level outside; null stays null."""
    out = F.when(x <= knots[0][0], knots[0][1])
    for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= b, F.lit(u) + (x - a) * ((v - u) / (b - a)))
    return out.when(x > knots[-1][0], knots[-1][1])


def steps(x: Column, bands: list[tuple[float, float]], beyond: float) -> Column:
    """The value of the first band (upper end, value) that x is under; ``beyond`` the last."""
    out = None
    for top, value in bands:
        out = F.when(x < top, value) if out is None else out.when(x < top, value)
    return F.when(x.isNotNull(), out.otherwise(beyond))


def linear_score(x: Column, worst: float, best: float, most: float) -> Column:
    """0 at worst, ``most`` at best, a line between; either may be the larger."""
    return clamp((x - worst) / (best - worst), 0.0, 1.0) * most


def logit(p: Column, edge: float = 1e-4) -> Column:
    q = clamp(p, edge, 1 - edge)
    return F.ln(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Aggregate over aligned pairs: null under ``least`` pairs or without variance, within -1 and 1."""
    n = F.regr_count(y, x)
    wide = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.when((n >= least) & (wide > 0), clamp(F.try_divide(F.regr_sxy(y, x), wide), -1.0, 1.0))


def spread(x: Column, least: int = 2) -> Column:
    """Sample standard deviation; null under ``least`` values."""
    return F.when(F.count(x) >= least, F.stddev_samp(x))


def shrunk(r: Column, n: Column, prior: float, least: int = 4, strength: float = 8.0) -> Column:
    """A correlation drawn to a prior: the prior alone under ``least`` pairs, else r with weight n / (n + strength)."""
    w = n / (n + strength)
    return F.when(r.isNull() | (n < least), F.lit(prior)).otherwise(r * w + prior * (1 - w))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, of the text's UTF-8 bytes; the offset and the prime are fixed values."""
    raw = F.hex(F.encode(text, "utf-8"))
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    values = F.transform(places, lambda k: F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(values, F.lit(2166136261).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * 16777619, F.lit(1 << 32)))


def quality_rank(quality: Column, order: tuple[str, ...]) -> Column:
    """0 for the best of the names in order; what isn't among them comes after all."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), quality), F.lit(0)) - 1, F.lit(len(order)))


def floors_agree(a: Column, b: Column, mode: str) -> Column:
    """none: always; one: at most one apart; exact: equal. What isn't known never rejects."""
    apart = F.abs(a - b)
    return F.lit(True) if mode == "none" else F.coalesce(apart <= (1 if mode == "one" else 0), F.lit(True))
