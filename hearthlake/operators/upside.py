"""What an estimate may be worth in some years: a shrunk trend, a fading deviation, the closing of the gap to the asking price, and risk.

A series is one sorted array of quarters, so each offer carries its own and all is columns. Which series speaks for an offer is the best of
its cell, city and region (``picked``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.crs import once
from ..functions.time import period_ordinal

# Parameters of the projection.
HORIZONS, HEADLINE = (4, 8, 12, 20), 20  # quarters
LONG_RUN, RECENT_WEIGHT, TREND_BOUNDS = 0.035, 0.35, (-0.02, 0.07)
GAP_QUARTERS, MOST_GAP, MODEL_SIGMA, AVERSION = 12, 0.3, 0.06, 2
SIGMA_BOUNDS, MOST_PHI, LEAST_FOR_PHI, Z80 = (0.01, 0.06), 0.6, 8, 1.2815515655446004
LABELS = ((70, "wysoki potencjał"), (55, "umiarkowany potencjał"), (45, "neutralny"), (30, "ograniczony potencjał"))
LEAST_LABEL = "niski potencjał"
SPECIFICITY, QUALITY = {"grid10": 3, "external_city": 2, "region": 1}, {"high": 2, "medium": 1, "low": 0}


def series_of(points: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """keys, series, trend: the points of each series with a quarter and a positive value, as one array of struct<t, v> in order, and its trend, for all who share it."""
    t, v = period_ordinal(F.col(period)), stats.finite(F.col(value).cast("double"))
    good = points.select(*keys, t.alias("t"), v.alias("v")).filter("t is not null and v > 0")
    made = good.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), "v"))).alias("series"))
    return made.withColumn("trend", trend(F.col("series")))


def picked(offers: DataFrame, models: DataFrame, key: str, geographies: dict[str, str]) -> DataFrame:
    """offers (key, target, segment, a column for each geography) with ``model``: struct of the best model's other columns; null without one.

    models: target, segment, geography_type, geography_key, quality, ... Quality counts before specificity; the first of equal ones by its key.
    """
    places = F.array(*(F.struct(F.lit(kind).alias("geography_type"), F.col(c).cast("string").alias("geography_key"), F.lit(SPECIFICITY[kind]).alias("specific")) for kind, c in geographies.items()))
    asked = offers.select(key, "target", "segment", F.explode(places).alias("p")).select(key, "target", "segment", "p.*").filter("geography_key is not null")
    rest = [c for c in models.columns if c not in ("target", "segment", "geography_type", "geography_key")]
    hit = asked.join(models, ["target", "segment", "geography_type", "geography_key"])
    score = F.coalesce(*(F.when(F.col("quality") == name, rank) for name, rank in QUALITY.items()), F.lit(0)) * 100 + F.col("specific")
    best = hit.groupBy(key).agg(F.max_by(F.struct("geography_type", "geography_key", *rest), F.struct(score, "geography_key")).alias("model"))
    return offers.join(best, key, "left")


def _returns(series: Column) -> Column:
    """Log returns a quarter between neighbours."""
    later, earlier = F.slice(series, F.lit(2), F.greatest(F.size(series) - 1, F.lit(0))), F.slice(series, F.lit(1), F.greatest(F.size(series) - 1, F.lit(0)))
    step = F.zip_with(later, earlier, lambda b, a: F.when(b["t"] > a["t"], F.ln(b["v"] / a["v"]) / (b["t"] - a["t"])))
    return F.array_compact(step)


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def trend(series: Column) -> Column:
    """struct<mu, phi, sigma, off> a quarter: the drift drawn to the long run, how a deviation fades, the spread, the last deviation."""

    def of(returns: Column) -> Column:
        n = F.size(returns)
        var = once(_mean(returns), lambda m: F.aggregate(returns, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))) / (n - 1)

        def fading(pair: Column) -> Column:
            a, b = pair["a"], pair["b"]
            both = once(F.struct(_mean(a).alias("a"), _mean(b).alias("b")), lambda m: F.struct(
                F.aggregate(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"])), F.lit(0.0), lambda s, v: s + v).alias("cov"), F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m["a"]) * (v - m["a"])).alias("var")))
            return once(both, lambda c: F.when(c["var"] > 0, F.least(F.lit(MOST_PHI), F.greatest(F.lit(0.0), c["cov"] / c["var"]))).otherwise(0.0))

        phi = F.when(n >= LEAST_FOR_PHI, once(F.struct(F.slice(returns, F.lit(1), F.greatest(n - 1, F.lit(1))).alias("a"), F.slice(returns, F.lit(2), F.greatest(n - 1, F.lit(1))).alias("b")), fading)).otherwise(0.0)
        sigma = F.when(n >= 2, F.sqrt(var)).otherwise(0.0)
        last = F.element_at(series, -1)
        before = F.element_at(F.filter(series, lambda p: p["t"] <= last["t"] - 8), -1)
        years = (last["t"] - before["t"]) / 4
        recent = F.when(F.size(F.filter(series, lambda p: p["t"] <= last["t"] - 8)) > 0, F.pow(last["v"] / before["v"], 1 / years) - 1)
        annual = F.least(F.lit(TREND_BOUNDS[1]), F.greatest(F.lit(TREND_BOUNDS[0]), RECENT_WEIGHT * F.coalesce(recent, F.lit(LONG_RUN)) + (1 - RECENT_WEIGHT) * LONG_RUN))
        bounded = F.least(F.lit(SIGMA_BOUNDS[1]), F.greatest(F.lit(SIGMA_BOUNDS[0]), sigma))
        made = F.struct(F.log1p(annual).alias("mu4"), phi.alias("phi"), bounded.alias("sigma"), F.when(n > 0, F.element_at(returns, -1)).alias("last"))
        return once(made, lambda m: F.struct((m["mu4"] / 4).alias("mu"), m["phi"].alias("phi"), m["sigma"].alias("sigma"), (F.coalesce(m["last"], m["mu4"] / 4) - m["mu4"] / 4).alias("off")))

    known = F.coalesce(F.size(series) > 0, F.lit(False))
    none = F.struct(F.lit(math.log1p(LONG_RUN) / 4).alias("mu"), F.lit(0.0).alias("phi"), F.lit(SIGMA_BOUNDS[0]).alias("sigma"), F.lit(0.0).alias("off"))
    return F.when(known, once(_returns(series), of)).otherwise(none)


def fading_sum(phi: Column, off: Column, quarters: int) -> Column:
    return F.when(phi <= 1e-6, 0.0).otherwise(off * phi * (1 - F.pow(phi, F.lit(float(quarters)))) / (1 - phi))


def variance(sigma: Column, phi: Column, quarters: int) -> Column:
    """Of the sum of so many quarters."""
    sums = reduce(lambda a, b: a + b, (F.pow((1 - F.pow(phi, F.lit(float(u)))) / (1 - phi), 2) for u in range(1, quarters + 1)))
    return sigma * sigma * F.when(phi <= 1e-6, float(quarters)).otherwise(sums)


def score(annual_pct: Column) -> Column:
    return stats.half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + 50 * F.tanh((annual_pct - LONG_RUN * 100) / 10))))


def upside(offers: DataFrame, key: str) -> DataFrame:
    """offers (key, fair_m2, offer_m2, comp_spread_pct, series) -> key, horizon (quarters), expected, p10, p90, annualized, risk_adjusted (per cent a year), score, label; growth_pct,
    fair_then and mispriced_pct are the same for all horizons of an offer. Offers without a fair price or a spread are left out. Offers that have their series' ``trend`` needn't have it computed
    for each of them."""
    good = offers.filter((F.col("fair_m2") > 0) & ~F.isnan("fair_m2") & (F.col("comp_spread_pct") >= 0))
    rows = good.withColumn("__t", F.col("trend") if "trend" in offers.columns else trend(F.col("series"))).withColumn("__gap", F.when(F.col("offer_m2") > 0, F.ln(F.col("fair_m2") / F.col("offer_m2"))))
    t, gap = F.col("__t"), F.col("__gap")

    def ahead(q: int) -> Column:
        closing = F.when(gap.isNotNull(), F.least(F.lit(MOST_GAP), F.greatest(F.lit(-MOST_GAP), (1 - F.exp(F.lit(-q / GAP_QUARTERS))) * gap))).otherwise(0.0)
        drift = q * t["mu"] + fading_sum(t["phi"], t["off"], q)
        return F.struct(F.lit(q).alias("horizon"), (drift + closing).alias("m"), (variance(t["sigma"], t["phi"], q) + MODEL_SIGMA**2).alias("var"))

    rows = rows.withColumn("__grown", HEADLINE * t["mu"] + fading_sum(t["phi"], t["off"], HEADLINE)).withColumn("__h", F.explode(F.array(*map(ahead, HORIZONS))))
    m, var, q = F.col("__h.m"), F.col("__h.var"), F.col("__h.horizon")
    yearly = lambda x: F.pow(F.exp(x), 4 / q) - 1
    out = rows.select(
        key, q.alias("horizon"), ((F.exp(m) - 1) * 100).alias("expected"), ((F.exp(m - Z80 * F.sqrt(var)) - 1) * 100).alias("p10"), ((F.exp(m + Z80 * F.sqrt(var)) - 1) * 100).alias("p90"), (yearly(m) * 100).alias("annualized"),
        (yearly(m - AVERSION * var) * 100).alias("risk_adjusted"), ((F.exp("__grown") - 1) * 100).alias("growth_pct"), (F.col("fair_m2") * F.exp("__grown")).alias("fair_then"), ((F.col("fair_m2") / F.when(F.col("offer_m2") > 0, F.col("offer_m2")) - 1) * 100).alias("mispriced_pct"),
    )
    out = out.withColumn("score", score(F.col("risk_adjusted")).cast("int"))
    return out.withColumn("label", F.coalesce(*(F.when(F.col("score") >= least, name) for least, name in LABELS), F.lit(LEAST_LABEL)))
