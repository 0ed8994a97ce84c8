"""Comparable-based valuation for all targets at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


@dataclass(frozen=True)
class Selection:
    """bands: (least area ratio, most, market must match); a level is tried at every radius before the next."""

    bands: tuple[tuple[float, float, bool], ...] = ((0.87, 1.15, True), (0.5, 2.0, True), (0.25, 4.0, False))
    radii_m: tuple[float, ...] = (1000.0,)
    least: int = 3
    cap: int = 30
    max_age_days: int = 5 * 365
    distance_scale_m: float = 800.0
    half_life_months: float = 24.0
    listing_weight: float = 0.5


def weight(s: Selection) -> Column:
    """Of candidate columns c_* against target columns t_*."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp("t_as_of") - F.unix_timestamp("c_date")) / (30.44 * 86400))
    recency = F.pow(F.lit(0.5), F.coalesce(age, F.lit(0.0)) / s.half_life_months)
    near = F.coalesce(1 / (1 + F.col("distance_m") / s.distance_scale_m), F.lit(0.85))
    size = 1 / (1 + F.abs(F.ln(F.col("c_area") / F.greatest("t_area", F.lit(1e-6)))))
    rooms = F.when((F.col("t_kind") != "flat") | F.col("t_rooms").isNull(), 1.0).when(F.col("c_rooms").isNull(), 0.85).when(F.col("c_rooms") == F.col("t_rooms"), 1.0).when(F.abs(F.col("c_rooms") - F.col("t_rooms")) == 1, 0.8).otherwise(0.55)
    market = F.when(F.col("t_market") != F.col("c_market"), 0.65).otherwise(1.0)
    place = F.when(F.col("c_set") == "building", 2.0).otherwise(1.0)
    listing = F.when(F.col("c_set") == "listing", s.listing_weight).otherwise(1.0)
    return recency * near * size * rooms * market * place * listing


def most_weight(s: Selection, ask: Column, newest: Column) -> Column:
    """What no candidate of a target weighs more than, if none is newer and it lies at the same place."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp("t_as_of") - F.unix_timestamp(newest)) / (30.44 * 86400))
    return F.pow(F.lit(0.5), F.coalesce(age, F.lit(0.0)) / s.half_life_months) * F.when(ask, s.listing_weight).otherwise(2.0)


def reach_m(s: Selection, bound: Column, most: Column) -> Column:
    """Beyond which distance whatever weighs ``most`` at the place itself weighs less than ``bound``."""
    return s.distance_scale_m * (most / bound - 1) * 1.000001 + 1.0


def since(s: Selection, as_of: Column) -> Column:
    return as_of - F.expr(f"interval {s.max_age_days} days")


def in_time(s: Selection) -> Column:
    d = F.col("c_date")
    return d.isNull() | ((d <= F.col("t_as_of")) & (d >= since(s, F.col("t_as_of"))))


def fits(s: Selection, level: int, c_area: str = "c_area", c_market: str = "c_market") -> Column:
    """Whether a candidate is of a level's size and market, wherever it lies."""
    low, high, same = s.bands[level]
    size = (F.col(c_area) / F.greatest("t_area", F.lit(1e-6))).between(low, high)
    return size & F.coalesce(F.col("t_market") == F.col(c_market), F.lit(True)) if same else size


def select(pairs: DataFrame, s: Selection = Selection(), by: tuple[str, ...] = ("target_id",)) -> DataFrame:
    """pairs(target_id, t_*, c_*, distance_m) -> the rows of each target's tier with tier and weight, the best ``cap``.

    With more columns in ``by`` each of their groups is chosen for itself.

    A tier is a level and a radius; a row stands in each that admits it. Of a tier only its best rows are shuffled, which also tell whether it has
    enough: the first tier with enough rows is taken, else the last that has any.
    """
    tiers = []
    for level in range(len(s.bands)):
        for k, r in enumerate(s.radii_m):
            tiers.append(F.when(fits(s, level) & (F.col("distance_m").isNull() | (F.col("distance_m") <= r)), F.lit(level * len(s.radii_m) + k)))
    rows = pairs.filter(in_time(s)).withColumn("tier", F.explode(F.array_compact(F.array(*tiers)))).withColumn("weight", weight(s))
    best = Window.partitionBy(*by, "tier").orderBy(F.desc("weight"), "c_id")
    rows = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max(s.cap, s.least))
    tier = Window.partitionBy(*by, "tier")
    rows = rows.withColumn("__order", F.when(F.count(F.lit(1)).over(tier) >= s.least, F.col("tier")).otherwise(2 * len(tiers) - F.col("tier")))
    rows = rows.withColumn("__first", F.min("__order").over(Window.partitionBy(*by))).filter(F.col("__order") == F.col("__first"))
    return rows.filter((F.col("weight") > 0) & (F.col("rank") <= s.cap)).drop("__order", "__first")


def adjusted_price(beta: float) -> Column:
    """Unit price of a candidate in the target's time and size; asks are turned into transactions by c_ratio."""
    size = F.when((F.col("c_area") > 0) & (F.col("t_area") > 0), F.pow(F.col("c_area") / F.col("t_area"), F.lit(beta))).otherwise(1.0)
    turn = F.when(F.col("c_set") == "listing", F.coalesce("c_ratio", F.lit(1.0))).otherwise(F.coalesce("c_factor", F.lit(1.0)))
    return F.col("c_price") * turn * size


def estimate(chosen: DataFrame, beta: float = 0.0, least: int = 3) -> DataFrame:
    """target_id, n, fair, low, high, tier: weighted median and quartiles of adjusted prices; fair is null below ``least``."""
    price = adjusted_price(beta)
    pairs = F.collect_list(F.struct(price.cast("double").alias("value"), F.col("weight").cast("double").alias("weight")))
    g = chosen.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.max("tier").alias("tier"), pairs.alias("pairs"))
    q = {name: F.when(F.col("n") >= least, stats.weighted_quantile_of(F.col("pairs"), p)) for name, p in (("low", 0.25), ("fair", 0.5), ("high", 0.75))}
    return g.withColumns(q).drop("pairs")


def asking_ratio(asks: DataFrame, sales: DataFrame, keys: list[str], least: int = 50, bounds: tuple[float, float] = (0.7, 1.0)) -> DataFrame:
    """keys, ratio, n: weighted median over periods of sale / ask medians; both tables: keys, period, price."""
    middle = lambda df, name, n: stats.quantiles(df, [*keys, "period"], F.col("price"), {name: 0.5}, empty=True).select(*keys, "period", name, F.col("rows").alias(n))
    a, t = middle(asks, "ask", "na"), middle(sales, "sale", "nt")
    both = a.join(t, [*keys, "period"]).withColumn("r", F.col("sale") / F.col("ask")).filter((F.col("na") >= least) & (F.col("nt") >= least) & F.col("r").between(*bounds))
    return both.groupBy(*keys).agg(F.round(stats.weighted_quantile(F.col("r"), F.least("na", "nt"), 0.5), 3).alias("ratio"), F.sum(F.least("na", "nt")).alias("n"))
