"""Sale estimates end to end: evidence around each target, conversion, one price, its spread, guard and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..shared import cut
from . import comps
from .spatial import within_radius

# How prices go with size by kind; when a discount is too good; points of the confidence.
SIZE_POWER = {"flat": 0.0, "house": 0.0, "plot": 0.9}
DISCOUNT_PCT, FEW_COMPS, WIDE_SPREAD = 45.0, 5, 0.8
SPREAD_STEPS, ADJUSTED_STEPS, RECENT_STEPS = ((20.0, 15), (35.0, 8)), ((0.75, 15), (0.4, 8)), ((3, 15), (1, 8))
MOST_RCN_POINTS, RCN_POINTS, BUILDING_POINTS, ASKING_ONLY = 40, 5, 15, 35
CLOSE_PARTS = (0.25, 0.5, 1.0)  # of the radius, where full evidence is looked for in turn
LEVELS = ((75, "high"), (45, "medium"))


def converted_price(power: Column | float) -> Column:
    """Unit price of a candidate as of the target's time, level and size.

    Asks take the asking ratio, recorded sales the time factor; a sale without an index keeps its raw price, and its size.
    """
    listing = F.col("c_set") == "listing"
    exponent = F.lit(power) if isinstance(power, float) else power
    size = F.when((F.col("c_area") > 0) & (F.col("t_area") > 0), F.pow(F.col("c_area") / F.col("t_area"), exponent)).otherwise(1.0)
    ratio = F.when(F.col("c_ratio") > 0, F.col("c_ratio")).otherwise(1.0)
    return F.col("c_price") * F.when(listing, ratio * size).when(F.col("c_factor") > 0, F.col("c_factor") * size).otherwise(1.0)


# Of a pair whose target has the earliest date beside it, since finding that costs more than the comparison.
IN_TIME = "r_c_date is null or (r_c_date <= t_as_of and r_c_date >= __since)"
SALES, ASKS, OTHER = 0, 1, 2


def _pairs(targets: DataFrame, candidates: DataFrame, radius_m: float, only: Column) -> DataFrame:
    near = within_radius(targets, candidates, radius_m, on=["__kind"], only=only)
    return near.select(*targets.columns, *(F.col(f"r_{c}").alias(c) for c in candidates.columns if c not in ("lat", "lng", "__kind")), "distance_m").filter("c_id <> target_id")


def _least_weights(targets: DataFrame, candidates: DataFrame, s: comps.Selection) -> DataFrame:
    """target_id, __kind, __bound: a weight that the best ``cap`` comparables of a kind reach, where the first tier is full close by.

    What lies close by and is of the first tier fills that tier alone, so whatever weighs less than its last row is not chosen.
    """
    pairs = _pairs(targets, candidates, s.radii_m[0] * CLOSE_PARTS[0], F.expr(IN_TIME) & comps.fits(s, 0, "r_c_area", "r_c_market"))
    rows = pairs.select("target_id", "__kind", comps.weight(s).alias("weight")).filter("weight > 0")
    full = max(s.cap, s.least)
    turn = F.row_number().over(Window.partitionBy("target_id", "__kind").orderBy(F.desc("weight")))
    last = rows.withColumn("rank", turn).filter(F.col("rank") <= full).filter(F.col("rank") == full)
    return last.select("target_id", "__kind", (F.col("weight") * (1 - 1e-9)).alias("__bound")).filter(F.col("__kind") != OTHER)


def evidence(targets: DataFrame, candidates: DataFrame, s: comps.Selection) -> DataFrame:
    """The comparables of each target: the best of its sales and, chosen for themselves, of its asks; then the best of both.

    targets: target_id, lat, lng, t_*; candidates: c_id, lat, lng, c_*. Sales and asks of one id count once, as sales.
    """
    first, last = targets.agg(comps.since(s, F.min("t_as_of")), F.max("t_as_of")).first()
    candidates = candidates.filter(F.col("c_date").isNull() | F.col("c_date").between(F.lit(first), F.lit(last)))
    candidates = candidates.withColumn("__kind", F.coalesce((F.col("c_set") == "listing").cast("int"), F.lit(OTHER)))
    columns, kinds = targets.columns, F.explode(F.array(*map(F.lit, (SALES, ASKS, OTHER)))).alias("__kind")
    targets = targets.select("*", comps.since(s, F.col("t_as_of")).alias("__since"), kinds)
    newest = candidates.groupBy("__kind").agg(F.when(F.count("c_date") == F.count(F.lit(1)), F.max("c_date")).alias("__newest"))
    bounded = targets.join(_least_weights(targets, candidates, s), ["target_id", "__kind"], "left").join(F.broadcast(newest), "__kind")
    reach = comps.reach_m(s, F.col("__bound"), comps.most_weight(s, F.col("__kind") == ASKS, F.col("__newest")))
    bounded = cut(bounded.withColumn("__reach", reach).drop("__newest"))
    far, nearer, pairs = max(s.radii_m), F.lit(False), None
    for part in CLOSE_PARTS:
        within = F.coalesce(F.col("__reach") <= far * part, F.lit(False)) if part < 1 else F.lit(True)
        found = _pairs(bounded.filter(within & ~nearer), candidates, far * part, F.expr(IN_TIME) & (F.col("__bound").isNull() | comps.fits(s, 0, "r_c_area", "r_c_market")))
        found = found.filter(F.col("__bound").isNull() | (comps.weight(s) >= F.col("__bound"))).select(*columns, *(c for c in found.columns if c not in bounded.columns))
        pairs, nearer = found if pairs is None else pairs.unionByName(found), within
    # dealt by target once; all windows from here on keep to a target
    asks = pairs.withColumn("__ask", F.col("c_set") == "listing").repartition("target_id")
    chosen = comps.select(asks, s, ("target_id", "__ask")).drop("rank")
    sold = F.min("__ask").over(Window.partitionBy("target_id", "c_id"))
    turn = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("weight"), "c_id"))
    both = chosen.withColumn("__only", sold).filter(~F.col("__ask") | F.col("__only"))
    return both.withColumn("rank", turn).filter(F.col("rank") <= s.cap).drop("__ask", "__only")


def _points(x: Column, steps: tuple, over: bool) -> Column:
    out = None
    for bound, points in steps:
        fits = x >= bound if over else x <= bound
        out = F.when(fits, points) if out is None else out.when(fits, points)
    return out.otherwise(0)


def confidence(rcn: Column, indexed: Column, recent: Column, same_building: Column, spread_pct: Column) -> tuple[Column, Column]:
    """(points, level): how many sales, of the building itself, by how much adjusted, how recent and how far apart."""
    share = F.when(rcn > 0, indexed / rcn).otherwise(0.0)
    points = F.least(F.lit(MOST_RCN_POINTS), rcn * RCN_POINTS) + F.when(same_building > 0, BUILDING_POINTS).otherwise(0)
    points = points + _points(share, ADJUSTED_STEPS, True) + _points(spread_pct, SPREAD_STEPS, False) + _points(recent, RECENT_STEPS, True)
    points = F.when(rcn == 0, F.least(points, F.lit(ASKING_ONLY))).otherwise(points)
    return points, F.when(points >= LEVELS[0][0], LEVELS[0][1]).when(points >= LEVELS[1][0], LEVELS[1][1]).otherwise("low")


def discount_guard(offer: Column, fair: Column, n: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(discount in per cent, why it isn't plausible or null)."""
    pct = F.when((offer > 0) & (fair > 0), (offer / fair - 1) * 100)
    wide = (F.greatest(high, fair) - F.least(low, fair)) / fair > WIDE_SPREAD
    return pct, F.when(pct <= -DISCOUNT_PCT, F.when(n < FEW_COMPS, "discount_few_comps").when(wide, "discount_wide_spread"))


def _questions(targets: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target_id, t_offer, __first; the targets to ask for): targets that differ by key and offer only have one answer, unless they are candidates themselves."""
    said = [c for c in targets.columns if c not in ("target_id", "t_offer")]
    own = candidates.select(F.col("c_id").alias("__own")).distinct()
    rows = targets.join(own, F.col("target_id") == F.col("__own"), "left").withColumn("__said", F.struct(*said, "__own")).select("target_id", "t_offer", "__said")
    first = cut(rows.groupBy("__said").agg(F.min("target_id").alias("__first")))
    return rows.join(first, "__said").drop("__said"), first.select(F.col("__first").alias("target_id"), *(F.col("__said")[c].alias(c) for c in said))


def sale_estimates(targets: DataFrame, candidates: DataFrame, s: comps.Selection = comps.Selection(), power: float = 0.0, least: int = 3) -> DataFrame:
    """A row for every target: fair, low, high, spread and discount in per cent, guard, confidence, counts and the median age of
    its comparables in years; without enough of these the reason instead.

    What is grouped is at most ``cap`` rows a target.
    """
    targets, asked = _questions(targets, candidates)
    chosen = evidence(asked, candidates, s).withColumn("__price", converted_price(power))
    sale, age = F.col("c_set") != "listing", F.unix_timestamp("t_as_of") - F.unix_timestamp("c_date")
    g = chosen.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sale).alias("rcn"), F.count_if(sale & F.col("c_factor").isNotNull()).alias("indexed"), F.count_if(F.col("c_set") == "building").alias("same_building"),
        F.count_if(sale & (age <= 365 * 86400)).alias("recent"), F.round(stats.median(F.greatest(F.lit(0), age) / (365 * 86400)), 1).alias("age_years"),
        F.collect_list(F.struct(F.col("__price").cast("double").alias("value"), F.col("weight").cast("double").alias("weight"))).alias("__pairs"),
    )
    quartiles = {f"__q{p}": stats.weighted_quantile_of(F.col("__pairs"), p / 100) for p in (25, 50, 75)}
    g = targets.select("target_id", "t_offer", "__first").join(g.withColumns(quartiles).withColumnRenamed("target_id", "__first"), "__first", "left")
    enough = F.coalesce(F.col("n") >= least, F.lit(False))
    g = g.withColumns({"fair": F.when(enough, F.col("__q50")), "low": F.when(enough, F.least("__q25", "__q50")), "high": F.when(enough, F.greatest("__q75", "__q50"))})
    spread = (F.col("high") - F.col("low")) / F.col("fair") * 100
    pct, why = discount_guard(F.col("t_offer"), F.col("fair"), F.col("n"), F.col("low"), F.col("high"))
    points, level = confidence(F.col("rcn"), F.col("indexed"), F.col("recent"), F.col("same_building"), spread)
    return g.select(
        "target_id", F.coalesce("n", F.lit(0)).alias("n"), "fair", "low", "high", spread.alias("spread_pct"), pct.alias("over_pct"), why.alias("guard"),
        F.when(enough, points).alias("points"), F.when(enough, level).alias("confidence"), F.when(enough, F.col("rcn")).alias("rcn"), F.when(enough, F.col("age_years")).alias("age_years"),
        F.when(~enough, "insufficient_comps").alias("reason"),
    )
