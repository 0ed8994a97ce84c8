"""How well estimators of a unit price would have met past sales: a sample is held out and estimated from what was known before.

The sample is the rows of the smallest hashes of their key, so it is the same whatever the partitioning. Candidates come from one radius join
with the sample; a held-out sale sees no later sale, none of its own building and none of its own parcel. What is grouped is at most
``cap`` comparables a target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..shared import cut
from . import comps
from .spatial import within_radius

METRICS = ("weighted_median", "median", "mean", "area_weighted_median", "trimmed_mean", "huber")
LEAST = 3


def held_out(sales: DataFrame, key: str, most: int, seed: str = "holdout") -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes."""
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return sales.withColumn("__mark", mark).orderBy("__mark", key).limit(most).drop("__mark")


def known_before(targets: DataFrame, sales: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of a target and an earlier sale around it, as comps.select takes them. Targets are a sample, so the sales stay where they are read.

    sales: id, lat, lng, date, price_m2, area_m2, rooms, market, kind, building, parcel, factor (to the target's time; null: unknown); targets: the same.
    """
    t = targets.select(
        F.col("id").alias("target_id"), "lat", "lng", F.col("date").alias("t_as_of"), F.col("area_m2").alias("t_area"), F.col("rooms").alias("t_rooms"), F.col("market").alias("t_market"), F.col("kind").alias("t_kind"), F.col("price_m2").alias("actual"),
        F.col("building").alias("t_building"), F.col("parcel").alias("t_parcel"),
    )
    c = sales.select("id", "lat", "lng", "date", "price_m2", "area_m2", "rooms", "market", "building", "parcel", "factor")
    apart = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) != F.col(b))
    pairs = within_radius(F.broadcast(t), c, radius_m).filter((F.col("r_id") != F.col("target_id")) & (F.col("r_date") <= F.col("t_as_of")) & apart("t_building", "r_building") & apart("t_parcel", "r_parcel"))
    names = {"id": "c_id", "date": "c_date", "price_m2": "c_price", "area_m2": "c_area", "rooms": "c_rooms", "market": "c_market", "factor": "c_factor"}
    return pairs.select("target_id", "t_as_of", "t_area", "t_rooms", "t_market", "t_kind", "actual", "distance_m", *(F.col(f"r_{a}").alias(b) for a, b in names.items()), F.lit("rcn").alias("c_set"), F.lit(None).cast("double").alias("c_ratio"))


def estimates(chosen: DataFrame, value: Column, metrics: tuple[str, ...] = METRICS, least: int = LEAST) -> DataFrame:
    """target_id, metric, predicted, n: one price of each target's comparables by every estimator; none below ``least`` comparables."""
    rows = chosen.select("target_id", value.cast("double").alias("v"), F.col("weight").cast("double").alias("w"), F.col("c_area").cast("double").alias("a"), "c_id").filter("v > 0 and w > 0")
    lists = rows.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("c_id", "v", "w", "a"))).alias("rows")).filter(F.size("rows") >= least)
    lists = lists.select("target_id", F.col("rows.v").alias("v"), F.col("rows.w").alias("w"), F.col("rows.a").alias("a"))
    kind = dict(lists.dtypes)["target_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(key, m, stats.robust_price(np.asarray(v, float), np.asarray(w, float), np.asarray(a, float), m), len(v)) for key, v, w, a in frame.itertuples(index=False) for m in metrics]
            yield pd.DataFrame(made, columns=["target_id", "metric", "predicted", "n"])

    return lists.mapInPandas(run, f"target_id {kind}, metric string, predicted double, n long")


def summary(estimated: DataFrame, targets: DataFrame, by: str = "metric") -> DataFrame:
    """A row for each estimator: n, no_estimate_pct, and of the relative error in per cent mape, med_ape, rmse, within10, within20, mean_bias, median_bias; mae."""
    actual = targets.select(F.col("id").alias("target_id"), F.col("price_m2").alias("actual"))
    total = targets.count()
    e = estimated.join(actual, "target_id").withColumn("err", F.col("predicted") / F.col("actual") - 1).filter("actual > 0")
    off = F.abs("err")
    share = lambda most: F.avg(F.when(off <= most, 100.0).otherwise(0.0))
    g = e.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(off) * 100).alias("mape"), (F.sqrt(F.avg(F.col("err") * F.col("err"))) * 100).alias("rmse"), share(0.1).alias("within10"), share(0.2).alias("within20"), (F.avg("err") * 100).alias("mean_bias"),
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"),
    )
    half = {"x": lambda n: n * 0.5}
    g = g.join(stats.ranked(e, [by], off, half).select(by, (F.col("x") * 100).alias("med_ape")), by).join(stats.ranked(e, [by], F.col("err"), half).select(by, (F.col("x") * 100).alias("median_bias")), by)
    return g.withColumn("no_estimate_pct", (F.lit(total) - F.col("n")) * 100.0 / F.lit(max(total, 1)))


def backtest(sales: DataFrame, most: int, selection: comps.Selection, power: float = 0.0, metrics: tuple[str, ...] = METRICS, seed: str = "holdout") -> DataFrame:
    """The summary of all estimators over a sample of the sales. The sample and its estimates are cut off, as several columns need them."""
    targets = cut(held_out(sales, "id", most, seed))
    chosen = comps.select(known_before(targets, sales, max(selection.radii_m)), selection)
    size = F.pow(F.col("c_area") / F.greatest("t_area", F.lit(1e-6)), F.lit(power))
    unknown = F.when(F.col("c_factor").isNull(), 0.7).otherwise(1.0)
    return summary(cut(estimates(chosen.withColumn("weight", F.col("weight") * unknown), F.col("c_price") * F.coalesce("c_factor", F.lit(1.0)) * size, metrics)), targets)
