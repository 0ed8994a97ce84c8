"""Stratified medians, chain-linked price indices and time adjustment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.time import quarter
from ..shared import cut

LEAST_PERIOD, LEAST_BAND = 8, 3
LOW_LINK, HIGH_LINK = 0.5, 2.0

# Area bands and validity of the three kinds: (upper cut, name), last open; (area range, unit price range).
BANDS = {
    "flat": ((35, "a<35"), (60, "b35-60"), (90, "c60-90"), (130, "d90-130"), (None, "e130+")),
    "house": ((100, "a<100"), (160, "b100-160"), (250, "c160-250"), (None, "d250+")),
    "plot": ((800, "a<800"), (2000, "b800-2000"), (5000, "c2000-5000"), (None, "d5000+")),
}
VALID = {"flat": ("unit", (10, 250), (500, 60000)), "house": ("building", (20, 2000), (100, 40000)), "plot": ("parcel", (50, 100000), (0.01, 20000))}


def band_of(kind: str, area: Column) -> Column:
    out = None
    for upper, name in BANDS[kind][:-1]:
        out = F.when(area < upper, name) if out is None else out.when(area < upper, name)
    return out.otherwise(BANDS[kind][-1][1])


def segmented(tx: DataFrame, kind: str = "kind", area: str = "area_m2", price: str = "price_per_m2", market: str = "market") -> DataFrame:
    """tx once for each segment that it is in: the three kinds, and new or second-hand flats.

    One scan with an exploded array; segments overlap, so a union would read tx five times.
    """
    ok = {s: (F.col(kind) == k) & F.col(area).between(*a) & F.col(price).between(*p) for s, (k, a, p) in VALID.items()}
    made = [(s, ok[s], s) for s in VALID] + [("flat_primary", ok["flat"] & (F.col(market) == 1), "flat"), ("flat_secondary", ok["flat"] & (F.col(market) == 2), "flat")]
    entries = F.array(*(F.when(cond, F.struct(F.lit(s).alias("segment"), band_of(k, F.col(area)).alias("band"))) for s, cond, k in made))
    return tx.withColumn("__s", F.explode(F.array_compact(entries))).select("*", "__s.segment", "__s.band").drop("__s")


def _counted(rows: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """keys, period, __value, __rows: equal values with their number, cut off, as exact medians read their values three times."""
    return cut(rows.select(*keys, quarter(F.col(ts)).alias("period"), F.col(value).alias("__value")).groupBy(*keys, "period", "__value").agg(F.count(F.lit(1)).alias("__rows")))


def stratified_medians(rows: DataFrame, keys: list[str], ts: str, value: str, band: str = "band") -> DataFrame:
    """keys, period, band, band_median, band_n, overall_median, overall_n.

    Each row counts for its band and for the whole period, so that both medians come from one count of equal values.
    """
    levels = F.array(F.struct(F.lit(1).alias("of"), F.col(band).alias(band)), F.struct(F.lit(0).alias("of"), F.lit(None).cast("string").alias(band)))
    spread = _counted(rows, [*keys, band], ts, value).select(*keys, "period", F.explode(levels).alias("__at"), "__value", "__rows").select(*keys, "period", "__at.of", f"__at.{band}", "__value", "__rows")
    found = stats.quantiles(spread, [*keys, "period", "of", band], F.col("__value"), {"middle": 0.5}, empty=True, copies=F.col("__rows"))
    by_band = found.filter("of = 1").select(*keys, "period", band, F.col("middle").alias("band_median"), F.col("rows").alias("band_n"))
    whole = found.filter("of = 0").select(*keys, "period", F.col("middle").alias("overall_median"), F.col("rows").alias("overall_n"))
    return by_band.join(whole, [*keys, "period"])


def period_medians(rows: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """keys, period, overall_median, overall_n, without the bands."""
    found = stats.quantiles(_counted(rows, keys, ts, value), [*keys, "period"], F.col("__value"), {"middle": 0.5}, empty=True, copies=F.col("__rows"))
    return found.select(*keys, "period", F.col("middle").alias("overall_median"), F.col("rows").alias("overall_n"))


def observations(medians: DataFrame, keys: list[str], band: str = "band") -> DataFrame:
    """One row per series and period with its strata; periods without a positive median are dropped."""
    g = medians.groupBy(*keys, "period").agg(
        F.max("overall_median").alias("overall_median"), F.max("overall_n").alias("overall_n"),
        F.collect_list(F.struct(F.col(band).alias("band"), F.col("band_median").alias("median"), F.col("band_n").alias("n"))).alias("strata"),
    )
    return g.filter((F.col("overall_median") > 0) & (F.col("overall_n") > 0))


def chain(series: list[dict]) -> list[tuple[str, float]]:
    """(period, index value) of one series. Links go to the last accepted period.

    A link is the weighted median of the ratios over bands that both periods have in number, else the
    ratio of the overall medians; links outside (0.5, 2) are skipped and leave a gap.
    """
    import numpy as np

    out: list[tuple[str, float]] = []
    held: dict | None = None
    for now in sorted(series, key=lambda o: o["period"]):
        if now["overall_n"] < LEAST_PERIOD or not now["overall_median"] > 0:
            continue
        if held is None:
            level = 100.0
        else:
            before = {s["band"]: s for s in held["strata"]}
            pairs = [
                (s["median"] / b["median"], min(s["n"], b["n"]))
                for s in now["strata"]
                if (b := before.get(s["band"])) and b["median"] > 0 and s["n"] >= LEAST_BAND and b["n"] >= LEAST_BAND
            ]
            link = stats.js_weighted_quantile(np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float), 0.5)
            link = now["overall_median"] / held["overall_median"] if link is None else link
            if not LOW_LINK < link < HIGH_LINK:
                continue
            level *= link
        out.append((now["period"], level))
        held = now
    return out


def chain_index(obs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, period, index_value, median, n. A series has one row a quarter, so a group stays small."""
    types = dict(obs.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        points = dict(chain(rows[["period", "overall_median", "overall_n", "strata"]].to_dict("records")))
        rows = rows[rows["period"].isin(points)]
        rows = rows.assign(index_value=[points[p] for p in rows["period"]])
        return rows[[*keys, "period", "index_value", "overall_median", "overall_n"]].rename(columns={"overall_median": "median", "overall_n": "n"})

    return obs.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", period string, index_value double, median double, n long")


def time_factor(items: DataFrame, series: DataFrame, keys: list[str], period: str, as_of: str) -> DataFrame:
    """items with from_index, to_index and factor: the last point up to as_of over the last point up to the item's period.

    As-of join by aggregation: points are few per series, so each series becomes one sorted array that is
    joined once; before its first point an item takes the first.
    """
    points = series.filter((F.col("index_value") > 0) & (F.col("n") > 0) & (F.col("period") <= as_of)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("period", "index_value"))).alias("points")
    )
    joined = items.join(points, keys, "left")
    upto = F.filter("points", lambda p: p["period"] <= F.col(period))
    start = F.when(F.size(upto) > 0, F.try_element_at(upto, F.lit(-1))["index_value"]).otherwise(F.get("points", F.lit(0))["index_value"])
    out = joined.withColumn("from_index", start).withColumn("to_index", F.try_element_at("points", F.lit(-1))["index_value"])
    return out.withColumn("factor", F.try_divide("to_index", "from_index")).drop("points")


def guard_factor(narrow: Column, wide: Column, weight: Column) -> tuple[Column, Column]:
    """(factor, weight): a narrow factor over 1.5 times off the wide one gives way at half weight; none at all costs 0.3."""
    ratio = F.try_divide(narrow, wide)
    off = (ratio > 1.5) | (ratio < 1 / 1.5)
    factor = F.when(narrow.isNull() | off, F.coalesce(wide, narrow)).otherwise(narrow)
    return F.coalesce(factor, F.lit(1.0)), weight * F.when(factor.isNull(), 0.7).when(off, 0.5).otherwise(1.0)
