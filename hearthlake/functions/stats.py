"""Statistics whose definitions differ between callers; none stands in for another.

Aggregates skip null, NaN and infinite values; an empty set gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, few

HUBER_K = 1.345
TRIM = 0.1
OCTAVE = 256  # buckets that a doubling spans
CELLS = 1 << 16


def finite(x: Column) -> Column:
    """x, or null where it isn't a finite number."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def quantile(x: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p, of groups known to be small: a buffer holds all distinct values."""
    return F.percentile(finite(x), F.lit(min(1.0, max(0.0, p))))


def median(x: Column) -> Column:
    return quantile(x, 0.5)


def bucket(v: Column) -> Column:
    """Rises with v; numbers of one bucket differ by less than 1/``OCTAVE`` of an octave of 1 + |v|."""
    return F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * OCTAVE)


def ranked(df: DataFrame, keys: list[str], x: Column, goals: dict[str, Callable[[Column], Column]], times: Column | None = None, empty: bool = False, copies: Column | None = None) -> DataFrame:
    """keys, n, rows and a column for each goal: the first of a group's sorted values whose running sum of ``times`` (1) reaches goal(n).

    n is the sum over finite values, rows the number of all rows; groups without a finite value are left out unless ``empty``. A row can stand for
    several equal ones (``copies``), which count in both.

    Exact for groups of any size without sorting a group in one task. Equal values are summed before the shuffle. Sums by bucket (at
    most some 500,000 of a group) tell in which one each goal lies; the values of that bucket alone are dealt to ``CELLS`` equal cells, and
    only those of the cell with the goal are put in order.
    """
    k = F.struct(*keys) if keys else F.struct(F.lit(0).alias("__all"))
    one = F.lit(1).cast("long") if copies is None else copies
    v = df.select(k.alias("__k"), finite(x.cast("double")).alias("__v"), (one if times is None else times).alias("__c"), one.alias("__rows"))
    v = v.groupBy("__k", "__v").agg(F.sum(F.when(F.col("__v").isNotNull() & (F.col("__c") > 0), F.col("__c"))).alias("__c"), F.sum("__rows").alias("__rows"))

    def running(sums: DataFrame, by: list[str], order: str) -> DataFrame:
        run = F.sum("__c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("__run", run)
        return sums.withColumn("__before", F.lag("__run").over(Window.partitionBy(*by).orderBy(order)))

    sums = v.groupBy("__k", bucket(F.col("__v")).alias("__b")).agg(F.sum("__c").alias("__c"), F.sum("__rows").alias("__rows"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    group = Window.partitionBy("__k")
    sums = running(sums, ["__k"], "__b").withColumn("n", F.max("__run").over(group)).withColumn("rows", F.sum("__rows").over(group))
    run, before = F.col("__run"), F.col("__before")
    hits = [F.when((run >= goal(F.col("n"))) & (before.isNull() | (before < goal(F.col("n")))), F.struct(F.lit(name).alias("place"), goal(F.col("n")).cast("double").alias("goal"))) for name, goal in goals.items()]
    nothing = F.when(F.col("__b").isNull() & F.col("n").isNull(), F.struct(F.lit("").alias("place"), F.lit(0.0).alias("goal")))
    at = sums.withColumn("__at", F.explode(F.array_compact(F.array(*hits, nothing)))).select("__k", "n", "rows", "__at.place", "__at.goal", F.coalesce(before, F.lit(0)).alias("__ahead"), "__lo", "__hi")

    part = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * (CELLS - 1))).otherwise(0)
    near = v.filter("__v is not null").select("__k", "__v", "__c").join(at, "__k").filter(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    cells = near.groupBy("__k", "place", "goal", "__ahead", part.alias("__cell")).agg(F.sum("__c").alias("__c"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
    reached = F.col("__ahead") + F.col("__run") >= F.col("goal")
    cells = running(cells, ["__k", "place"], "__cell").withColumn("__last", F.max("__run").over(Window.partitionBy("__k", "place")))
    first = (reached | (F.col("__run") == F.col("__last"))) & (F.col("__before").isNull() | (F.col("__ahead") + F.col("__before") < F.col("goal")))
    cells = cells.filter(first).select("__k", "place", "goal", (F.col("__ahead") + F.coalesce("__before", F.lit(0))).alias("__ahead"), "__from", "__to")
    last = v.filter("__v is not null").select("__k", "__v", "__c").join(cells, "__k").filter(F.col("__v").between(F.col("__from"), F.col("__to")))
    last = running(last, ["__k", "place"], "__v").groupBy("__k", "place").agg(F.coalesce(F.min(F.when(reached, F.col("__v"))), F.max("__v")).alias("__v"))
    values = last.groupBy("__k").agg(*(F.max(F.when(F.col("place") == name, F.col("__v"))).alias(name) for name in goals))
    totals = at.groupBy("__k").agg(F.max("n").alias("n"), F.max("rows").alias("rows"))
    out = totals.join(values, "__k", "left" if empty else "inner")
    return out.select(*([f"__k.{c}" for c in keys]), F.coalesce("n", F.lit(0)).alias("n"), "rows", *goals)


def quantiles(df: DataFrame, keys: list[str], x: Column, at: dict[str, float], empty: bool = False, copies: Column | None = None) -> DataFrame:
    """keys, n, rows and a column for each: quantile()s by linear interpolation, for groups of any size."""
    place = lambda p, n: (n - 1) * F.lit(min(1.0, max(0.0, p)))
    goals = {f"{name}__{side}": lambda n, p=p, turn=turn: turn(place(p, n)) + 1 for name, p in at.items() for side, turn in (("low", F.floor), ("high", F.ceil))}
    g = ranked(df, keys, x, goals, empty=empty, copies=copies)
    between = {name: F.col(f"{name}__low") + (F.col(f"{name}__high") - F.col(f"{name}__low")) * (place(p, F.col("n")) - F.floor(place(p, F.col("n")))) for name, p in at.items()}
    return g.select(*keys, "n", "rows", *(c.alias(name) for name, c in between.items()))


def order_statistic(df: DataFrame, keys: list[str], x: Column, at: Callable[[Column], Column], name: str, times: Column | None = None) -> DataFrame:
    """keys, name, n: the value at place ``at(n)``, from 0, of a group's n sorted values, each counted ``times`` (once); without keys there is one row always."""
    found = ranked(df, keys, x, {name: lambda n: at(n) + 1}, None if times is None else times.cast("long")).select(*keys, name, "n")
    return found if keys else found.agg(F.max(name).alias(name), F.max("n").alias("n"))


def upper_medians(df: DataFrame, keys: list[str], x: Column, name: str) -> DataFrame:
    """The value at floor(n / 2) of the sorted values."""
    return order_statistic(df, keys, x, lambda n: F.floor(n / 2), name)


def floor_quantiles(df: DataFrame, keys: list[str], x: Column, p: float, name: str) -> DataFrame:
    """The value at floor(p (n - 1)) of the sorted values."""
    return order_statistic(df, keys, x, lambda n: F.floor((n - 1) * F.lit(p)), name)


def half_up(x: Column) -> Column:
    """Rounds halves up, towards positive infinity."""
    return F.floor(x + 0.5)


def weighted_quantile_of(pairs: Column, p: float) -> Column:
    """pairs: array<struct<value, weight>>. The first value whose cumulative weight reaches p of the total."""
    good = F.sort_array(F.filter(pairs, lambda e: finite(e["value"]).isNotNull() & finite(e["weight"]).isNotNull() & (e["weight"] > 0)))
    total = F.aggregate(good, F.lit(0.0), lambda s, e: s + e["weight"])
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("hit"), (total * p).alias("goal"))  # the total once, not for each entry

    def step(s: Column, e: Column) -> Column:
        run = s["run"] + e["weight"]
        return F.struct(run.alias("run"), F.when(s["hit"].isNull() & (run >= s["goal"]), e["value"]).otherwise(s["hit"]).alias("hit"), s["goal"].alias("goal"))

    return F.aggregate(good, start, step, lambda s: s["hit"])


def weighted_quantile(x: Column, weight: Column, p: float) -> Column:
    """weighted_quantile_of the rows of a group that is known to be small."""
    return weighted_quantile_of(F.collect_list(F.struct(x.cast("double").alias("value"), weight.cast("double").alias("weight"))), p)


def weighted_quantiles(df: DataFrame, keys: list[str], x: Column, weight: Column, p: float, name: str) -> DataFrame:
    """The same for groups of any size."""
    return ranked(df, keys, x, {name: lambda total: total * p}, finite(weight.cast("double"))).select(*keys, name)


def js_weighted_quantile(values: np.ndarray, weights: np.ndarray, p: float) -> float | None:
    good = np.isfinite(values) & np.isfinite(weights) & (weights > 0)
    v, w = values[good], weights[good]
    if not len(v):
        return None
    order = np.argsort(v, kind="stable")
    run = np.cumsum(w[order])
    return float(v[order][min(len(v) - 1, int(np.searchsorted(run, p * run[-1], "left")))])


def robust_price(values: np.ndarray, weights: np.ndarray, areas: np.ndarray | None, metric: str) -> float | None:
    """One price of many: weighted_median (also the default), median, mean, area_weighted_median, trimmed_mean or huber."""
    good = np.isfinite(values) & (values > 0) & np.isfinite(weights) & (weights > 0)
    v, w = values[good], weights[good]
    if not len(v):
        return None
    if len(v) == 1:
        return float(v[0])
    if metric == "mean":
        return float(v.mean())
    if metric == "median":
        return js_weighted_quantile(v, np.ones(len(v)), 0.5)
    if metric == "area_weighted_median":
        a = np.ones(len(v)) if areas is None else areas[good]
        return js_weighted_quantile(v, np.where(np.isfinite(a) & (a > 0), a, 1.0), 0.5)
    if metric == "trimmed_mean":
        order, cut = np.argsort(v, kind="stable"), int(len(v) * TRIM)
        keep = order[cut : len(v) - cut]
        return float(np.average(v[keep], weights=w[keep]))
    center = js_weighted_quantile(v, w, 0.5)
    if metric != "huber":
        return center
    scale = HUBER_K * 1.4826 * float(np.sort(np.abs(v - center))[len(v) // 2])
    if not scale > 0:
        return center
    now = center
    for _ in range(20):
        away = np.abs(v - now)
        new = float(np.average(v, weights=w * np.where(away <= scale, 1.0, scale / np.maximum(away, scale))))
        if abs(new - now) <= 1e-6 * max(1.0, now):
            return new
        now = new
    return now


def huber_prices(df: DataFrame, keys: list[str], x: Column, weight: Column, name: str = "price", rounds: int = 20, at_once: int = 4) -> DataFrame:
    """robust_price's huber for groups of any size: a round is one join with a row a group and one sum over equal values.

    Equal values are summed once and cut off in the shared folder, dealt by group. Each ``at_once`` rounds the groups' state is cut
    off too, and the rounds end when all groups have settled; a group that has settled stays as it is.
    """
    rows = df.select(*(F.col(k).alias(k) for k in keys), finite(x.cast("double")).alias("v"), finite(weight.cast("double")).alias("w")).filter("v > 0 and w > 0")
    rows = cut(rows.groupBy(*keys, "v").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("c")))
    center = cut(weighted_quantiles(rows, keys, F.col("v"), F.col("w"), 0.5, "now"))
    small = few(center)
    beside = lambda state: rows.join(F.broadcast(state) if small else state, keys).withColumn("away", F.abs(F.col("v") - F.col("now")))
    spread = order_statistic(beside(center), keys, F.col("away"), lambda n: F.floor(n / 2), "mad", F.col("c"))
    state = center.join(spread, keys).select(*keys, "now", (F.col("mad") * (HUBER_K * 1.4826)).alias("scale"), ((F.col("mad") <= 0) | (F.col("n") == 1)).alias("settled"))
    for done in range(rounds):
        if done % at_once == 0:
            state = cut(state)
            if state.filter(~F.col("settled")).isEmpty():
                break
        share = F.col("w") * F.when(F.col("away") <= F.col("scale"), 1.0).otherwise(F.col("scale") / F.col("away"))
        moved = beside(state).groupBy(*keys, "now", "scale", "settled").agg((F.sum(F.col("v") * share) / F.sum(share)).alias("new"))
        near = F.abs(F.col("new") - F.col("now")) <= 1e-6 * F.greatest(F.lit(1.0), F.col("now"))
        state = moved.select(*keys, F.when(F.col("settled"), F.col("now")).otherwise(F.col("new")).alias("now"), "scale", (F.col("settled") | near).alias("settled"))
    return state.select(*keys, F.col("now").alias(name))


def elasticity(price: Column, area: Column, least: int = 50) -> list[Column]:
    """Of ln price on ln area: minus the slope, r2 and n; null slope and r2 below ``least`` rows."""
    y, x = F.ln(price), F.ln(area)
    n = F.regr_count(y, x)
    return [F.when(n >= least, -F.regr_slope(y, x)).alias("beta"), F.when(n >= least, F.regr_r2(y, x)).alias("r2"), n.alias("n")]
