"""Short-term rental calendars: runs of closed nights, occupancy by month and weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONG_RUN, LONG_TAIL, SHORT_HEAD = 45, 45, 14


def runs(days: DataFrame, item: str, date: str, open_: str) -> DataFrame:
    """days with run (a number for each stretch of equal ``open_`` in date order), its length and whether it touches an end.

    A missing date doesn't break a run.
    """
    w = Window.partitionBy(item).orderBy(date)
    whole = Window.partitionBy(item)
    changed = F.when(F.col(open_) == F.lag(open_).over(w), 0).otherwise(1)
    out = days.withColumn("run", F.sum(changed).over(w)).withColumn("__nr", F.row_number().over(w)).withColumn("__all", F.count(F.lit(1)).over(whole))
    run = Window.partitionBy(item, "run")
    out = out.withColumn("run_nights", F.count(F.lit(1)).over(run))
    return out.withColumn("at_start", F.min("__nr").over(run) == 1).withColumn("at_end", F.max("__nr").over(run) == F.col("__all")).drop("__nr", "__all")


def classified(days: DataFrame, item: str, date: str, open_: str) -> DataFrame:
    """days with class: available, booked or blocked (by the owner)."""
    n = F.col("run_nights")
    closed = (
        F.when(F.col("at_start") & F.col("at_end"), "blocked")
        .when(n > LONG_RUN, "blocked")
        .when(F.col("at_end"), F.when(n > LONG_TAIL, "blocked").otherwise("booked"))
        .when(F.col("at_start"), F.when(n <= SHORT_HEAD, "booked").otherwise("blocked"))
        .otherwise("booked")
    )
    return runs(days, item, date, open_).withColumn("class", F.when(F.col(open_), "available").otherwise(closed))


def occupancy(days: DataFrame, item: str, date: str, open_: str, price: str, weekly: bool = False) -> DataFrame:
    """By item and month (or weekday, Monday 0): nights by class, rate of booked ones, average price of open ones."""
    key = F.weekday(F.col(date)).alias("weekday") if weekly else F.date_format(F.col(date), "yyyy-MM").alias("month")
    c = F.col("class")
    aggs = [F.count(F.lit(1)).alias("sample_days"), F.count_if(c == "booked").alias("booked_nights"), F.count_if(c == "available").alias("available_nights"), F.avg(F.when(F.col(open_), F.col(price))).alias("avg_price")]
    if not weekly:
        aggs += [F.count_if(c == "blocked").alias("blocked_nights"), (F.count_if(c == "booked") / F.count(F.lit(1))).alias("occupancy_rate")]
    return classified(days, item, date, open_).groupBy(item, key).agg(*aggs)


def monthly_prices(seen: DataFrame, item: str, date: str, price: str, open_: str) -> DataFrame:
    """All price configurations of a month pooled."""
    return seen.groupBy(item, F.date_format(F.col(date), "yyyy-MM").alias("month")).agg(
        F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col(open_)).alias("booked")
    )


def nights(stays: DataFrame, start: str, end: str) -> DataFrame:
    """One row a night of [start, end)."""
    return stays.filter(F.col(end) > F.col(start)).withColumn("night", F.explode(F.sequence(F.col(start), F.date_sub(F.col(end), 1))))
