"""Dashboard series: grouped aggregates over transactions, listings and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.time import month

PRICE_BAND = (500.0, 40_000.0)


def banded(value: Column, cuts: list[float], names: list[str]) -> Column:
    """names[k] for the first cut above value, the last name beyond all."""
    out = None
    for c, n in zip(cuts, names, strict=False):
        out = F.when(value < c, n) if out is None else out.when(value < c, n)
    return F.when(value.isNotNull(), out.otherwise(names[-1]))


def monthly_average(df: DataFrame, ts: str, value: str, since: Column | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """month, avg_value, n of the rows since a time and within a price band."""
    if since is not None:
        df = df.filter(F.col(ts) >= since)
    if band:
        df = df.filter(F.col(value).between(*band))
    return df.groupBy(month(F.col(ts)).alias("month")).agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("n"))


def year_on_year(df: DataFrame, key: str, ts: str, value: str, as_of: Column, least: int = 10, most_pct: float = 200.0) -> DataFrame:
    """key, recent, prior, growth_pct, n: averages of the last 365 days against the 365 before, one pass."""
    cut = as_of - F.expr("interval 365 days")
    rows = df.filter((F.col(ts) >= as_of - F.expr("interval 730 days")) & (F.col(ts) <= as_of))
    new = F.col(ts) >= cut
    g = rows.groupBy(key).agg(
        F.avg(F.when(new, F.col(value))).alias("recent"), F.avg(F.when(~new, F.col(value))).alias("prior"),
        F.count_if(new).alias("n"), F.count_if(~new).alias("n_prior"),
    )
    growth = (F.col("recent") / F.nullif("prior", F.lit(0.0)) - 1) * 100
    return g.withColumn("growth_pct", growth).filter((F.col("n") >= least) & (F.col("n_prior") >= least) & (F.abs("growth_pct") <= most_pct))


def two_sides(df: DataFrame, key: Column, side: Column, value: str, sides: tuple, least: int = 5) -> DataFrame:
    """key, a, b: averages of two sides where both have at least ``least`` rows; conditional sums in one pass."""
    aggs = []
    for name, s in zip(("a", "b"), sides, strict=True):
        aggs += [F.avg(F.when(side == s, F.col(value))).alias(name), F.count_if(side == s).alias(f"n_{name}")]
    return df.groupBy(key.alias("key")).agg(*aggs).filter((F.col("n_a") >= least) & (F.col("n_b") >= least))


def price_drops(history: DataFrame, item: str, place: str, ts: str, price: str, since: Column, least: int = 5) -> DataFrame:
    """place, items, dropped, share: items seen since a time whose lowest price is under their highest."""
    per = history.groupBy(item).agg(F.min(price).alias("low"), F.max(price).alias("high"), F.max(ts).alias("last"), F.any_value(place).alias("place"))
    per = per.filter(F.col("last") >= since)
    out = per.groupBy("place").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("low") < F.col("high")).alias("dropped"))
    return out.filter(F.col("items") >= least).withColumn("share", F.col("dropped") / F.col("items"))


def histogram(df: DataFrame, value: Column, tops: list[float]) -> DataFrame:
    """bucket, n: disjoint buckets with upper ends (the last is open); empty ones count 0."""
    spark = df.sparkSession
    k = F.size(F.filter(F.array(*(F.lit(t) for t in tops)), lambda t: t <= value))
    found = df.filter(value.isNotNull()).groupBy(k.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    ends = spark.range(len(tops) + 1).select(F.col("id").cast("int").alias("bucket"))
    return F.broadcast(ends).join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """facet, value, n: counts in total and by each column, from one grouping-sets aggregate; null values are left out."""
    names = [F.lit(c) for c in columns]
    own = [df[c] for c in columns]
    g = df.groupingSets([*([c] for c in own), []], *own).agg(F.grouping_id(*own).alias("gid"), F.count(F.lit(1)).alias("n"))
    total = (1 << len(columns)) - 1
    which, value = F.when(F.col("gid") == total, "total"), F.lit(None).cast("string")
    for k, c in enumerate(columns):
        only = F.col("gid") == total - (1 << (len(columns) - 1 - k))
        which, value = which.when(only, names[k]), F.when(only, F.col(c).cast("string")).otherwise(value)
    return g.select(which.alias("facet"), value.alias("value"), "n").filter("facet = 'total' or value is not null")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__turn", turn).filter("__turn = 1").drop("__turn")


def mode_per_key(df: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """key, value, n: the most frequent value, the latest of equal ones, then the smallest."""
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    return latest(n, [key], [F.desc("n"), F.desc("last"), F.asc(value)]).drop("last")


def grid_cells(df: DataFrame, lat: str, lng: str, size: float, who: str, value: str) -> DataFrame:
    """Cells by truncation towards zero: cell_lat, cell_lng, items (distinct), n, avg_value."""
    at = [(F.col(c) / size).cast("long").alias(f"cell_{c}") for c in (lat, lng)]
    return df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).groupBy(*at).agg(F.countDistinct(who).alias("items"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"))


def clusters(df: DataFrame, lat: str, lng: str, size: float, source: str) -> DataFrame:
    """Map clusters: count, centroid and dominant source (the smallest of equal ones) of each cell."""
    at = [(F.col(c) / size).cast("long").alias(f"cell_{c}") for c in (lat, lng)]
    part = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).groupBy(*at, source).agg(F.count(F.lit(1)).alias("n"), F.sum(lat).alias("slat"), F.sum(lng).alias("slng"))
    best = F.min_by(source, F.struct(-F.col("n"), F.col(source)))
    g = part.groupBy(f"cell_{lat}", f"cell_{lng}").agg(F.sum("n").alias("n"), F.sum("slat").alias("slat"), F.sum("slng").alias("slng"), best.alias("source"))
    return g.select(f"cell_{lat}", f"cell_{lng}", "n", (F.col("slat") / F.col("n")).alias("lat"), (F.col("slng") / F.col("n")).alias("lng"), "source")


def top_n(df: DataFrame, segment: str, order: list[Column], n: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(segment).orderBy(*order))
    return df.withColumn("rank", turn).filter(F.col("rank") <= n)


def coverage(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Percentage of rows with a value, by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *((F.count(c) * 100.0 / F.count(F.lit(1))).alias(f"pct_{c}") for c in columns))


def district_valuation(df: DataFrame, district: str, side: Column, value: str, sale, rent, least: int = 3, top: int = 15) -> DataFrame:
    """Sale against rent by district: yield, fair value at 5 %, payback in years, ten-year return at 3 %; the best first."""
    g = two_sides(df, F.col(district), side, value, (sale, rent), least)
    year = F.col("b") * 12
    g = g.withColumn("gross_yield", year * 100 / F.col("a")).withColumn("fair", year / 0.05).withColumn("payback", F.col("a") / year)
    g = g.withColumn("over_pct", (F.col("a") / F.col("fair") - 1) * 100).withColumn("return_10y", (F.lit(1.03) ** 10 - 1) * 100 + F.col("gross_yield") * 10)
    return g.orderBy(F.desc("gross_yield"), "key").limit(top)


def rent_histogram_summary(df: DataFrame, value: Column) -> DataFrame:
    """average, upper_median, n."""
    rows = df.select(F.lit(1).alias("all"), value.alias("value"))
    middle = stats.upper_medians(rows, ["all"], F.col("value"), "upper_median").select("all", "upper_median")
    return rows.groupBy("all").agg(F.avg("value").alias("average"), F.count("value").alias("n")).join(middle, "all", "left").drop("all")
