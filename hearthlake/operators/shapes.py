"""Relational shapes that callers share: lookups with fallbacks, queues, merges of histories, differences and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def now_and_latest(alerts: DataFrame, scores: DataFrame, items: DataFrame, item: str, scored: str, score: str, by: str) -> DataFrame:
    """Alerts with their item, the score that raised them (the same ``by``) and, if there is one since, the item's latest score."""
    latest = scores.groupBy(item).agg(F.max_by(F.struct(F.col(scored).alias("at"), F.col(score).alias("score")), F.struct(scored, score)).alias("now"))
    raised = scores.select(item, by, F.col(score).alias("raised_score"))
    out = alerts.join(raised, [item, by]).join(items, item).join(latest, item, "left")
    newer = F.col("now.at") > F.col(scored)
    return out.withColumn("latest_score", F.when(newer, F.col("now.score"))).drop("now")


def with_current(items: DataFrame, facts: DataFrame, keys: list[str], period: str, now: Column) -> DataFrame:
    """items with the facts of one period, null where they have none."""
    return items.join(facts.filter(F.col(period) == now).drop(period), keys, "left")


def rotation(items: DataFrame, seen: DataFrame, key: str, observed: str, check_in: str, as_of: Column, days: int = 14) -> DataFrame:
    """items in the order in which to observe them: never observed, then with a stay that begins within ``days``, then the longest ago."""
    soon = F.col(check_in).between(as_of, as_of + F.expr(f"interval {int(days)} days"))
    per = seen.groupBy(key).agg(F.max(observed).alias("last_seen"), F.min(F.when(soon, F.col(check_in))).alias("next_stay"))
    turn = F.when(F.col("last_seen").isNull(), 0).when(F.col("next_stay").isNotNull(), 1).otherwise(2)
    return items.join(per, key, "left").withColumn("turn", turn).orderBy("turn", "last_seen", key)


def not_since(items: DataFrame, done: DataFrame, key: str, at: str, cutoff: Column) -> DataFrame:
    """items that weren't done since the cutoff; null keys of either side match nothing, so they stay."""
    return items.join(done.filter((F.col(at) >= cutoff) & F.col(key).isNotNull()).select(key), key, "left_anti")


def coverage_over(items: DataFrame, key: str, group: str, **sides: DataFrame) -> DataFrame:
    """group, n and for each side how many of the items it knows; each side counts once an item."""
    out = items.select(key, group)
    for name, side in sides.items():
        out = out.join(side.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left")
    return out.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.count(f"has_{name}").alias(name) for name in sides))


def first_known(items: DataFrame, table: DataFrame, tiers: list[dict[str, Column]], value: str, points: str, least: int = 2) -> DataFrame:
    """items with the table's value at the first tier that has enough points, and the tier's number.

    A tier maps key columns of the table to columns of the items. The table is an aggregate.
    """
    out, keys = items, list(tiers[0])
    # a tier of constants only, too, is an equi-join: its keys hang on a column of the items
    nothing = F.coalesce(F.substring(F.col(items.columns[0]).cast("string"), 1, 0), F.lit(""))
    for k, tier in enumerate(tiers):
        side = table.filter(F.col(points) >= least).select(*(F.col(c).alias(f"__k{k}_{c}") for c in keys), F.col(value).alias(f"__v{k}"))
        on = None
        for c, of in tier.items():
            same = F.concat(of.cast("string"), nothing) == F.col(f"__k{k}_{c}").cast("string")
            on = same if on is None else on & same
        out = out.join(side, on, "left").drop(*(f"__k{k}_{c}" for c in keys))
    got = [F.col(f"__v{k}") for k in range(len(tiers))]
    which = F.coalesce(*(F.when(v.isNotNull(), F.lit(k)) for k, v in enumerate(got)))
    return out.withColumn(value, F.coalesce(*got)).withColumn("tier", which).drop(*(f"__v{k}" for k in range(len(tiers))))


def overflows(df: DataFrame, most: int) -> bool:
    """Whether there are more rows than fit; reads one row more at most."""
    return df.limit(most + 1).count() > most


def append_unknown(first: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """first, then those rows of more whose keys it hasn't; ``part`` tells them apart."""
    return first.withColumn("part", F.lit(0)).unionByName(more.join(first.select(*keys), keys, "left_anti").withColumn("part", F.lit(1)))


def merged_histories(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key; the fresh one wins."""
    both = old.withColumn("__age", F.lit(1)).unionByName(fresh.withColumn("__age", F.lit(0)))
    others = [c for c in old.columns if c not in keys]
    g = both.groupBy(*keys).agg(F.min_by(F.struct(*others), "__age").alias("__row"))
    return g.select(*keys, *(F.col("__row")[c].alias(c) for c in others)).select(*old.columns)


def tail(series: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The last ``most`` rows of each series."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return series.withColumn("__turn", turn).filter(F.col("__turn") <= most).drop("__turn")


def strongest(parts: Column, weight: str, most: int) -> Column:
    """The ``most`` structs with the largest absolute weight, the earlier of equal ones first."""
    ranked = F.transform(parts, lambda x, k: F.struct((-F.abs(x[weight])).alias("by"), k.alias("at"), x.alias("row")))
    return F.transform(F.slice(F.sort_array(ranked), 1, most), lambda x: x["row"])
