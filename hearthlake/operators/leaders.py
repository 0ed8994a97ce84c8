"""Scores' cohorts and capped leaderboards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import street_key


def duplicate_key() -> Column:
    """City, street, rounded area and price band of one offer on two portals; null without area or price."""
    band = F.floor(F.col("price") / F.greatest(F.lit(1000.0), F.col("price") * 0.01) + 0.5)
    key = F.concat_ws("|", F.lower(F.coalesce("city", F.lit(""))), street_key(F.col("street")), F.floor(F.col("area_m2") + 0.5).cast("string"), band.cast("string"))
    return F.when(F.col("area_m2").isNotNull() & (F.col("price") > 0), key)


def investment_key() -> Column:
    """The investment that a row belongs to: its id, else its announced title, else the street; null without any."""
    title, street = F.lower(F.trim("investment_title")), street_key(F.col("street"))
    return F.coalesce(
        F.concat(F.lit("id:"), F.nullif(F.col("investment_id").cast("string"), F.lit(""))), F.concat(F.lit("title:"), F.nullif(title, F.lit(""))),
        F.when(street != "", F.concat(F.lit("street:"), F.lower(F.coalesce("city", F.lit(""))), F.lit(":"), street)),
    )


# Gates of the pool, the list's length, how many units of one investment may be on it.
LEAST_VALUE, LEAST_CONFIDENCE, LEAST_DISCOUNT, TOP, PER_INVESTMENT = 55, 0.5, 10, 25, 2
#: What of a score the leaderboard reads.
SCORED = ["score_version", "segment", "region", "total_score", "value_score", "confidence", "discount_pct", "eligible", "fallback_eligible"]


def leaderboard(scores: DataFrame, listings: DataFrame, key: str, version: str) -> DataFrame:
    """The day's best offers of each segment with their rank: scored in this version, eligible or to fill up with, still shown, past the gates.

    scores: key, score_version, segment, region, total_score, value_score, confidence, discount_pct, eligible, fallback_eligible; listings: key, is_active, is_visible, city, street,
    area_m2, price, investment_id, investment_title. An eligible offer comes before all others; equal scores by key.
    """
    shown = listings.filter("is_active and is_visible").select(key, "city", "street", "area_m2", "price", "investment_id", "investment_title")
    past = (F.col("eligible") | F.col("fallback_eligible")) & (F.col("value_score") >= LEAST_VALUE) & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("discount_pct") >= LEAST_DISCOUNT)
    scored = scores.select(key, *SCORED)
    pool = scored.filter((F.col("score_version") == version) & past).join(shown, key)
    keyed = pool.withColumns({"__dup": duplicate_key(), "__inv": investment_key()})
    out = capped(keyed, "segment", [F.desc("eligible"), F.desc("total_score"), F.asc(key)], "__dup", "__inv", TOP, PER_INVESTMENT)
    return out.select(key, "segment", "region", "rank", F.col("total_score").alias("score"), "score_version", "eligible", "discount_pct", "confidence")


def replaced_day(alerts: DataFrame, best: DataFrame, key: str, day: Column, now: Column) -> DataFrame:
    """alerts (key, alert_date, segment, region, rank, score, score_version, created_at) with the day's rows replaced by ``best``.

    Other days stay. An offer that is on the list again keeps when it first was; one that lost its place goes.
    """
    others = alerts.filter(F.col("alert_date") != day)
    before = alerts.filter(F.col("alert_date") == day).groupBy(key).agg(F.min("created_at").alias("__since"))
    new = best.join(before, key, "left").withColumns({"alert_date": day, "created_at": F.coalesce("__since", now)})
    return others.unionByName(new.select(*alerts.columns))


def capped(df: DataFrame, segment: str, order: list[Column], duplicate: str, owner: str, most: int = 25, per_owner: int = 2, pool: int = 0) -> DataFrame:
    """The best ``most`` of each segment in order, without repeats of a duplicate key and with at most per_owner of an owner.

    A row skipped as a duplicate takes no place of its owner; one skipped for its owner doesn't mark its key. So rows
    are folded in order; a skipped row changes nothing, so rows that can't be taken are dropped before. Of one owner's rows of a key that is the first
    (without a key the first per_owner); a taken row has fewer than ``most`` rows of its owner ahead, as each of them is taken or has its key taken, and
    of its key only such whose owners are full. So at most some hundred rows of a segment are folded (``pool``, if that is more), and Spark limits groups of under a
    thousand before it deals rows.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        taken_keys: set = set()
        places: dict = {}
        rows = []
        for row, (key, who) in enumerate(part.sort_values("__nr")[[duplicate, owner]].itertuples(index=False)):
            free = pd.isna(who) or places.get(who, 0) < per_owner
            if free and (pd.isna(key) or key not in taken_keys):
                taken_keys.add(key)
                places[who] = places.get(who, 0) + 1
                rows.append(row)
            if len(rows) == most:
                break
        out = part.sort_values("__nr").iloc[rows].drop(columns="__nr")
        return out.assign(rank=range(1, len(out) + 1))

    def first(rows: DataFrame, limit: int, *by: Column) -> DataFrame:
        return rows.withColumn("__nr", F.row_number().over(Window.partitionBy(segment, *by).orderBy(*order))).filter(F.col("__nr") <= limit)

    full = (most - 1) // per_owner  # so many owners at most
    key, who, nr = F.col(duplicate), F.col(owner), F.col("__nr")
    left = first(df, most, key, who).filter(nr <= F.when(key.isNotNull(), 1).when(who.isNotNull(), per_owner).otherwise(most))
    left = first(left, most, who, F.when(who.isNull(), key))
    left = first(left, most, key, F.when(key.isNull(), who)).filter(key.isNull() | (nr <= full + 1))
    ranked = first(left, max(pool, (most - 1) * (full + 2) + full * most + 1))
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", rank int"
    return ranked.groupBy(segment).applyInPandas(fold, schema)


def cohort(df: DataFrame, segment: list[str], score: str, share: float = 0.05) -> DataFrame:
    """The best ceil(share) of each cohort, one at least, with rank and cohort_size; equal scores share a rank."""
    w = Window.partitionBy(*segment)
    out = df.withColumn("cohort_size", F.count(F.lit(1)).over(w)).withColumn("rank", F.rank().over(w.orderBy(F.desc(score))))
    return out.filter(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("cohort_size") * share)))
