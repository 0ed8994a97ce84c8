"""Upserts, change capture and pruning as joins; each takes old and new tables and returns the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut, narrow
from .charts import latest


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str], keep_old: list[str] = ()) -> DataFrame:
    """Full outer join on the keys: overwrite columns are the new row's, keep_old ones the old row's, others new or else old."""
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns), F.lit(True).alias("__new"))
    cond = None
    for k in keys:
        one = old[k].eqNullSafe(n[f"n_{k}"])
        cond = one if cond is None else cond & one
    j = old.withColumn("__old", F.lit(True)).join(n, cond, "full_outer")
    out = []
    for c in old.columns:
        if c in overwrite:
            out.append(F.when(F.col("__new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        elif c in keep_old:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c))
        else:
            out.append(F.coalesce(f"n_{c}", c).alias(c))
    return j.select(*out)


def changes(old: DataFrame, new: DataFrame, keys: list[str], watched: list[str]) -> DataFrame:
    """New rows of known keys of which a watched column differs; a new null is a change."""
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in watched))
    same = None
    for c in watched:
        one = F.col(c).eqNullSafe(F.col(f"o_{c}"))
        same = one if same is None else same & one
    return new.join(o, keys).filter(~same).select(*new.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Only the new rows: first of each key, and not held yet."""
    return latest(new, keys, order).join(old.select(*keys), keys, "left_anti")


def rarely_twice(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key of a table in which few keys come twice: only rows of such keys are moved, the others stay where they are read.

    The keys that come twice are cut off. If they are many the result is the same, by joins that move all rows.
    """
    twice = narrow(cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*(F.col(k).alias(f"__{k}") for k in keys))))
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = one if cond is None else cond & one
    return df.join(twice, cond, "left_anti").unionByName(latest(df.join(twice, cond, "left_semi"), keys, order))


def fill_nulls(old: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    f = facts.select(key, *(F.col(c).alias(f"f_{c}") for c in columns))
    j = old.join(f, key, "left")
    return j.select(*(F.coalesce(c, f"f_{c}").alias(c) if c in columns else F.col(c) for c in old.columns))


def prune(parents: DataFrame, keep: Column, key: str, *dependents: tuple[DataFrame, str]) -> list[DataFrame]:
    """Parents under ``keep`` (null doesn't keep) and the dependents whose parent stayed."""
    kept = parents.filter(F.coalesce(keep, F.lit(False)))
    ids = kept.select(key)
    return [kept, *(d.join(ids.withColumnRenamed(key, c), c, "left_semi") for d, c in dependents)]


def counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """inserted, updated."""
    known = old.select(*keys).distinct().withColumn("__known", F.lit(1))
    return new.join(known, keys, "left").agg(F.count_if(F.col("__known").isNull()).alias("inserted"), F.count("__known").alias("updated"))


def replace_slice(df: DataFrame, path: str, column: str) -> None:
    """Overwrites only the partitions of column that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
