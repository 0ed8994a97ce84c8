"""How market series move together: correlations of a panel's residuals, drawn to priors, pooled over places, and their Cholesky factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves

# Priors by pair of targets, the pairs that an estimate needs, the strength of the prior, the least diagonal.
PRIORS, OTHER_PRIOR = {("price", "rent"): 0.45, ("price", "str"): 0.3, ("rent", "str"): 0.35}, 0.25
LEAST_PAIRS, STRENGTH, JITTER = 4, 8, 1e-9
TARGETS = ("price", "rent", "str")


def prior(a: Column, b: Column) -> Column:
    known = F.coalesce(*(F.when((F.least(a, b) == x) & (F.greatest(a, b) == y), v) for (x, y), v in PRIORS.items()))
    return F.when(a == b, 1.0).otherwise(F.coalesce(known, F.lit(OTHER_PRIOR)))


def correlations(panel: DataFrame, place: str) -> DataFrame:
    """panel (place, target, t, residual) -> place, a, b, n, r, source: each pair of a place's targets by name; ``estimated`` or the ``prior`` alone.

    Both sides of a pair are the same rows met at a place and time, so a group's rows are as many as its periods. Of several
    residuals of a time the mean counts.
    """
    one = panel.filter(F.col("residual").isNotNull() & ~F.isnan("residual")).groupBy(place, "target", "t").agg(F.avg("residual").alias("x"))
    other = one.select(place, F.col("target").alias("b"), "t", F.col("x").alias("y"))
    both = one.withColumnRenamed("target", "a").join(other, [place, "t"]).filter("a < b")
    met = both.groupBy(place, "a", "b").agg(F.count(F.lit(1)).alias("n"), curves.pearson(F.col("x"), F.col("y")).alias("raw"))
    there = one.select(place, "target").distinct()
    pairs = there.withColumnRenamed("target", "a").join(there.select(place, F.col("target").alias("b")), place).filter("a < b")
    j = pairs.join(met, [place, "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    estimated = F.col("raw").isNotNull() & (F.col("n") >= LEAST_PAIRS)
    w, p = F.col("n") / (F.col("n") + STRENGTH), prior(F.col("a"), F.col("b"))
    return j.select(place, "a", "b", "n", F.when(estimated, F.col("raw") * w + p * (1 - w)).otherwise(p).alias("r"), F.when(estimated, "estimated").otherwise("prior").alias("source"))


def pooled(found: DataFrame) -> DataFrame:
    """a, b, r: over places with enough pairs, weighted by these, half way to the prior; the prior alone without any."""
    good = F.col("n") >= LEAST_PAIRS
    g = found.groupBy("a", "b").agg(F.sum(F.when(good, F.col("r") * F.col("n"))).alias("s"), F.sum(F.when(good, F.col("n"))).alias("n"))
    p = prior(F.col("a"), F.col("b"))
    return g.select("a", "b", F.when(F.col("n") > 0, (F.col("s") / F.col("n") + p) / 2).otherwise(p).alias("r"))


def cholesky(matrix: list[list[Column]]) -> list[list[Column]]:
    """The lower factor of a small symmetric matrix of columns; a diagonal that would be no more than zero is a little more."""
    lower: list[list[Column]] = []
    for i, row in enumerate(matrix):
        made: list[Column] = []
        for j in range(i + 1):
            rest = row[j]
            for k in range(j):
                rest = rest - made[k] * (made[k] if i == j else lower[j][k])
            made.append(F.sqrt(F.greatest(rest, F.lit(JITTER))) if i == j else rest / lower[j][j])
        lower.append(made)
    return lower


def factors(found: DataFrame, place: str, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """place, l00, l10, l11, ...: the factor of a place's matrix, with priors for pairs that it hasn't."""
    value = lambda a, b: F.coalesce(F.max(F.when((F.col("a") == min(a, b)) & (F.col("b") == max(a, b)), F.col("r"))), F.lit(PRIORS.get((min(a, b), max(a, b)), OTHER_PRIOR)))
    names = {(i, j): f"__r{i}{j}" for i in range(len(targets)) for j in range(i)}
    g = found.groupBy(place).agg(*(value(targets[i], targets[j]).alias(n) for (i, j), n in names.items()))
    rows = [[F.col(names[max(i, j), min(i, j)]) if i != j else F.lit(1.0) for j in range(len(targets))] for i in range(len(targets))]
    lower = cholesky(rows)
    return g.select(place, *(lower[i][j].alias(f"l{i}{j}") for i in range(len(targets)) for j in range(i + 1)))
