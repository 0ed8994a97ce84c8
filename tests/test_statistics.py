"""Exact places in groups of any size, against plain sorting; plans that keep no group's values in one task."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake.functions import stats
from hearthlake.operators import prices
from hearthlake.plans import catalog

SF = "/root/testdata/sf0.001"


def values(kind):
    rnd = random.Random(kind)
    return {
        "spread": [rnd.uniform(-1e6, 1e6) for _ in range(500)], "narrow": [1000 + rnd.random() * 1e-6 for _ in range(500)], "ties": [rnd.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(300)], "one": [7.0], "two": [3.0, -3.0],
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(400)], "zeros": [0.0] * 5 + [-0.0, 1e-320, -1e-320], "odd": [1.0, None, float("nan"), float("inf"), -float("inf"), 2.0], "ends": [1.7e308, -1.7e308, 0.0, 1e308],
    }[kind]


KINDS = ["spread", "narrow", "ties", "one", "two", "wide", "zeros", "odd", "ends"]


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(k if k != "two" else None, v) for k in KINDS for v in values(k)] + [("none", None), ("none", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double").repartition(5).cache()


def test_ranked(groups):
    """The first value whose running count reaches a goal, for every group; null keys are a group."""
    goals = {"first": lambda n: F.lit(1), "lower": lambda n: F.floor((n + 1) / 2), "upper": lambda n: F.floor(n / 2) + 1, "last": lambda n: n}
    got = {r["k"]: r for r in stats.ranked(groups, ["k"], F.col("v"), goals, empty=True).collect()}
    for kind in KINDS:
        good = sorted(v for v in values(kind) if v is not None and math.isfinite(v))
        r = got[kind if kind != "two" else None]
        assert (r["first"], r["lower"], r["upper"], r["last"], r["n"], r["rows"]) == (good[0], good[(len(good) + 1) // 2 - 1], good[len(good) // 2], good[-1], len(good), len(values(kind))), kind
    assert (got["none"]["n"], got["none"]["rows"], got["none"]["first"]) == (0, 2, None)
    assert "none" not in {r["k"] for r in stats.ranked(groups, ["k"], F.col("v"), goals).collect()}


@pytest.mark.parametrize("p", [0.0, 0.1, 0.25, 0.5, 0.77, 1.0])
def test_quantiles(groups, p):
    got = {r["k"]: r["q"] for r in stats.quantiles(groups.filter("k <> 'ends'"), ["k"], F.col("v"), {"q": p}).collect()}
    for kind in set(KINDS) - {"two", "ends"}:
        good = [v for v in values(kind) if v is not None and math.isfinite(v)]
        assert got[kind] == pytest.approx(np.quantile(good, p), rel=1e-9, abs=1e-300), kind


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 1.0])
def test_weighted(spark, p):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([1.0, 2.5, rnd.random()]), rnd.choice([0.0, -1.0, 0.5, 2.0, float("nan")])) for k in ("a", "b") for _ in range(200)]
    got = {r["k"]: r["q"] for r in stats.weighted_quantiles(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], F.col("v"), F.col("w"), p, "q").collect()}
    for k in ("a", "b"):
        v, w = (np.array([r[n] for r in rows if r[0] == k]) for n in (1, 2))
        assert got[k] == stats.js_weighted_quantile(v, w, p)


def test_no_keys(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert stats.quantiles(df, [], F.col("v"), {"q": 0.25}).first()["q"] == 2.5
    assert stats.ranked(df.limit(0), [], F.col("v"), {"q": lambda n: n}).collect() == []


@pytest.mark.parametrize("name", ["quantiles", "weighted_quantile", "market_medians", "rent_summaries", "stratified_median", "snapshots", "market_around"])
def test_groups_are_split(spark, name):
    """No exact percentile's map of values, and windows over sums only: of buckets, cells, or a cell's values. A table that is one group has its sums of buckets
    in one task, which their number bounds; no other exchange is into one partition."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
    assert "SinglePartition" not in plan or name == "rent_summaries"
    ordered = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition" in line]
    assert ordered and all(any(c in line for c in ("__b#", "__cell#", "__v#", "__k#", "__run#")) for line in ordered)


def test_huber_rounds(spark, monkeypatch):
    """Rounds end when all groups have settled, and each plan has a few exchanges only."""
    rnd = random.Random(1)
    rows = [(k, rnd.gauss(100, 10) if rnd.random() > 0.1 else rnd.uniform(500, 900), rnd.uniform(0.5, 2)) for k in ("a", "b", "c") for _ in range(200)] + [("d", 5.0, 1.0), ("e", 5.0, 1.0), ("e", 5.0, 2.0)]
    seen = []
    cut = stats.cut
    monkeypatch.setattr(stats, "cut", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")) or cut(df))
    got = {r["k"]: r["price"] for r in stats.huber_prices(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], F.col("v"), F.col("w"), rounds=60).collect()}
    for k in "abcde":
        v, w = (np.array([r[n] for r in rows if r[0] == k]) for n in (1, 2))
        assert got[k] == pytest.approx(stats.robust_price(v, w, None, "huber"), rel=1e-6)
    assert len(seen) < 12 and max(seen) < 45


def test_medians_of_copies(spark, monkeypatch):
    """Equal values are counted once, and once only for all passes over them; copies count in medians and numbers."""
    kept, cut = [], prices.cut
    monkeypatch.setattr(prices, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rows = [("k", "2000-02-01", band, v) for v, band, n in ((1.0, "a", 30), (2.0, "a", 29), (5.0, "b", 2), (None, "b", 4), (float("nan"), None, 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, day string, band string, v double").withColumn("day", F.col("day").cast("timestamp"))
    got = {x.band: (x.band_median, x.band_n, x.overall_median, x.overall_n) for x in prices.stratified_medians(df, ["k"], "day", "v").collect()}
    assert got == {"a": (1.0, 59, 2.0, 68), "b": (5.0, 6, 2.0, 68), None: (None, 3, 2.0, 68)}
    assert [tuple(x) for x in prices.period_medians(df, ["k"], "day", "v").collect()] == [("k", "2000-Q1", 2.0, 68)]
    assert [x.count() for x in kept] == [5, 5]
