"""Layers, correlations, quality corrections, upside and backtest on cases of their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake.operators import backtest, comps, joint, layers, quality, upside

RING = "array<struct<lat: double, lng: double>>"


def test_raster_edges(spark):
    """Points on a tile's borders, outside all tiles, on cells that aren't numbers, and neighbours in no tile."""
    tiles = spark.createDataFrame([("t", 50.0, 51.0, 20.0, 21.0, 4, 4)], "tile string, min_lat double, max_lat double, min_lng double, max_lng double, width int, height int")
    cells = spark.createDataFrame([("t", r, c, float("nan") if (r, c) == (0, 0) else 10.0 * r + c) for r in range(4) for c in range(4)], "tile string, row int, col int, value double")
    rows = [("nan", 50.99, 20.01), ("sw", 50.0, 20.0), ("mid", 50.5, 20.5), ("out", 49.99, 20.5), ("none", None, 20.5), ("east", 50.5, 20.999)]
    got = {r["k"]: r["value"] for r in layers.raster_values(spark.createDataFrame(rows, "k string, lat double, lng double"), tiles, cells).collect()}
    assert got == {"nan": None, "sw": 30.0, "mid": 22.0, "out": None, "none": None, "east": 23.0}
    slope = {r["k"]: (r["elevation_m"], r["slope_deg"]) for r in layers.terrain(spark.createDataFrame(rows, "k string, lat double, lng double"), "k", tiles, cells).collect()}
    assert slope["sw"] == (30.0, None) and slope["out"] == (None, None) and slope["mid"][1] == pytest.approx(math.degrees(math.atan(math.hypot(1 / 60, 10 / 60))))


def square(a, o, s):
    return [(a, o), (a, o + s), (a + s, o + s), (a + s, o)]


def test_holes(spark):
    areas = spark.createDataFrame([("h", [square(0.0, 0.0, 3.0), square(1.0, 1.0, 1.0), square(10.0, 10.0, 1.0)]), ("e", []), ("t", [square(0.0, 0.0, 3.0), square(0.0, 0.0, 3.0)])], f"p string, rings array<{RING}>")
    spots = spark.createDataFrame([("in", 0.5, 0.5), ("hole", 1.5, 1.5), ("part", 10.5, 10.5), ("out", 5.0, 5.0), ("none", None, 1.0)], "k string, lat double, lng double")
    assert {(r["k"], r["p"]) for r in layers.points_in_polygons(spots, areas, 0.7).collect()} == {("in", "h"), ("part", "h")}


def test_share(spark):
    whole = spark.createDataFrame([(1, square(49.0, 19.0, 3.0)), (2, square(49.0, 19.0, 3.0))], f"p long, ring {RING}")
    spots = spark.createDataFrame([("in", 50.0, 20.0), ("edge", 49.0, 20.0), ("out", 40.0, 20.0)], "k string, lat double, lng double")
    got = {r["k"]: r["share"] for r in layers.grid_share(spots, "k", whole, 1000.0).collect()}
    assert got["in"] == 1.0 and got["out"] == 0.0 and got["edge"] in (0.4, 0.6)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 9])
def test_short_rings(spark, n):
    """Rings of five points or fewer stay; of fewer than four none is grown."""
    ring = [(50.0 + 0.001 * math.sin(k), 20.0 + 0.001 * math.cos(k)) for k in range(n)]
    r = spark.createDataFrame([(ring,)], f"ring {RING}").select(layers.thinned(F.col("ring"), 1e-9).alias("t"), layers.widened(F.col("ring")).alias("w")).first()
    assert len(r["t"]) == (n if n <= 5 else n) and len(r["w"]) == (n if n >= 4 else 0)


def test_frontage(spark):
    """A side along two roads counts once; sides far from any count nothing; a parcel without a road has none."""
    parcel = spark.createDataFrame([("p", square(50.0, 20.0, 0.001)), ("q", square(51.0, 20.0, 0.001))], f"k string, ring {RING}")
    roads = spark.createDataFrame([([(49.99995, 19.9), (49.99995, 20.1)],), ([(49.99998, 19.9), (49.99998, 20.1)],)], f"line {RING}")
    got = {r["k"]: r["frontage_m"] for r in layers.frontage(parcel, "k", roads).collect()}
    assert got["q"] == 0.0 and got["p"] == pytest.approx(111195 * 0.001 * math.cos(math.radians(50)), rel=1e-3)


def test_cholesky(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        a = rng.normal(size=(4, 4))
        m = a @ a.T
        lower = joint.cholesky([[F.lit(float(x)) for x in row] for row in m])
        got = spark.range(1).select(*(c.alias(f"x{i}{j}") for i, row in enumerate(lower) for j, c in enumerate(row))).first()
        want = np.linalg.cholesky(m)
        assert all(got[f"x{i}{j}"] == pytest.approx(want[i, j], rel=1e-6) for i in range(4) for j in range(i + 1))


def test_correlations(spark):
    """Few common times give the prior, a series without variance too; equal series are drawn from 1."""
    rows = [("a", "price", t, float(t * t)) for t in range(10)] + [("a", "rent", t, 3.0 + t * t) for t in range(10)] + [("a", "str", t, 5.0) for t in range(10)] + [("b", "price", t, float(t)) for t in range(3)] + [("b", "rent", t, float(-t)) for t in range(3)]
    found = joint.correlations(spark.createDataFrame(rows, "p string, target string, t long, residual double"), "p")
    got = {(r["p"], r["a"], r["b"]): (r["n"], round(r["r"], 6), r["source"]) for r in found.collect()}
    assert got == {("a", "price", "rent"): (10, round(10 / 18 + 0.45 * 8 / 18, 6), "estimated"), ("a", "price", "str"): (10, 0.3, "prior"), ("a", "rent", "str"): (10, 0.35, "prior"), ("b", "price", "rent"): (3, 0.45, "prior")}
    pool = {(r["a"], r["b"]): r["r"] for r in joint.pooled(found).collect()}
    assert pool["price", "rent"] == pytest.approx((10 / 18 + 0.45 * 8 / 18 + 0.45) / 2)


@pytest.mark.parametrize(("given", "pct", "codes"), [
    ({"segment": "flat"}, 0.0, []), ({"segment": "flat", "condition": "very_good"}, 4.0, ["condition"]), ({"segment": "flat", "fact_condition": "toRenovation"}, -11.0, ["condition"]), ({"segment": "flat", "condition": "good", "fact_condition": "toRenovation"}, 0.0, []),
    ({"segment": "flat", "build_year": 2024.0}, 4.0, ["age"]), ({"segment": "house", "build_year": 2024.0}, 3.0, ["age"]), ({"segment": "flat", "build_year": 1500.0}, 0.0, []), ({"segment": "flat", "condition": "excellent", "build_year": 2024.0, "fact_heat_pump": True, "fact_parking_spots": 9.0, "fact_insulation": True}, 15.0, ["condition", "age", "insulation", "amenities"]),
    ({"segment": "flat", "has_elevator": False, "floor": "5"}, -2.0, ["no_lift_high_floor"]), ({"segment": "flat", "has_elevator": False}, 0.0, []), ({"segment": "flat", "has_elevator": True, "floor": "9"}, 0.0, []),
    ({"segment": "flat", "fact_defects": ["a", "b", "c", "d", "e"]}, -4.0, ["defects", "defect", "defect", "defect", "defect"]), ({"segment": "flat", "fact_encumbrances": ["a"], "fact_tenanted": True}, -2.5, ["encumbrances", "tenanted"]),
    ({"segment": "plot", "fact_media_count": 0.0, "fact_road_access": "none", "flood_risk": True, "slope_deg": 40.0}, -15.0, ["plot_media", "plot_road_access", "plot_slope_deg", "plot_flood"]), ({"segment": "plot", "zoning_wz": False, "plan_symbol": "MN"}, 1.5, ["plot_mpzp"]),
])
def test_quality(spark, given, pct, codes):
    kind = lambda v: "array<string>" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "double" if isinstance(v, float) else "string"
    r = quality.adjusted(spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {kind(v)}" for k, v in given.items())), 2026).first()
    known = {k: v for k, v in given.items() if k != "segment" and not (k == "fact_tenanted" or k.startswith("fact_") and k not in ("fact_condition",))}
    assert (r["quality_pct"], [x["code"] for x in r["quality_reasons"]] if r["quality_known"] else codes) == ((pct, codes) if r["quality_known"] else (0.0, codes))
    assert r["quality_known"] == bool(known)


def test_upside(spark):
    """A cheap offer gains more than a dear one; a longer horizon closes more of the gap; without a series the long run holds."""
    rows = [("cheap", 100.0, 80.0, 10.0), ("dear", 100.0, 120.0, 10.0), ("none", 100.0, None, 10.0), ("bad", 0.0, 1.0, 1.0), ("wide", 100.0, 100.0, -1.0)]
    offers = spark.createDataFrame(rows, "k string, fair_m2 double, offer_m2 double, comp_spread_pct double").withColumn("series", F.lit(None).cast("array<struct<t: double, v: double>>"))
    got = {(r["k"], r["horizon"]): r for r in upside.upside(offers, "k").collect()}
    assert {k for k, _ in got} == {"cheap", "dear", "none"}
    assert got["cheap", 4]["expected"] > got["none", 4]["expected"] > got["dear", 4]["expected"] and got["cheap", 20]["score"] > got["dear", 20]["score"]
    assert got["none", 4]["expected"] == pytest.approx(3.5) and got["none", 20]["growth_pct"] == pytest.approx((1.035**5 - 1) * 100)
    assert all(r["p10"] < r["expected"] < r["p90"] and r["risk_adjusted"] < r["annualized"] for r in got.values())


def test_backtest(spark):
    """The sample is the same whatever the partitions; no later sale, none of the building or the parcel is seen."""
    rows = [(k, 50.0, 20.0 + k % 7 * 1e-4, f"2020-01-{k % 28 + 1:02}", 100.0 + k % 5, 50.0, 2, 1, "flat", k % 9, k % 11, 1.0) for k in range(200)]
    sales = spark.createDataFrame(rows, "id long, lat double, lng double, date string, price_m2 double, area_m2 double, rooms int, market int, kind string, building long, parcel long, factor double").withColumn("date", F.col("date").cast("timestamp"))
    a, b = (sorted(r["id"] for r in backtest.held_out(sales.repartition(n), "id", 20).collect()) for n in (1, 7))
    assert a == b and len(a) == 20
    pairs = backtest.known_before(backtest.held_out(sales, "id", 20), sales, 1000.0)
    by = {r["id"]: r for r in sales.collect()}
    assert all(r["c_date"] <= r["t_as_of"] and by[r["c_id"]]["building"] != by[r["target_id"]]["building"] and by[r["c_id"]]["parcel"] != by[r["target_id"]]["parcel"] for r in pairs.collect())
    got = {r["metric"]: r for r in backtest.backtest(sales, 20, comps.Selection()).collect()}
    assert set(got) == set(backtest.METRICS) and all(r["mape"] < 5 and r["within20"] == 100 and r["n"] + r["no_estimate_pct"] * 20 / 100 == pytest.approx(20) for r in got.values())
