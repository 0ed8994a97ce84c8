"""Pinned cases of functions and operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake.functions import geo, stats, text
from hearthlake.functions import time as tm
from hearthlake.operators import comps, forecast, leaders, listings, occupancy, prices, sinks, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "v double")


@pytest.mark.parametrize("p,want", [(0.25, 1.75), (0.5, 2.5), (2.0, 4.0), (-1.0, 1.0)])
def test_quantile(spark, p, want):
    assert values(spark, [4.0, 1.0, 3.0, 2.0]).agg(stats.quantile(F.col("v"), p)).first()[0] == want


def test_quantile_edges(spark):
    assert stats.upper_medians(values(spark, [4.0, 1.0, 3.0, 2.0]), [], F.col("v"), "m").first()["m"] == 3
    assert values(spark, [1.0, float("nan"), 3.0]).agg(stats.median(F.col("v"))).first()[0] == 2
    assert values(spark, []).agg(stats.median(F.col("v"))).first()[0] is None and stats.upper_medians(values(spark, []), [], F.col("v"), "m").first()["m"] is None


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (5.0, 0.0)], "v double, w double")
    got = df.agg(stats.weighted_quantile(F.col("v"), F.col("w"), 0.5), stats.weighted_quantile(F.col("v"), F.col("w"), 0.1)).first()
    assert tuple(got) == (20.0, 10.0)
    assert stats.weighted_quantiles(df.withColumn("k", F.lit(1)), ["k"], F.col("v"), F.col("w"), 0.5, "m").first()["m"] == 20.0


@pytest.mark.parametrize("metric", ["weighted_median", "median", "mean", "area_weighted_median", "trimmed_mean", "huber"])
def test_robust_price(metric):
    v = np.array([10_000.0, 12_000.0, 14_000.0])
    assert 10_000 <= stats.robust_price(v, np.ones(3), np.array([40.0, 50.0, 60.0]), metric) <= 14_000
    assert stats.robust_price(np.array([13_337.0]), np.ones(1), None, metric) == 13_337
    assert stats.robust_price(np.array([0.0, np.nan, np.inf, 9000.0]), np.ones(4), None, metric) == 9000
    assert stats.robust_price(np.array([]), np.array([]), None, metric) is None


@pytest.mark.parametrize("period,want", [("2026-09", 24320), ("2026-Q3", 8106), ("2026-13", None), ("x", None)])
def test_period(spark, period, want):
    assert one(spark, tm.period_ordinal(F.lit(period))) == want
    if want:
        assert one(spark, tm.period_of(F.lit(want), "Q" in period)) == period


def band(name, median, n):
    return {"band": name, "median": median, "n": n}


def obs(period, median, n, *strata):
    return {"period": period, "overall_median": median, "overall_n": n, "strata": list(strata)}


def test_chain():
    got = prices.chain([obs("2026-Q2", 9975.0, 9, band("a", 9975.0, 9)), obs("2026-Q1", 9500.0, 8, band("a", 9500.0, 8))])
    assert got[0] == ("2026-Q1", 100.0) and got[1][1] == pytest.approx(105)
    assert len(prices.chain([obs("2026-Q1", 10_000.0, 9), obs("2026-Q2", 25_000.0, 9)])) == 1
    assert prices.chain([obs("2026-Q1", 10_000.0, 4)]) == []
    # after a gap the link is to the last accepted period
    got = prices.chain([obs("2026-Q1", 10_000.0, 9), obs("2026-Q2", 48_000.0, 9), obs("2026-Q3", 10_500.0, 9)])
    assert [round(x) for _, x in got] == [100, 105]


def test_geo(spark):
    square = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((50.0, 20.0), (50.0, 20.01), (50.01, 20.01), (50.01, 20.0))))
    assert one(spark, geo.point_in_ring(square, F.lit(50.005), F.lit(20.005)))
    assert not one(spark, geo.point_in_ring(square, F.lit(50.02), F.lit(20.005)))
    assert one(spark, geo.ring_area(square)) == pytest.approx(1105.74 * 715.5, rel=0.01)
    assert one(spark, geo.haversine(F.lit(50.0), F.lit(20.0), F.lit(51.0), F.lit(20.0))) == pytest.approx(111_195, rel=0.001)
    assert one(spark, geo.line_distance(F.lit(50.005), F.lit(20.02), square)) == pytest.approx(715, rel=0.02)
    assert one(spark, geo.region(F.lit(50.0), F.lit(19.5))) == "malopolskie" and one(spark, geo.region(F.lit(10.0), F.lit(19.5))) is None


def test_text(spark):
    street, number = text.street_number(F.lit("ul. Meiera 70, Prądnik Biały"))
    assert one(spark, street) == "meiera" and one(spark, number) == "70"
    assert one(spark, text.norm_key(F.lit("Łódź  Śródmieście!"))) == "odz srodmiescie"
    assert one(spark, text.norm_district(F.lit("Łódź"))) == "lodz"
    assert one(spark, text.tidy_district(F.lit("  Stare   Miasto "))) == "stare miasto"
    assert one(spark, text.clip(F.lit(" \n "))) is None
    assert one(spark, text.first_number(F.lit("cena: 1 234 567,5 zł"))) == 1234567.5


@pytest.mark.parametrize(
    "pattern,want",
    [("x" * 10, "blocked"), ("o" + "x" * 46 + "o", "blocked"), ("o" + "x" * 45, "booked"), ("x" * 14 + "o", "booked"), ("x" * 15 + "o", "blocked"), ("o" + "x" * 45 + "o", "booked")],
)
def test_runs(spark, pattern, want):
    first = datetime.date(2026, 1, 1)
    days = spark.createDataFrame([(1, first + datetime.timedelta(days=k), c == "o") for k, c in enumerate(pattern)], "item int, date date, open boolean")
    got = {r["class"] for r in occupancy.classified(days, "item", "date", "open").filter("not open").collect()}
    assert got == {want}


def test_sinks(spark):
    old = spark.createDataFrame([(1, 10.0, "a", "x"), (2, 20.0, None, "y")], "id int, price double, note string, seen string")
    new = spark.createDataFrame([(2, None, "n", "z"), (3, 5.0, None, "w")], "id int, price double, note string, seen string")
    got = {tuple(r) for r in sinks.upsert_coalesce(old, new, ["id"], ["price"], ["seen"]).collect()}
    assert got == {(1, 10.0, "a", "x"), (2, None, "n", "y"), (3, 5.0, None, "w")}
    assert [r["id"] for r in sinks.changes(old, new, ["id"], ["price"]).collect()] == [2]
    assert [r["id"] for r in sinks.insert_ignore(old, new, ["id"], [F.col("id")]).collect()] == [3]
    assert {tuple(r) for r in sinks.fill_nulls(old, spark.createDataFrame([(2, "f")], "id int, note string"), "id", ["note"]).collect()} == {(1, 10.0, "a", "x"), (2, 20.0, "f", "y")}


def test_capped(spark):
    rows = [("s", k, 100.0 - k, "d1" if k < 2 else f"d{k}", "o" if k < 6 else None) for k in range(40)]
    got = leaders.capped(spark.createDataFrame(rows, "seg string, id int, score double, dup string, owner string"), "seg", [F.desc("score")], "dup", "owner", most=5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 2, 6, 7, 8]
    small = leaders.capped(spark.createDataFrame(rows, "seg string, id int, score double, dup string, owner string"), "seg", [F.desc("score")], "dup", "owner", most=5, pool=3).orderBy("rank").collect()
    assert [r["id"] for r in small] == [0, 2, 6, 7, 8]


def test_shown(spark):
    rows = [
        (1, "investmap", "inv-7", "Osiedle A", "ul. Lipowa 1", 1.0, 2.0, 3, "d", None, 5),
        (2, "investmap", "f1", "Osiedle A — M1", "ul. Lipowa 1", 5.0, 2.0, 3, "d", "7", 5),
        (3, "rynekpierwotny", "r", "Inne", "Lipowa 1, X", 9.0, 2.0, 3, "d", None, 5),
        (4, "morizon", "m", "T", None, 8.0, 2.0, 3, "d", None, 9),
        (5, "gratka", "g", "T", None, 8.0, 2.0, 3, "d", None, 4),
        (6, "gratka", "h", "T", None, 7.0, 2.0, 3, "d", None, 4),
    ]
    df = spark.createDataFrame(rows, "id int, source string, external_id string, title string, address string, price double, area_m2 double, rooms int, district string, investment_id string, scraped_at int")
    assert sorted(r["id"] for r in listings.shown(df).collect()) == [2, 4, 6]


def test_selection(spark):
    t0 = datetime.datetime(2026, 6, 15)
    cand = [(1, k, t0 - datetime.timedelta(days=180), 60.0 + k, 2, "rcn", 400.0 + 300 * k, 10_000.0 + k) for k in range(5)] + [(1, 9, t0 + datetime.timedelta(days=1), 60.0, 2, "rcn", 1.0, 1.0)]
    df = spark.createDataFrame(cand, "target_id int, c_id int, c_date timestamp, c_area double, c_market int, c_set string, distance_m double, c_price double")
    df = df.withColumns({"t_as_of": F.lit(t0), "t_area": F.lit(60.0), "t_market": F.lit(2), "t_kind": F.lit("flat"), "t_rooms": F.lit(3), "c_rooms": F.lit(3), "c_ratio": F.lit(None).cast("double"), "c_factor": F.lit(None).cast("double")})
    got = comps.select(df, comps.Selection(radii_m=(500.0, 1000.0, 2000.0)))
    assert sorted(r["c_id"] for r in got.collect()) == [0, 1, 2] and {r["tier"] for r in got.collect()} == {1}
    assert comps.estimate(got).first()["fair"] == 10_001.0  # weights .67, .53, .44 before recency


def test_money():
    assert forecast.irr(100, np.array([110.0])) == pytest.approx(0.1)
    assert forecast.irr(100, np.array([0.0, 121.0])) == pytest.approx(0.1)
    assert forecast.irr(100, np.array([0.0, 0.0])) is None
    a, b = forecast.Mulberry(123), forecast.Mulberry(123)
    assert [a.normal() for _ in range(5)] == [b.normal() for _ in range(5)]


def test_forecast_trend():
    """Rising prices go on rising, bands are in order, drift and gaps as the model says."""
    t = np.arange(36.0)
    v = 100 * np.exp(0.012 * t + 0.01 * np.sin(t * 1.7))
    out = forecast.forecast(t, v, 4, 12)
    assert len(out) == 12 and out["value"][3] > v[-1] and (out["low"] <= out["high"]).all() and (out["low"] > 0).all() and out["quality"][0] == "high"
    line = forecast.fit(t, 0.05 * t, 1, 0.05)
    assert line.at(np.array([40.0]))[0] == pytest.approx(2.0) and line.phi == 0 and line.mu == pytest.approx(0.05)
    holes = t[[0, 1, 2, 5, 9, 10, 14, 20, 21, 30]]
    assert forecast.fit(holes, 0.05 * holes, 1, 0.05).at(np.array([33.0]))[0] == pytest.approx(1.65)
    assert forecast.fit(t, 0.05 * t, 1, 0.0).mu == pytest.approx(0.35 * 0.05)


def test_forecast_seasons():
    t = np.arange(60.0) + 2021 * 12
    v = 100 * np.exp(0.003 * np.arange(60)) * np.where(t % 12 == 6, 1.5, np.where(t % 12 == 0, 0.6, 1.0))
    out = forecast.forecast(t, v, 12, 24)
    assert set(out["method"]) == {"seasonal-ar1"} and 0.5 <= out["coverage"][0] <= 1
    july = out["value"][(t[-1] + out["horizon"]) % 12 == 6].min()
    assert july > 1.2 * out["value"].median()
    found = forecast.seasons(t, np.log(v), 12)
    assert found.sum() == pytest.approx(0) and found.argmax() == 6 and found.argmin() == 0


def test_forecast_short(spark):
    """Short series keep their last value's growth; other scales stay in their bounds; of one period the last row counts."""
    out = forecast.forecast(np.arange(3.0), np.array([1.0, 2.0, 50.0]), 12, 6)
    assert set(out["method"]) == {"prior"} and (out["low"] < out["value"]).all() and (out["value"] < out["high"]).all() and out["value"][5] == pytest.approx(50 * 1.035**0.5)
    share = forecast.forecast(np.arange(30.0), 0.5 + 0.3 * np.sin(np.arange(30.0)), 12, 6, scale="logit")
    assert ((share[["value", "low", "high"]] > 0) & (share[["value", "low", "high"]] < 1)).all().all()
    rows = [("a", f"20{k:02}-Q{q}", 100.0 + k + q) for k in range(10) for q in (1, 2, 3, 4)] + [("b", "2000-Q1", 5.0), ("b", "bad", 7.0), ("c", "2001-03", None)]
    got = forecast.forecasts(spark.createDataFrame(rows, "k string, period string, v double"), "k", "period", "v").collect()
    assert {(r["k"], r["method"]) for r in got} == {("a", "ar1"), ("b", "prior"), ("c", "prior")} and len(got) == 12


def test_band_and_coverage():
    """Of many errors the pooled radius, of few those at the horizon, of none a normal spread."""
    import pandas as pd

    rng = np.random.default_rng(2)
    table = pd.DataFrame([(c, h, 0.0, e, e) for c in range(6, 30) for h in (1, 2, 3) for e in [float(rng.normal(0, 0.1)) * h**0.5]], columns=["cut", "h", "predicted", "actual", "error"])
    low, high = forecast.band(table, 4, 0.02)
    assert -0.6 < low < -0.15 and 0.15 < high < 0.6 and high - low == pytest.approx(2 * (forecast.band(table, 1, 0.02)[1] - forecast.band(table, 1, 0.02)[0]))
    assert 0.6 <= forecast.coverage(table) <= 1
    few = table[table["h"] == 1][:5]
    assert forecast.band(few, 1, 0.02)[0] in set(few["error"]) and forecast.coverage(few) is None
    assert forecast.band(few[:1], 3, 0.02) == pytest.approx((-forecast.Z80 * 0.02 * 3**0.5, forecast.Z80 * 0.02 * 3**0.5))


def test_cells(spark):
    df = spark.createDataFrame([("k", 0, 0, 5), ("k", 1, 1, 4), ("k", 9, 9, 1), ("m", 0, 0, 1), ("m", 5, 5, 1)], "place string, cx int, cy int, n int")
    got = {r["place"]: (r["cells"], r["share"]) for r in spatial.components_of_cells(df, "place").collect()}
    assert got == {"k": (2, 0.9)}


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as e

    assert "price_trend" in e.queries() and e.entry(spark).columns


def test_order_statistics(spark):
    """Places in groups of any size, equal values counted once for each row; no group is collected."""
    rng = np.random.default_rng(3)
    rows = [("ab"[k % 2], float(v)) for k, v in enumerate(rng.integers(0, 20, 301))] + [("a", None), ("b", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {r["k"]: (r["m"], r["n"]) for r in stats.floor_quantiles(df, ["k"], F.col("v"), p, "m").collect()}
        for k in "ab":
            values = sorted(v for x, v in rows if x == k and v is not None and v == v)
            assert got[k] == (values[int(p * (len(values) - 1))], len(values))
        assert "c" not in got
    plan = stats.upper_medians(df, ["k"], F.col("v"), "m")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_huber(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v), float(w)) for k, n in (("a", 200), ("b", 7), ("c", 1), ("d", 5)) for v, w in zip(rng.lognormal(8, 0.6, n), rng.integers(1, 9, n), strict=True)] + [("e", 5.0, 1.0)] * 4 + [("e", 9.0, 1.0), ("a", -1.0, 2.0), ("a", None, 2.0)]
    got = {r["k"]: r["price"] for r in stats.huber_prices(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], F.col("v"), F.col("w")).collect()}
    for k in "abcde":
        v, w = (np.array([x[i] for x in rows if x[0] == k and x[1] is not None]) for i in (1, 2))
        assert got[k] == pytest.approx(stats.robust_price(v, w, None, "huber"), rel=1e-9)


@pytest.mark.parametrize("lat, lng", [(0.0, 10.0), (52.0, 179.999), (80.0, -179.999), (89.99, 0.0), (-75.0, 100.0)])
def test_radius_anywhere(spark, lat, lng):
    """All pairs, near the poles and across the 180th meridian."""
    rng = np.random.default_rng(5)
    wide = 1 / max(0.0005, np.cos(np.radians(lat)))
    spots = [(k, float(np.clip(lat + a, -90, 90)), float((lng + b * wide + 180) % 360 - 180)) for k, (a, b) in enumerate(rng.normal(0, 0.01, (80, 2)))]
    df = spark.createDataFrame(spots, "id int, lat double, lng double")
    got = {(r["id"], r["r_id"]) for r in spatial.within_radius(df, df, 1000.0).collect()}

    def far(a, b):
        la, lb = np.radians(a[1]), np.radians(b[1])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * np.arcsin(min(1, np.sqrt(h)))

    assert got == {(a[0], b[0]) for a in spots for b in spots if far(a, b) <= 1000} and len(got) > 80


def test_crowded_spot(spark):
    """Thousands of rows on one coordinate make one row of the join."""
    rows = [(k, 50.0, 20.0) for k in range(3000)] + [(9000, 50.0001, 20.0), (9001, 51.0, 20.0), (9002, None, 20.0)]
    got = {r["id"]: r["neighbours"] for r in spatial.crowded(spark.createDataFrame(rows, "id int, lat double, lng double"), "id").collect()}
    assert got == {k: 3001 for k in [*range(3000), 9000]}


def test_factor_before_and_between_points(spark):
    """A thinned series: the last point up to the item's period, the first before all of them."""
    series = spark.createDataFrame([("a", p, v, 1) for p, v in (("2000-Q1", 100.0), ("2000-Q3", 120.0), ("2001-Q1", 150.0), ("2002-Q1", 999.0))], "k string, period string, index_value double, n int")
    items = spark.createDataFrame([(1, "a", "1999-Q4"), (2, "a", "2000-Q2"), (3, "a", "2000-Q4"), (4, "a", "2001-Q4"), (5, "b", "2000-Q1")], "id int, k string, at string")
    got = {r["id"]: r["factor"] for r in prices.time_factor(items, series, ["k"], "at", "2001-Q2").collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 1.25, 4: 1.0, 5: None}


def test_capped_widens(spark):
    """A segment whose first rows are all of one owner is folded over more of them."""
    rows = [("s", k, None, "one") for k in range(1000, 0, -1)] + [("s", -k, f"d{k // 2}", f"o{k}") for k in range(20)] + [("t", k, None, None) for k in range(5)]
    got = leaders.capped(spark.createDataFrame(rows, "seg string, v int, dup string, own string"), "seg", [F.desc("v")], "dup", "own", most=6, pool=10).collect()
    assert sorted((r["rank"], r["v"]) for r in got if r["seg"] == "s") == [(1, 1000), (2, 999), (3, 0), (4, -2), (5, -4), (6, -6)]
    assert sum(r["seg"] == "t" for r in got) == 5


def test_districts(spark):
    df = spark.createDataFrame([("Stare Miasto",), ("  Łódź-Bałuty ",), ("ĀḂẍ e\u0301",), (None,)], "s string")
    got = [tuple(r) for r in df.select(text.norm_district(F.col("s")), text.norm_key(F.col("s"))).collect()]
    assert got == [("staremiasto", "stare miasto"), ("lodzbaluty", "odz ba uty"), ("abxe", "abx e"), (None, None)]


def test_chain_of_nothing(spark):
    """A series without a period that has enough rows has no index, and no rows."""
    strata = [{"band": "a", "median": 1.0, "n": 2}]
    obs = spark.createDataFrame([("x", "2000-Q1", 1.0, 2, strata), ("x", "2000-Q2", 1.0, 3, strata), ("y", "2000-Q1", 1.0, 9, strata)], "k string, period string, overall_median double, overall_n long, strata array<struct<band:string,median:double,n:long>>")
    assert [tuple(r) for r in prices.chain_index(obs, ["k"]).collect()] == [("y", "2000-Q1", 100.0, 1.0, 9)]
