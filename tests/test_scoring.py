"""Alert scores, prose and fees on cases of their own."""

import pytest
from pyspark.sql import functions as F

from hearthlake.functions import prose
from hearthlake.operators import scoring
from hearthlake.plans import scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def offers(spark):
    return scores.offers(spark, SF).cache()


@pytest.fixture(scope="module")
def scored(offers):
    return {r["listing_id"]: r for r in scoring.alert_scores(offers).collect()}


def test_reasons(scored):
    """At most eight, the strongest first, none under a point; flags once each."""
    assert all(len(r["reasons"]) <= 8 for r in scored.values())
    for r in scored.values():
        impacts = [abs(x["impact"]) for x in r["reasons"]]
        assert all(a >= b - 0.051 for a, b in zip(impacts, impacts[1:], strict=False)) and all(x >= 0.9 for x in impacts)
        assert all((x["impact"] >= 0) == (x["direction"] == "positive") for x in r["reasons"])
        assert len(set(r["flags"])) == len(r["flags"]) and (r["gate_reason"] is None) == r["eligible"]
    labels = {x["label"] for r in scored.values() for x in r["reasons"]}
    assert any("cheaper than the local comparable median" in x for x in labels) and any("km to Kazimierz" in x or "km to Katowice Rynek" in x for x in labels)


def one(spark, **given):
    """A flat in the middle of town, heated by the city, a fifth below its value, and what is given besides."""
    base = {
        "listing_id": 1, "segment": "flat", "region": "malopolskie", "city": "Kraków", "title": "mieszkanie", "description": "", "price": 800_000.0, "area_m2": 60.0, "heating_type": "miejskie", "building_type": "tenement", "lat": 50.0616, "lng": 19.9373, "geo_known": True,
        "est_fair": 1_000_000.0, "est_n": 20.0, "est_rcn": 12.0, "est_spread": 10.0, "est_level": "high", "est_factor": 1.1, "tram_m": 200.0, "train_m": 600.0, "bus_m": 100.0, "park_m": 250.0, "forest_m": 900.0, "lake_m": None, "river_m": 400.0, "water_m": 400.0,
    }
    row = base | given
    kinds = {k: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "long" if k == "listing_id" else "double" for k, v in row.items()}
    return scoring.alert_scores(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))).first()


def test_good_offer(spark):
    r = one(spark)
    assert (r["value_score"], r["discount_pct"], r["gate_failures"], r["eligible"], r["fallback_eligible"]) == (95, 20.0, [], True, False)
    assert r["confidence"] > 0.7 and r["total_score"] > 85 and r["score_version"] == scoring.VERSION


@pytest.mark.parametrize(("given", "gates", "fallback"), [
    ({"heating_type": ""}, ["no_heating_evidence"], True), ({"heating_type": "gazowe"}, ["non_municipal_heating"], False), ({"heating_type": "", "description": "ogrzewanie miejskie"}, [], False), ({"heating_type": "", "description": "bez ogrzewania miejskiego"}, ["no_heating_evidence"], True),
    ({"building_type": "block", "build_year": 1990.0}, ["old_block"], False), ({"building_type": "block", "build_year": 2005.0}, [], False), ({"building_type": "", "description": "w bloku z wielkiej płyty"}, ["old_block"], False), ({"placeholder_point": True}, ["placeholder_coordinates"], False),
    ({"lat": 50.2, "lng": 20.2}, ["outside_centre_zone"], False), ({"price": 950_000.0}, ["discount_below_gate"], False), ({"price": 400_000.0}, ["implausible_discount"], False), ({"price": 600_000.0, "est_n": 10.0}, ["unverified_discount"], False), ({"est_factor": 1.7}, ["broken_index_factor"], False),
    ({"est_n": 2.0, "est_rcn": 0.0}, ["thin_comps"], False), ({"segment": "plot", "plot_type": "budowlana"}, [], False), ({"segment": "plot"}, ["not_building_plot"], True), ({"segment": "plot", "plan_symbol": "MN/U"}, [], False), ({"segment": "plot", "land_use_class": "Br"}, [], False),
    ({"segment": "house", "nearest_building_m": 120.0}, [], False), ({"segment": "house", "nearest_building_m": 10.0}, ["no_house_character"], False), ({"segment": "house", "build_year": 1930.0, "water_m": 5000.0, "forest_m": 5000.0, "park_m": 5000.0}, ["no_nature_setting"], False),
])
def test_gates(spark, given, gates, fallback):
    r = one(spark, **given)
    assert (r["gate_failures"], r["fallback_eligible"]) == (gates, fallback)


def test_no_estimate(spark):
    r = one(spark, est_fair=None, est_n=None, est_rcn=None, est_spread=None, est_level=None, est_factor=None, lat=None, lng=None, geo_known=False)
    assert (r["value_score"], r["discount_pct"], r["transit_score"], r["green_score"]) == (40, None, 45, 45)
    assert r["gate_failures"] == ["outside_centre_zone", "no_comparable_estimate"] and {"missing_coordinates", "no_comparable_estimate"} <= set(r["flags"])


@pytest.mark.parametrize(("column", "steps", "component"), [("price", [950_000.0, 900_000.0, 820_000.0, 750_000.0], "value_raw"), ("tram_m", [3000.0, 1200.0, 500.0, 100.0], "transit_raw"), ("forest_m", [3000.0, 900.0, 200.0, 10.0], "green_raw"), ("build_year", [1950.0, 1990.0, 2005.0, 2020.0], "property_raw")])
def test_monotonic(spark, column, steps, component):
    """A better signal never lowers its component."""
    rows = scores.offers(spark, SF).filter("segment = 'flat' and price is not null and est_fair is not null")
    before = None
    for step in steps:
        now = {r["listing_id"]: r[component] for r in scoring.alert_parts(rows.withColumn(column, F.lit(step) * (F.col("est_fair") / 1_000_000 if column == "price" else 1))).select("listing_id", component).collect()}
        assert before is None or all(now[k] >= before[k] - 1e-9 for k in now)
        before = now


def test_other_segments_and_missing_columns(spark):
    few = spark.createDataFrame([(1, "flat", "a"), (2, "garage", "a"), (3, None, "a")], "listing_id long, segment string, region string")
    assert [(r["listing_id"], r["eligible"]) for r in scoring.alert_scores(few).collect()] == [(1, False)]


def test_storage(spark):
    """Scores of a version replace their own only; alerts follow the score that they point at."""
    held = spark.createDataFrame([(1, "old", "flat", "a", 10.0), (1, "new", "flat", "a", 20.0), (2, "new", "plot", "b", 30.0)], "k long, score_version string, segment string, region string, total_score double")
    held = held.withColumns({"computed_at": F.lit("2020-01-01").cast("timestamp"), "expires_at": F.lit("2020-01-15").cast("timestamp")})
    fresh = spark.createDataFrame([(1, "new", "house", "c", 99.0), (3, "new", "flat", "c", 5.0)], "k long, score_version string, segment string, region string, total_score double")
    after = scoring.stored_scores(held, fresh, "k", F.lit("2020-02-01").cast("timestamp"))
    assert {(r["k"], r["score_version"], r["total_score"], str(r["expires_at"])[:10]) for r in after.collect()} == {(1, "old", 10.0, "2020-01-15"), (1, "new", 99.0, "2020-02-15"), (2, "new", 30.0, "2020-01-15"), (3, "new", 5.0, "2020-02-15")}
    alerts = spark.createDataFrame([(1, "new", 20.0, "flat", "a", "x"), (1, "old", 10.0, "flat", "a", "y"), (7, "new", 1.0, "plot", "b", "z")], "k long, score_version string, score double, segment string, region string, note string")
    assert {(r["note"], r["score"], r["segment"]) for r in scoring.refreshed_alerts(alerts, after, "k").collect()} == {("x", 99.0, "house"), ("y", 10.0, "flat"), ("z", 1.0, "plot")}


@pytest.mark.parametrize(("said", "heating", "building"), [
    ("ogrzewanie miejskie", "district", None), ("bez ogrzewania miejskiego", None, None), ("brak kominka, jest piec gazowy", "gas", None), ("nie posiada ogrzewania gazowego. Ogrzewanie elektryczne", "electric", None), ("Pompa ciepła zamiast pieca gazowego", "heatPump", None), ("", None, None), (None, None, None),
    ("piękna KAMIENICA", None, "tenement"), ("nie kamienica, lecz w bloku", None, "block"), ("wielka  płyta", None, "largePanel"), ("bez windy; blok z lat 80", None, "block"), ("bez windy, blok z lat 80", None, "block"), ("nie jest to stary i niski blok", None, None), ("MPEC w kamienicy", "district", "tenement"),
    ("nie" + " x" * 40 + " kamienica", None, "tenement"), ("sieć miejska", None, None),
])
def test_stated(spark, said, heating, building):
    r = spark.createDataFrame([(said,)], "s string").select(prose.heating_stated(F.col("s")).alias("h"), prose.building_stated(F.col("s")).alias("b")).first()
    assert (r["h"], r["b"]) == (heating, building)


@pytest.mark.parametrize(("said", "rent", "fees"), [
    ("czynsz 450 zł", None, {"czynsz": 450}), ("czynsz 3490 zł", 3490.0, None), ("czynsz najmu 3490 zł\nczynsz administracyjny w wysokości około 780 zł", None, {"czynsz": 780}), ("prąd: wg zużycia\nkaucja: 4000 zł", None, None), ("kaucja i czynsz 4000 zł", None, None), ("czynsz 300 zł\nopłaty eksploatacyjne 500 zł", None, {"czynsz": 500}),
    ("czynsz 300 zł\nczynsz dodatkowo 500 zł", None, {"czynsz": 500}), ("czynsz 1 200,50 zł", None, {"czynsz": 1200}), ("czynsz 10 zł", None, None), ("czynsz 99000 zł", None, None), ("prąd 100 zł, woda 50 pln, gaz 60 zl, śmieci 30 zł, co 200 zł", None, {"prad": 100, "woda": 50, "gaz": 60, "smieci": 30, "ogrzewanie": 200}),
    ("<b>woda</b> 50 zł", None, None), ("woda " + "x" * 70 + " 50 zł", None, None), ("", None, None), (None, None, None), ("nic tu nie ma", None, None),
])
def test_fees(spark, said, rent, fees):
    r = spark.createDataFrame([(said, rent)], "s string, rent double").select(prose.fees(F.col("s"), F.col("rent")).alias("f")).first()["f"]
    got = None if r is None else {k: v for k, v in r.asDict().items() if v is not None and k != "text"}
    assert got == fees


def test_donors(spark):
    """The first offer of the building gives its fees; the district's is asked only where the building isn't known."""
    rows = [(1, 7, "a", None), (2, 7, "a", 10), (3, 7, "a", 20), (4, 8, "a", None), (5, None, "a", None), (6, None, None, None), (7, None, "b", 30)]
    got = {r["id"]: (r["fees"], r["estimated"]) for r in prose.with_fees(spark.createDataFrame(rows, "id long, building long, district string, fees long"), "id", "building", "district").collect()}
    assert got == {1: (10, True), 2: (10, False), 3: (20, False), 4: (None, False), 5: (10, True), 6: (None, False), 7: (30, False)}
