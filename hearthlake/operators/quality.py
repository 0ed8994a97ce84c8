"""By how many per cent an offer is better or worse than its comparables: reasons with their share, and the bounded sum.

Each reason is a condition, a share and a label; reasons under 0.05 % don't count. Without any signal the correction is
neutral and says so. Columns that the input doesn't have count as null; what the portal states comes before what was read from the text (fact_*).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .scoring import Offer, clamp, whole

# Shares in per cent and their bounds.
MOST, MOST_AMENITY, MOST_DEFECTS, MOST_ENCUMBRANCES, LEAST_SHARE = 15.0, 2.5, 4.0, 2.0, 0.05
CONDITIONS = {"excellent": (9.0, "wysoki standard"), "veryGood": (4.0, "stan bardzo dobry"), "good": (0.0, "stan dobry"), "toRenovation": (-11.0, "stan do remontu")}
CONDITION_NAMES = {"excellent": "excellent", "very_good": "veryGood", "veryGood": "veryGood", "good": "good", "to_renovation": "toRenovation", "toRenovation": "toRenovation"}
MEDIA = [(0, -5.0), (1, -4.0), (2, -3.0), (3, -1.5), (4, 1.0)]  # up to so many connected; more: 2
ROADS = {"public": (1.5, "droga publiczna"), "private": (-1.0, "droga prywatna")}
LAND = {"B": 1.0, "R": -1.5, "L": -4.0, "W": -5.0, "N": -2.0, "T": -1.0}
PLOTS = {"budowlana": 1.0, "inwestycyjna": 1.0, "rekreacyjna": -1.0, "rolna": -2.0, "lesna": -3.0}
SHAPES = {"elongated": -1.0, "trapezoid": -1.0, "irregular": -2.0, "narrow": -2.5}
AGES = [(5, None), (15, 2.0), (30, 0.0), (50, -2.0), (70, -4.0)]  # up to so many years; older: -6; up to five: 4, houses 3
AMENITIES = {"heat_pump": (1.0, "pompa ciepła"), "floor_heating": (0.5, "ogrzewanie podłogowe"), "recuperation": (0.5, "rekuperacja"), "air_conditioning": (0.5, "klimatyzacja"), "photovoltaics": (0.5, "fotowoltaika")}


class Described(Offer):
    """Columns that only the correction reads, by kind."""

    KINDS = {
        "boolean": [*Offer.KINDS["boolean"], *(f"fact_{a}" for a in AMENITIES), "fact_insulation", "fact_tenanted", "has_facts"],
        "string": [*Offer.KINDS["string"], "fact_condition", "fact_road_access", "fact_shape", "fact_slope", "fact_legal_status"],
        "array<string>": ["fact_encumbrances", "fact_defects"],
    }

    def said(self, *names: str) -> Column:
        return F.coalesce(*(F.nullif(F.trim(getattr(self, n)), F.lit("")) for n in names))

    def number(self, *names: str) -> Column:
        return F.coalesce(*(stats.finite(getattr(self, n)) for n in names))


def lookup(key: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(key == k, v) for k, v in table.items()), F.lit(0.0))


def up_to(x: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    return F.coalesce(*(F.when(x <= limit, v) for limit, v in steps), F.lit(beyond))


def _reasons(parts: list[tuple[Column, str, Column | str, Column | float]]) -> Column:
    rows = [F.when(on & (F.abs(F.lit(pct)) >= LEAST_SHARE), F.struct(F.lit(code).alias("code"), (label if isinstance(label, Column) else F.lit(label)).alias("label"), (stats.half_up(F.lit(pct) * 10) / 10).alias("pct"))) for on, code, label, pct in parts]
    return F.array_compact(F.array(*rows))


def _plot(o: Described) -> Column:
    media, road, wz, plans = o.fact_media_count, o.road_m, F.coalesce(o.zoning_wz, o.plot_wz), F.coalesce(o.number("plan_count"), F.lit(0.0))
    access, kind, shape, use, slope = o.fact_road_access, o.said("plot_type", "fact_plot_type"), o.said("fact_shape"), o.said("land_use_class"), o.number("slope_deg")
    planned = (plans > 0) | o.plan_symbol.isNotNull() | o.plan_purpose.isNotNull()
    return _reasons([
        (media.isNotNull(), "plot_media", F.concat(F.lit("media na działce: "), whole(media), F.lit("/5")), up_to(media, MEDIA, 2.0)),
        (access.isNotNull() & (access != ""), "plot_road_access", F.coalesce(*(F.when(access == k, label) for k, (_, label) in ROADS.items()), F.lit("brak dojazdu")), F.coalesce(*(F.when(access == k, v) for k, (v, _) in ROADS.items()), F.lit(-5.0))),
        (road.isNotNull(), "plot_road_distance", F.concat(F.lit("dojazd do drogi: "), whole(road), F.lit(" m")), F.when(road <= 50, 1.0).when(road > 500, -2.0).otherwise(0.0)),
        (F.coalesce(wz, F.lit(False)), "plot_wz", "decyzja WZ", 2.0), (~F.coalesce(wz, F.lit(False)) & planned, "plot_mpzp", "plan miejscowy", 1.5),
        (use.isNotNull(), "plot_land_use", F.concat(F.lit("klasa gruntu: "), use), lookup(F.upper(F.substring(use, 1, 1)), LAND)), (kind.isNotNull(), "plot_type", F.concat(F.lit("działka "), F.lower(kind)), lookup(F.lower(kind), PLOTS)),
        (shape.isNotNull(), "plot_shape", F.concat(F.lit("kształt "), F.lower(shape)), lookup(F.lower(shape), SHAPES)), (slope.isNotNull(), "plot_slope_deg", F.concat(F.lit("spadek "), whole(slope), F.lit("°")), F.when(slope > 25, -3.0).when(slope > 15, -1.5).otherwise(0.0)),
        (slope.isNull() & (o.fact_slope == "steep"), "plot_slope", "stromy stok", -3.0), (slope.isNull() & (o.fact_slope == "gentle"), "plot_slope", "łagodny spadek", -0.5), (o.has("flood_risk"), "plot_flood", "teren zalewowy", -4.0),
    ])


def _floor(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.contains("parter"), 0).when(low.contains("poddasz") | low.contains("suterena"), F.lit(None).cast("int")).otherwise(F.nullif(F.regexp_extract(low, r"\d+", 0), F.lit("")).try_cast("int"))


def _home(o: Described, as_of_year: int) -> Column:
    cond = F.coalesce(*(F.when(o.said("condition", "fact_condition") == k, v) for k, v in CONDITION_NAMES.items()))
    year, made = o.number("build_year", "fact_build_year"), o.said("building_type", "fact_style")
    age = F.greatest(F.lit(0.0), as_of_year - year)
    aged = (year > 1800) & (year <= as_of_year + 2)
    worth = F.when(age <= 5, F.when(o.segment == "flat", 4.0).otherwise(3.0)).otherwise(up_to(age, AGES[1:], -6.0))
    named = F.when(age > 70, F.concat(F.lit("budynek sprzed "), whole(year + 1), F.lit(" r."))).otherwise(F.concat(F.lit("budynek z "), whole(year), F.lit(" r.")))
    spots = F.coalesce(o.fact_parking_spots, F.lit(0.0))
    fitted = reduce(lambda a, b: a + b, (F.when(o.has(f"fact_{k}"), v).otherwise(0.0) for k, (v, _) in AMENITIES.items())) + F.when(spots > 0, F.least(F.lit(1.5), spots * 0.5)).otherwise(0.0)
    listed = F.array_join(F.array_compact(F.array(*(F.when(o.has(f"fact_{k}"), label) for k, (_, label) in AMENITIES.items()), F.when(spots == 1, "miejsce postojowe").when(spots > 0, F.concat(F.lit("miejsca postojowe: "), whole(spots))))), ", ")
    at, floors = F.coalesce(_floor(o.said("floor")), o.number("fact_floor"), F.lit(1)), o.number("floor_count", "fact_floor_count")
    high = (at >= 4) | F.coalesce((floors >= 5) & (at >= (floors - 1) / 2), F.lit(False))
    debts, flaws = F.coalesce(F.size(F.when(o.fact_encumbrances.isNotNull(), o.fact_encumbrances)), F.lit(0)), F.coalesce(F.size(F.when(o.fact_defects.isNotNull(), o.fact_defects)), F.lit(0))
    status = o.said("fact_legal_status")
    main = _reasons([
        (cond.isNotNull(), "condition", F.coalesce(*(F.when(cond == k, label) for k, (_, label) in CONDITIONS.items())), F.coalesce(*(F.when(cond == k, v) for k, (v, _) in CONDITIONS.items()), F.lit(0.0))),
        (aged, "age", named, worth), (made.isin("block", "largePanel"), "building_panel", "wielka płyta", -2.0), (made == "tenement", "building_tenement", "kamienica", -1.0), (o.said("building_material") == "wood", "building_material", "budynek drewniany", -1.0),
        (o.fact_technology.isin("prefab", "framed"), "technology", "technologia prefabrykowana", -1.0), (o.has("fact_insulation"), "insulation", "ocieplony budynek", 1.0), (fitted > 0, "amenities", listed, clamp(fitted, 0, MOST_AMENITY)),
        (~F.coalesce(o.has_elevator, F.lit(True)) & high, "no_lift_high_floor", F.concat(F.lit("bez windy na "), whole(at), F.lit(". piętrze")), -2.0), (status == "perpetual_usufruct", "legal_leasehold", "użytkowanie wieczyste", -3.0), (status == "share", "legal_share", "współwłasność", -2.0),
        (debts > 0, "encumbrances", F.concat(F.lit("obciążenia: "), debts.cast("string")), -clamp(debts * 1.0, 0, MOST_ENCUMBRANCES)), (flaws > 0, "defects", F.concat(F.lit("usterki: "), flaws.cast("string")), -clamp(flaws * 1.5, 0, MOST_DEFECTS)),
        (o.has("fact_tenanted"), "tenanted", "lokal wynajęty", -1.5),
    ])
    short = lambda s: F.when(F.length(s) <= 48, s).otherwise(F.concat(F.substring(s, 1, 47), F.lit("…")))
    each = F.transform(F.slice(F.coalesce(o.fact_defects, F.array().cast("array<string>")), 1, 4), lambda d: F.struct(F.lit("defect").alias("code"), F.concat(F.lit("usterka: "), short(F.trim(F.regexp_replace(d, r"\s+", " ")))).alias("label"), F.lit(0.0).alias("pct")))
    behind = F.array_position(F.transform(main, lambda x: x["code"]), F.lit("defects")).cast("int")
    return F.when(behind > 0, F.concat(F.slice(main, F.lit(1), behind), each, F.slice(main, behind + 1, F.greatest(F.size(main) - behind, F.lit(0))))).otherwise(main)


def adjusted(offers: DataFrame, as_of_year: int) -> DataFrame:
    """offers with quality_pct (-15 to 15), quality_known and quality_reasons (code, label, pct)."""
    o = Described(offers)
    signals = [o.said("condition", "fact_condition"), o.number("build_year", "fact_build_year"), o.said("building_type", "fact_style"), o.said("building_material"), o.has_elevator, o.said("floor"), o.number("fact_floor"), o.number("floor_count", "fact_floor_count"), o.said("plot_type", "fact_plot_type"),
               o.said("land_use_class"), o.zoning_wz, o.plot_wz, o.number("plan_count"), o.number("road_m"), o.number("slope_deg"), o.flood_risk, F.when(o.has("has_facts"), F.lit(1))]
    known = reduce(lambda a, b: a | b, (s.isNotNull() for s in signals))
    none = F.expr("cast(array() as array<struct<code: string, label: string, pct: double>>)")
    out = offers.withColumn("quality_known", known).withColumn("quality_reasons", F.when(known, F.when(o.segment == "plot", _plot(o)).otherwise(_home(o, as_of_year))).otherwise(none))
    total = F.aggregate("quality_reasons", F.lit(0.0), lambda s, x: s + x["pct"])
    return out.withColumn("quality_pct", stats.half_up(clamp(total, -MOST, MOST) * 10) / 10)
