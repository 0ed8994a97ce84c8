"""Alert scores of offers: five components of 0 to 100, their weighted sum pulled towards the middle by doubt, points for amenities, gates.

A component is a base and a list of signals; a signal is a condition, points, and, if the offer's card is to show it, a label with an
impact. Everything is a column over one row an offer; columns that the input doesn't have count as null. Prepared first (``prepared``): the nearest centre
and station, the heating's kind, the building's class. ``scored`` stores scores by version, ``unscored`` picks what has none yet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, prose, stats, text
from ..shared import cut

# The version and parameters of the score.
VERSION = "2027.23"
WEIGHTS = {"flat": (0.3, 0.2, 0.2, 0.25, 0.05), "house": (0.3, 0.1, 0.3, 0.25, 0.05), "plot": (0.25, 0.15, 0.28, 0.27, 0.05)}  # value, transit, green, property, risk
VALUE_CURVE = [(-0.3, 0), (-0.2, 5), (-0.1, 20), (0, 50), (0.1, 80), (0.2, 95), (0.3, 100)]
TRAM, TRAIN = ([(300, 100), (600, 80), (1000, 60), (1500, 40), (3000, 15)], 20), ([(150, 40), (300, 70), (800, 100), (2000, 85), (3000, 55), (5000, 30)], 15)
BUS, PARK = ([(200, 90), (400, 80), (800, 60), (1500, 40), (3000, 15)], 20), ([(150, 100), (300, 90), (600, 75), (1000, 60), (2000, 35)], 20)
NATURE, CENTRE = ([(150, 100), (300, 90), (600, 75), (1200, 55), (2500, 30)], 20), ([(1000, 100), (2000, 90), (4000, 70), (8000, 50), (15000, 30)], 20)
ZONE, RAIL = ([(500, 100), (1000, 95), (2000, 85), (3000, 72), (4000, 55)], 0), ([(400, 50), (800, 80), (1500, 100), (2000, 90), (3000, 70)], 0)
MIX = {"tram": (0.45, 0.15, 0.1, 0.3, 0.0), "flat": (0.0, 0.4, 0.15, 0.45, 0.0), "land": (0.0, 0.25, 0.1, 0.15, 0.5)}  # tram, train, bus, centre, fast rail
ZONE_M, RAIL_M, RAIL_SEEN_M = 4000, 20_000, 25_000
CONFIDENCE = {"high": 0.95, "medium": 0.75, "low": 0.45}
HEATING_POINTS = {"heatPump": 8, "district": 8, "gas": -7, "electric": -12, "coalWood": -10, "oil": -7}
STYLE_POINTS = {"largePanel": -12, "tenement": 10, "apartmentBuilding": 8, "brick": 4, "concrete": 3, "wood": 2}
NIGHTLY, DENSITY = [(600, 6), (400, 4), (250, 2)], [(120, 6), (60, 4), (30, 2)]
HEADROOM, SHOWN, STORED_DAYS = 30, 8, 14
SUPPORTS_FALLBACK = ["no_heating_evidence", "not_building_plot"]
ANCHORS = {  # city, name: lat, lng
    ("krakow", "Rynek Główny"): (50.06163, 19.93728), ("krakow", "Kazimierz (Plac Nowy)"): (50.05151, 19.94475), ("krakow", "Podgórze (Plac Bohaterów Getta)"): (50.04611, 19.9474),
    ("krakow", "Krowodrza (Plac Inwalidów)"): (50.06585, 19.925), ("krakow", "Grzegórzki (Rondo Mogilskie)"): (50.0673, 19.9629), ("krakow", "Dębniki (Rondo Matecznego)"): (50.03877, 19.9256),
    ("krakow", "Zwierzyniec (Błonia)"): (50.0549, 19.9067), ("krakow", "Wola Justowska"): (50.0635, 19.8835), ("katowice", "Katowice Rynek"): (50.25934, 19.02159),
}
STATIONS = {  # name: lat, lng, whether the planned line calls there
    "Kraków Główny": (50.06842, 19.94789, True), "Katowice": (50.25761, 19.01715, True), "Zawiercie": (50.48064, 19.42316, True), "Tychy": (50.13577, 18.96418, False),
    "Bielsko-Biała Główna": (49.82986, 19.04532, False), "Gliwice": (50.30116, 18.67704, False),
}
PANEL, BRICK, CONCRETE, TENEMENT, WOOD = r"wielka[ _-]?p[ył]yta|wielkopłyta|concrete[ _-]?plate|large[ _-]?panel", "cegł|brick", "beton|concrete", "kamienic|tenement", "drewno|wood"
MEDIA_MISSING = r"bez medi|brak medi|media do pod|bez pr[ąa]du|bez wody|brak kanaliz|niepod[łl]ącz"
BUILDABLE_PURPOSES = ["residential", "residential_services", "multi_family", "mixed"]


@dataclass(frozen=True)
class Signal:
    when: Column
    points: Column | float = 0
    label: Column | str | None = None
    impact: Column | float | None = None  # the points if it isn't named

    def worth(self) -> Column:
        return F.when(self.when, F.lit(self.points).cast("double")).otherwise(0.0)

    def shown(self) -> Column:
        impact = self.points if self.impact is None else self.impact
        return F.when(self.when, F.struct((self.label if isinstance(self.label, Column) else F.lit(self.label)).alias("label"), F.lit(impact).cast("double").alias("impact")))


NO_REASONS = "cast(array() as array<struct<label: string, impact: double>>)"


class Component(NamedTuple):
    """Columns of their own, so that reasons and flags aren't made where only scores are asked for."""

    score: Column
    confidence: Column
    reasons: Column
    flags: Column


def component(base: Column | float, signals: list[Signal], confidence: Column | float, flags: list[tuple[str, Column]] = ()) -> Component:
    score = reduce(add, (s.worth() for s in signals), F.lit(base).cast("double"))
    shown = [s.shown() for s in signals if s.label is not None]
    reasons = F.array_compact(F.array(*shown)) if shown else F.expr(NO_REASONS)
    raised = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in flags))) if flags else F.expr("cast(array() as array<string>)")
    return Component(clamp(score), F.lit(confidence).cast("double"), reasons, raised)


def chosen(cases: list[tuple[Column, Component]], other: Component) -> Component:
    """Of the first case that holds, else the other."""
    return Component(*(reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed([(on, c[n]) for on, c in cases]), other[n]) for n in range(len(other))))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def banded(m: Column, bands: tuple[list[tuple[float, float]], float]) -> Column:
    """Points of the first band that holds a distance; without a distance, or beyond all bands, the fallback."""
    limits, fallback = bands
    return F.coalesce(*(F.when((m >= 0) & (m <= limit), float(points)) for limit, points in limits), F.lit(float(fallback)))


def first_of(value: Column, steps: list[tuple[float, float]]) -> Column:
    return F.coalesce(*(F.when(value >= least, float(points)) for least, points in steps))


def value_curve(discount: Column) -> Column:
    (x0, y0), (x9, y9) = VALUE_CURVE[0], VALUE_CURVE[-1]
    out = F.when(discount <= x0, float(y0)).when(discount >= x9, float(y9))
    for (a, p), (b, q) in zip(VALUE_CURVE, VALUE_CURVE[1:], strict=False):
        out = out.when(discount <= b, p + (discount - a) / (b - a) * (q - p))
    return F.coalesce(out, F.lit(50.0))


def whole(x: Column) -> Column:
    return stats.half_up(x).cast("long").cast("string")


def kilometres(m: Column) -> Column:
    return F.format_string("%.1f", m / 1000)


class Offer:
    """Columns of the input by name; those that aren't there are null."""

    KINDS = {"boolean": "has_balcony has_terrace has_garden has_elevator has_parking has_garage has_basement zoning_wz zoning_no_plan flood_risk placeholder_point near_lake near_river near_forest near_mountains plot_wz geo_known rail_planned".split(),
             "string": "segment region city title description floor building_material condition ownership heating_type features_heating building_type plot_type auction_type road_class land_use_class est_level fact_style fact_technology fact_heating fact_plot_type plan_purpose plan_symbol park_name zone_name rail_name heating class_kind".split()}

    def __init__(self, df: DataFrame):
        self._there = set(df.columns)
        self._kinds = {c: kind for kind, names in self.KINDS.items() for c in names}

    def __getattr__(self, name: str) -> Column:
        return (F.col(name) if name in self._there else F.lit(None)).cast(self._kinds.get(name, "double"))

    def has(self, name: str) -> Column:
        return F.coalesce(getattr(self, name), F.lit(False))

    def low(self, name: str) -> Column:
        return F.lower(F.coalesce(getattr(self, name), F.lit("")))


def matches(s: Column, pattern: str) -> Column:
    return s.rlike(prose.java(pattern))


def building_class(o: Offer) -> Column:
    """struct<kind, old_block> of a flat's building: what the text states first, the portal's fields second. Only a proved old block is one."""
    said = F.lower(F.coalesce(o.fact_style, prose.building_stated(F.concat_ws("\n", F.coalesce(o.title, F.lit("")), F.coalesce(o.description, F.lit("")))), F.lit("")))
    t = F.trim(F.concat_ws(" ", o.low("building_type"), o.low("building_material")))
    year = F.coalesce(o.build_year, o.fact_build_year)
    block = (said == "block") | matches(t, "blok|block|wie[żz]owiec")
    kind = (
        F.when((said == "house") | matches(t, r"bli[żz]niak|semi[ _-]?detached|szeregowiec|townhouse|segment|wolnostoj|detached|\bdom\b"), "house").when((said == "largepanel") | matches(t, "wielka[ _-]?p[łl]yta|wielkop[łl]yt|panel|prefab") | matches(o.low("fact_technology"), "prefab"), "oldBlock")
        .when((said == "tenement") | matches(t, TENEMENT) | F.coalesce(year <= 1945, F.lit(False)), "tenement").when((said == "apartment") | matches(t, "apartamentowiec|apartment"), "apartment")
        .when(block & F.coalesce(year >= 2000, F.lit(False)), "newBlock").when(block & year.isNotNull(), "oldBlock").when(block, "block").otherwise("unknown")
    )
    return kind


def prepared(offers: DataFrame) -> DataFrame:
    """offers with the nearest centre (zone_m, zone_name) and fast station (rail_m, rail_name, rail_planned), heating and class_kind."""
    o = Offer(offers)
    city = text.norm_key(o.city)
    own = [F.lit(c).startswith(city) & (city != "") for c, _ in ANCHORS]
    any_own = reduce(lambda a, b: a | b, own)
    apart = [F.when(mine | ~F.coalesce(any_own, F.lit(False)), F.struct(geo.haversine(o.lat, o.lng, F.lit(a), F.lit(b)).alias("m"), F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (((_, name), (a, b)), mine) in enumerate(zip(ANCHORS.items(), own, strict=True))]
    rails = []
    for k, (name, (a, b, planned)) in enumerate(STATIONS.items()):
        far = geo.haversine(o.lat, o.lng, F.lit(a), F.lit(b))
        rails.append(F.when((F.abs(o.lat - a) <= RAIL_SEEN_M / geo.M_PER_DEGREE) & (far <= RAIL_SEEN_M), F.struct(far.alias("m"), F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(planned).alias("planned"))))
    placed = o.lat.isNotNull() & o.lng.isNotNull()
    said = F.concat_ws("\n", F.coalesce(o.title, F.lit("")), F.coalesce(o.description, F.lit("")))
    out = offers.withColumns({"__zone": F.when(placed, F.array_min(F.array_compact(F.array(*apart)))), "__rail": F.when(placed, F.array_min(F.array_compact(F.array(*rails)))), "heating": prose.heating_of(o.heating_type, o.features_heating, o.fact_heating, said)["kind"], "class_kind": building_class(o)})
    return out.withColumns({"zone_m": F.col("__zone.m"), "zone_name": F.col("__zone.name"), "rail_m": F.col("__rail.m"), "rail_name": F.col("__rail.name"), "rail_planned": F.coalesce("__rail.planned", F.lit(False))}).drop("__zone", "__rail")


def value(o: Offer) -> Component:
    known = (o.price > 0) & (o.est_fair > 0)
    off = 1 - o.price / o.est_fair
    few_sales = F.coalesce(o.est_rcn, F.lit(0)) < 3
    plot = o.segment == "plot"
    base = F.when(plot & few_sales, 0.65).otherwise(F.coalesce(*(F.when(o.est_level == k, v) for k, v in CONFIDENCE.items()), F.lit(0.45)))
    spread = F.coalesce(o.est_spread, F.lit(100.0))
    tight = F.when(spread <= 10, 1.0).when(spread >= 40, 0.45).otherwise(1 - (spread - 10) / 60)
    tight = F.when(plot, F.greatest(tight, F.lit(0.7))).otherwise(tight)
    n = F.coalesce(o.est_n, F.lit(0))
    trust = clamp(base * clamp((n - 2) / 18, 0.2, 1) * tight * F.when(few_sales, F.when(plot, 0.9).otherwise(0.85)).otherwise(1.0), 0.05, 1)
    signals = [
        Signal(off >= 0.03, 0, F.concat(whole(off * 100), F.lit("% cheaper than the local comparable median")), F.least(F.lit(35.0), off * 100)),
        Signal(off <= -0.03, 0, F.concat(whole(F.abs(off) * 100), F.lit("% above the local comparable median")), -F.least(F.lit(35.0), F.abs(off) * 100)),
    ]
    there = component(value_curve(off), signals, trust, [("few_comparables", n < 5), ("listing_only_comps", few_sales)])
    return chosen([(known, there)], component(40, [], 0.15, [("no_comparable_estimate", F.lit(True))]))


def in_tram_city(o: Offer) -> Column:
    city = F.trim(text.norm_key(F.coalesce(o.city, F.lit(""))))
    return city.isin("krakow", "katowice") | city.startswith("katowice ")


def nowhere() -> Component:
    return component(45, [], 0.2, [("missing_coordinates", F.lit(True))])


def transit(o: Offer) -> Component:
    flat = o.segment == "flat"
    tram_flat = flat & in_tram_city(o)
    centre = F.when(flat & o.zone_m.isNotNull(), banded(o.zone_m, ZONE)).otherwise(banded(o.center_m, CENTRE))
    parts = [F.when(tram_flat, banded(o.tram_m, TRAM)).otherwise(0.0), banded(o.train_m, TRAIN), banded(o.bus_m, BUS), centre, F.when(~flat & o.rail_m.isNotNull(), banded(o.rail_m, RAIL)).otherwise(0.0)]
    mixed = reduce(add, (p * F.when(tram_flat, a).when(flat, b).otherwise(c) for p, a, b, c in zip(parts, MIX["tram"], MIX["flat"], MIX["land"], strict=True)))
    zone = flat & (o.zone_m <= ZONE_M)
    line = o.rail_line_m
    signals = [
        Signal(tram_flat & (o.tram_m <= 300), 0, F.concat(whole(o.tram_m), F.lit(" m to the nearest tram stop (300 m target)")), 8),
        Signal(tram_flat & (o.tram_m > 300) & (o.tram_m <= 600), 0, F.concat(whole(o.tram_m), F.lit(" m to the nearest tram stop")), 4),
        Signal((o.train_m >= 300) & (o.train_m < 2000), 0, F.concat(kilometres(o.train_m), F.lit(" km to a railway station")), 8),
        Signal(zone, 0, F.concat(F.translate(kilometres(o.zone_m), ".", ","), F.lit(" km to "), o.zone_name), F.when(o.zone_m <= 1000, 10).otherwise(6)),
        Signal(~F.coalesce(zone, F.lit(False)) & (o.center_m <= 2500), 0, F.concat(kilometres(o.center_m), F.lit(" km to the city centre")), 6),
        Signal(~flat & (o.rail_m <= RAIL_M), 0, F.concat(F.when(o.rail_planned, "KDP ").otherwise("kolej 200+ "), o.rail_name, F.lit(" ("), F.translate(kilometres(o.rail_m), ".", ","), F.lit(" km)")), F.when(o.rail_planned, 10).otherwise(7)),
        Signal(line < 100, -20, "railway line within 100 m", -12), Signal((line >= 100) & (line < 200), -12, "railway line within 200 m", -8), Signal((line >= 200) & (line < 400), -5, "railway line within 400 m", -4),
    ]
    return chosen([(o.geo_known, component(mixed, signals, 0.85, [("rail_noise", line < 200)]))], nowhere())


def green(o: Offer) -> Component:
    forest_share, water_share, parks = F.coalesce(o.forest_share, F.lit(0.0)), F.coalesce(o.water_share, F.lit(0.0)), F.coalesce(o.park_count, F.lit(0.0))
    forest = banded(o.forest_m, NATURE) * 0.65 + clamp(forest_share * 100) * 0.35
    water = clamp(F.greatest(banded(o.lake_m, NATURE), banded(o.river_m, NATURE)) + F.least(F.lit(10.0), water_share * 25))
    base = banded(o.park_m, PARK) * 0.3 + forest * 0.35 + water * 0.35 + F.least(F.lit(8.0), parks * 4)
    near = F.least(o.lake_m, o.river_m)
    signals = [
        Signal(o.park_m <= 600, 0, F.concat(whole(o.park_m), F.lit(" m to a park")), 8), Signal(parks > 0, 0, F.concat(whole(parks), F.when(parks == 1, " park").otherwise(" parks"), F.lit(" within 500 m")), F.least(F.lit(6.0), parks * 3)),
        Signal(o.forest_m <= 600, 0, F.concat(whole(o.forest_m), F.lit(" m to forest")), 8), Signal(forest_share >= 0.4, 0, F.concat(F.lit("forest covers about "), whole(forest_share * 100), F.lit("% of the 500 m area")), 10),
        Signal(near <= 600, 0, F.concat(whole(near), F.lit(" m to water")), 8), Signal(water_share >= 0.15, 0, F.concat(F.lit("water covers about "), whole(water_share * 100), F.lit("% of the 1 km area")), 6),
    ]
    return chosen([(o.geo_known, component(base, signals, 0.8))], nowhere())


def points_of(c: Column, table: list[tuple[Column, float]]) -> Column:
    return F.coalesce(*(F.when(cond, float(v)) for cond, v in table), F.lit(0.0))


def condition_points(o: Offer) -> Column:
    c = o.low("condition")
    return points_of(c, [(c.isin("excellent", "new", "very_good"), 8), (c == "good", 4), (c.isin("to_renovation", "for_renovation", "to_renovate", "poor", "not_good"), -8)])


def material_points(m: Column) -> Column:
    return points_of(m, [(matches(m, PANEL), -12), (matches(m, BRICK), 4), (matches(m, CONCRETE), 3), (matches(m, TENEMENT), 2), (matches(m, WOOD), 2)])


def year_points(o: Offer) -> Column:
    y = o.build_year
    return points_of(y, [(y >= 2015, 8), (y >= 2000, 5), (y >= 1980, 1), (y >= 1960, -2), (y.isNotNull(), -4)])


def heating_points(o: Offer) -> Column:
    return points_of(o.heating, [(o.heating == k, v) for k, v in HEATING_POINTS.items()])


def ownership_points(o: Offer) -> Column:
    w = o.low("ownership")
    return points_of(w, [(w == "full_ownership", 4), (w.isin("leasehold", "share"), -8)])


def floor_number(o: Offer) -> Column:
    f = o.low("floor")
    return F.when(f.isin("ground_floor", "parter"), 0).when(f.isin("basement", "suterena"), -1).otherwise(F.nullif(F.regexp_extract(f, r"(-?\d+)", 1), F.lit("")).try_cast("int"))


def style(o: Offer) -> Column:
    """struct<style, label> of a flat's building; null where nothing tells."""
    pair = lambda s, label: F.struct(F.lit(s).alias("style"), F.lit(label).alias("label"))
    said = {"tenement": ("tenement", "kamienica"), "largePanel": ("largePanel", "wielka płyta"), "apartment": ("apartmentBuilding", "apartamentowiec"), "block": ("concrete", "blok")}
    m, both = o.low("building_material"), F.concat_ws(" ", o.low("building_type"), o.low("building_material"))
    rules = [(both, PANEL + r"|blok(?:u|i|ów)?\b|\bblock\b", "largePanel", "blok / wielka płyta"), (both, TENEMENT, "tenement", "kamienica"), (both, "apartamentowiec|apartment", "apartmentBuilding", "apartamentowiec"), (m, BRICK, "brick", "cegła"), (m, CONCRETE, "concrete", "beton"), (m, WOOD, "wood", "drewno")]
    return F.coalesce(*(F.when(o.fact_style == k, pair(*v)) for k, v in said.items()), *(F.when(matches(s, p), pair(name, label)) for s, p, name, label in rules))


def flat_property(o: Offer) -> Component:
    floor, lift = floor_number(o), o.has("has_elevator")
    outside = o.has("has_garden") | o.has("has_terrace")
    at = F.when(floor < 0, -25).when(floor == 0, F.when(outside, -2).otherwise(-8)).when(floor <= 3, 6).when(floor <= 6, F.when(lift, 3).otherwise(-3)).when(floor > 6, F.when(lift, 3).otherwise(-10))
    year, made, cond, heat, own = year_points(o), style(o), condition_points(o), heating_points(o), ownership_points(o)
    material = material_points(o.low("building_material"))
    worth = points_of(made, [(made["style"] == k, v) for k, v in STYLE_POINTS.items()])
    has = {"has_balcony": 2, "has_terrace": 3, "has_garden": 3, "has_elevator": 4, "has_parking": 4, "has_garage": 4, "has_basement": 2}
    signals = [
        Signal(floor.isNotNull(), at), Signal(year < 5, year), Signal(year >= 5, year, "newer building"),
        Signal(made.isNotNull(), worth, F.concat(made["label"], F.when(worth < 0, ": lower property score").otherwise(": preferred building"))),
        Signal(cond < 4, cond), Signal(cond >= 4, cond, "good or very good condition"), Signal(made.isNull() & (material < 3), material), Signal(made.isNull() & (material >= 3), material, "brick or concrete construction"),
        *(Signal(o.has(k), v) for k, v in has.items()), Signal(o.rooms.isNotNull(), F.when(o.rooms == 1, -2).when(o.rooms <= 3, 5).otherwise(2)),
        Signal(o.heating.isin("district", "heatPump"), heat, "district or efficient heating"), Signal(o.heating.isin("gas", "electric"), heat, "expensive heating"), Signal(~o.heating.isin("district", "heatPump", "gas", "electric"), heat),
        Signal(own >= 0, own), Signal(own < 0, own, "leasehold or share ownership"),
    ]
    return component(60, signals, 0.65)


def character(o: Offer) -> list[Signal]:
    """What makes a house a holiday house: wood, age, land and solitude."""
    year, land, near, around = F.coalesce(o.build_year, o.fact_build_year), F.coalesce(o.plot_area_m2, o.fact_plot_area_m2), o.nearest_building_m, o.buildings_150m
    return [
        Signal(matches(o.low("building_material"), "drewn|wood|bal|log|szkielet"), 12, "drewniany / szkieletowy"), Signal(o.fact_technology == "framed", 6, "technologia szkieletowa"),
        Signal(year <= 1945, 10, F.concat(F.lit("przedwojenny ("), whole(year), F.lit(")"))), Signal((year > 1945) & (year <= 1980), 6, F.concat(F.lit("stary dom ("), whole(year), F.lit(")"))),
        Signal(land >= 1500, 6, F.concat(F.lit("duża działka ("), whole(land), F.lit(" m²)"))), Signal(near >= 500, 20, F.concat(F.lit("w dziczy ("), whole(near), F.lit(" m)"))),
        Signal((near >= 250) & (near < 500), 14, F.concat(F.lit("bez sąsiadów ("), whole(near), F.lit(" m)"))), Signal((near >= 100) & (near < 250), 10, F.concat(F.lit("osobno ("), whole(near), F.lit(" m)"))),
        Signal(near < 25, -12, "sąsiad za płotem"), Signal(around == 0, 10, "bez innych budynków w 150 m"), Signal((around > 0) & (around <= 4), 4, "spokojna okolica"),
    ]


def house_property(o: Offer) -> Component:
    land, kind, cond = o.plot_area_m2, o.low("building_type"), condition_points(o)
    has = {"has_garage": 6, "has_garden": 8, "has_terrace": 3, "has_parking": 5, "has_basement": 3}
    signals = [
        Signal(land.isNotNull(), points_of(land, [(land >= 1000, 8), (land >= 500, 5), (land < 200, -8)])),
        Signal(F.lit(True), points_of(kind, [(kind.contains("detached") | kind.contains("wolnostoj"), 6), (kind.contains("semi") | kind.contains("bliźniak"), 3), (kind.contains("townhouse") | kind.contains("szereg"), 2)])),
        Signal(F.lit(True), year_points(o)), Signal(cond < 4, cond), Signal(cond >= 4, cond, "good or very good condition"), Signal(material_points(kind) == 0, material_points(o.low("building_material"))),
        Signal(F.lit(True), heating_points(o)), Signal(F.lit(True), ownership_points(o)), *(Signal(o.has(k), v) for k, v in has.items()), Signal(land >= 500, 0, "large plot", 6), *character(o),
    ]
    return component(60, signals, 0.6)


def plot_property(o: Offer) -> Component:
    said = F.concat_ws("\n", F.coalesce(o.title, F.lit("")), F.coalesce(o.description, F.lit("")))
    missing = matches(said, MEDIA_MISSING)
    kind, area, road = o.low("plot_type"), F.coalesce(o.plot_area_m2, o.area_m2), o.road_m
    named = text.uniqueness_flags(said)
    planned = F.coalesce(o.plan_count, F.lit(0.0)) > 0
    signals = [
        Signal(F.lit(True), points_of(kind, [(kind.contains("budowl") | kind.contains("build"), 10), (kind.contains("roln") | kind.contains("agric"), -10), (kind.contains("siedlisk"), 4), (kind.contains("rekreac"), -2)])),
        Signal(F.lit(True), points_of(area, [(area >= 1500, 3), (area >= 500, 5), (area < 300, -8)])), Signal(F.lit(True), points_of(road, [(road <= 50, 8), (road <= 150, 4), (road > 500, -6)])),
        Signal(matches(F.coalesce(o.road_class, F.lit("")), "asfalt|paved|utwardz"), 4), Signal(kind.contains("budowl"), 0, "building plot", 10), Signal(o.has("zoning_wz"), 6, "zoning decision (WZ) in place"), Signal(o.has("zoning_no_plan"), -4),
        Signal(planned, 4, "local zoning plan covers the parcel", 5), Signal(o.has("flood_risk"), -12, "flood risk on the parcel"), Signal(F.lit(True), points_of(o.slope_deg, [(o.slope_deg > 25, -10), (o.slope_deg > 15, -5)])),
        Signal(o.coverage < 0.2, 3), Signal(named["utilities"] & ~missing, 8, "media or utilities mentioned in the offer"), Signal(missing, -4, "the offer mentions missing or unconnected media"),
        Signal(named["building_permit"] & ~o.has("zoning_wz") & ~planned, 4, "permit or zoning mentioned in the offer"),
    ]
    return component(60, signals, 0.55)


def risk(o: Offer) -> Component:
    own, line, factor = o.low("ownership"), o.rail_line_m, o.est_factor
    estimated = o.est_n.isNotNull()
    points = {
        "missing_coordinates": (~o.geo_known, -20), "no_comparable_estimate": (~estimated, -15), "few_comparables": (estimated & (o.est_n < 5), -10), "wide_comp_spread": (o.est_spread > 30, -8), "high_index_factor": ((factor > 1.35) & (factor <= 1.6), -8),
        "rail_noise": (line < 200, -15), "flood_risk": (o.has("flood_risk"), -20), "leasehold": (own == "leasehold", -12), "share_ownership": (own == "share", -12), "auction": (F.coalesce(o.auction_type, F.lit("")) != "", -10), "missing_price_or_area": (o.price.isNull() | o.area_m2.isNull(), -10),
    }
    labels = {"rail_noise": ("railway noise risk", -10), "auction": ("auction or tender sale", -8)}
    return component(85, [Signal(on, p, *labels.get(name, ())) for name, (on, p) in points.items()], 0.75, [(name, on) for name, (on, _) in points.items()])


def bonuses(o: Offer) -> list[Signal]:
    """Points for amenities that are facts; doubt doesn't take from them."""
    flat, house, plot = (o.segment == s for s in ("flat", "house", "plot"))
    near, water = o.nearest_building_m, F.least(o.lake_m, o.river_m, o.water_m)
    dense, nightly = first_of(o.str_offers, DENSITY), F.when(o.str_sample >= 5, first_of(o.str_nightly, NIGHTLY))
    adjacent = F.sqrt(F.greatest(F.coalesce(o.plot_area_m2, o.area_m2, F.lit(0.0)), F.lit(0.0)) / 3.141592653589793) + 20
    tier = lambda name, m, base: [Signal(plot & (m <= adjacent), round(base * 3, 1), f"{name} on or next to the plot"), Signal(plot & (m > adjacent) & (m <= 3000), float(stats_round(base / 3)), F.concat(F.lit(f"{name} within "), kilometres(m), F.lit(" km")))]
    rail_name = F.concat(o.rail_name, F.lit(" ("), F.translate(kilometres(o.rail_m), ".", ","), F.lit(" km)"))
    return [
        Signal(o.heating.isin("district", "heatPump"), 5, F.when(o.heating == "heatPump", "heat pump").otherwise("municipal heating")), Signal(flat & (o.zone_m <= ZONE_M), 6, F.concat(F.lit("centre zone: "), F.translate(kilometres(o.zone_m), ".", ","), F.lit(" km to "), o.zone_name)),
        Signal(plot & (o.rail_m <= RAIL_M), 8, F.concat(F.when(o.rail_planned, "planned KDP station: ").otherwise("200 km/h+ station: "), rail_name)), Signal(plot & (o.rail_m <= RAIL_M) & o.rail_planned, 4, "KDP train service from 2035"),
        Signal(house & (water <= 300), 8, F.concat(F.lit("woda "), whole(water), F.lit(" m"))), Signal(house & (o.forest_m <= 300), 6, F.concat(F.lit("las "), whole(o.forest_m), F.lit(" m"))),
        Signal(house & (o.park_m <= 500), 5, F.concat(F.coalesce(o.park_name, F.lit("park")), F.lit(" "), whole(o.park_m), F.lit(" m"))), Signal(house & o.has("near_mountains"), 4, "góry w otoczeniu"),
        Signal(house & (near >= 100), 6, F.concat(F.lit("najbliższy budynek "), whole(near), F.lit(" m"))), Signal(house & (near >= 500), 8, F.concat(F.lit("dzicz: nic w promieniu "), whole(near), F.lit(" m"))),
        Signal(house & nightly.isNotNull(), nightly, F.concat(F.lit("rynek Airbnb ok. "), whole(o.str_nightly), F.lit(" zł/noc ("), whole(o.str_sample), F.lit(" ofert)"))), Signal(~flat & dense.isNotNull(), dense, F.concat(F.lit("gęstość noclegów: "), whole(o.str_offers), F.lit(" ofert w 2 km"))),
        Signal(flat & in_tram_city(o) & (o.tram_m <= 300), 5, F.concat(F.lit("tram stop within "), whole(o.tram_m), F.lit(" m"))), Signal(o.train_m <= 1000, 5, F.concat(F.lit("railway station within "), kilometres(o.train_m), F.lit(" km"))),
        *tier("forest", o.forest_m, 3), *tier("lake", o.water_m, 2), Signal(~plot & (o.park_m <= 300), 3, F.concat(F.lit("park within "), whole(o.park_m), F.lit(" m"))), Signal(~plot & (o.water_m <= 500), 2, F.concat(F.lit("water within "), whole(o.water_m), F.lit(" m"))),
        Signal(o.has("has_elevator"), 2, "elevator"), Signal(o.has("has_parking") | o.has("has_garage"), 2, "parking"),
    ]


def stats_round(x: float) -> float:
    """One decimal, halves up."""
    return int(x * 10 + 0.5) / 10


def buildable(o: Offer) -> Column:
    kind, use = o.low("plot_type"), F.trim(o.low("land_use_class"))
    said = kind.contains("budowl") | kind.contains("build") | kind.contains("inwesty") | o.has("zoning_wz") | (F.coalesce(o.plan_count, F.lit(0.0)) > 0) | use.rlike("^(b|mn|mw|rm)")
    facts = o.has("plot_wz") | o.fact_plot_type.isin("budowlana", "inwestycyjna") | o.plan_purpose.isin(*BUILDABLE_PURPOSES) | F.trim(o.plan_symbol).rlike("(?i)^(mn|mw|uz|uc|u|p|rm)")
    return said | F.coalesce(facts, F.lit(False))


def in_nature(o: Offer) -> Column:
    context = o.has("near_lake") | o.has("near_river") | o.has("near_forest") | o.has("near_mountains")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return context | (o.geo_known & (yes(o.water_m <= 1000) | yes(o.forest_m <= 800) | yes(o.park_m <= 500) | yes(o.forest_share >= 0.3) | yes(o.water_share >= 0.2)))


def gates(o: Offer, discount: Column, confidence: Column, value_score: Column) -> list[tuple[str, Column]]:
    """Every gate and when it fails, in the order in which failures are told."""
    flat, house, plot = (o.segment == s for s in ("flat", "house", "plot"))
    estimated = o.est_n.isNotNull() & F.coalesce(o.est_fair > 0, F.lit(False))
    heated = o.heating.isin("district", "heatPump")
    strong = reduce(lambda a, b: a | b, (F.coalesce(s.when, F.lit(False)) for s in character(o) if s.points > 0))
    return [
        ("placeholder_coordinates", o.has("placeholder_point")), ("old_block", flat & (o.class_kind == "oldBlock")), ("no_heating_evidence", flat & (o.heating == "unknown")), ("non_municipal_heating", flat & ~heated & (o.heating != "unknown")),
        ("outside_centre_zone", flat & (o.zone_m.isNull() | (o.zone_m > ZONE_M))), ("not_building_plot", plot & ~buildable(o)), ("no_nature_setting", house & ~in_nature(o)), ("no_house_character", house & ~strong),
        ("outside_fast_rail", plot & (o.rail_m.isNull() | (o.rail_m > RAIL_M))), ("no_comparable_estimate", ~estimated), ("thin_comps", estimated & (o.est_n < 3)), ("discount_below_gate", estimated & (discount.isNull() | (discount < 10))),
        ("implausible_discount", estimated & (discount >= 55)), ("unverified_discount", estimated & (discount >= 35) & (discount < 55) & ((o.est_n < 15) | (o.est_spread > 25))),
        ("broken_index_factor", estimated & ((o.est_factor > 1.6) | (o.est_factor < 0.9))), ("value_score_below_gate", estimated & (value_score < 55)), ("confidence_below_gate", estimated & (confidence < 0.5)),
    ]


COMPONENTS = ("value", "transit", "green", "property", "risk")


def alert_parts(offers: DataFrame) -> DataFrame:
    """offers with value_raw, ..., risk_raw, total_raw, confidence_raw, discount_raw, gate_failures, gate_reason, eligible, fallback_eligible, reasons, flags.

    Offers of other segments than flat, house and plot are left out.
    """
    given = offers.filter(F.col("segment").isin(*WEIGHTS))
    df = prepared(given if "geo_known" in given.columns else given.withColumn("geo_known", F.lit(True)))
    o = Offer(df)
    made = {"value": value(o), "transit": transit(o), "green": green(o), "property": chosen([(o.segment == "flat", flat_property(o)), (o.segment == "house", house_property(o))], plot_property(o)), "risk": risk(o)}
    extra = bonuses(o)
    df = df.withColumns({f"__{k}_{part}": c for k, v in made.items() for part, c in v._asdict().items()} | {"__bonus": reduce(add, (s.worth() for s in extra)), "__extra": F.array_compact(F.array(*(s.shown() for s in extra)))})
    weight = {k: F.coalesce(*(F.when(F.col("segment") == s, w[n]) for s, w in WEIGHTS.items())) for n, k in enumerate(COMPONENTS)}
    raw = reduce(add, (F.col(f"__{k}_score") * weight[k] for k in COMPONENTS)) / reduce(add, weight.values())
    sure = reduce(add, (F.col(f"__{k}_confidence") * weight[k] for k in COMPONENTS))
    discount = F.when((o.price > 0) & (o.est_fair > 0), (1 - o.price / o.est_fair) * 100)
    df = df.withColumns({"__sure": sure, "__weighted": clamp(50 + (raw - 50) * (0.65 + 0.35 * sure)), "__off": discount})
    total = clamp(F.col("__weighted") + F.col("__bonus") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (100 - F.col("__weighted")) / HEADROOM)))
    failed = F.array_compact(F.array(*(F.when(fails, F.lit(name)) for name, fails in gates(o, F.col("__off"), F.col("__sure"), F.col("__value_score")))))
    weighed = lambda k: F.transform(F.col(f"__{k}_reasons"), lambda x: F.struct(x["label"].alias("label"), (x["impact"] * weight[k]).alias("impact")))
    reasons = F.filter(F.concat(*map(weighed, COMPONENTS), "__extra"), lambda x: F.abs(x["impact"]) >= 1)
    ranked = F.sort_array(F.transform(reasons, lambda x, k: F.struct((-F.abs(x["impact"])).alias("by"), k.alias("at"), x.alias("x"))))
    tenth = lambda x: stats.half_up(x * 10) / 10
    told = F.transform(F.slice(ranked, 1, SHOWN), lambda x: F.struct(x["x"]["label"].alias("label"), tenth(x["x"]["impact"]).alias("impact"), F.when(x["x"]["impact"] >= 0, "positive").otherwise("negative").alias("direction")))
    flags = F.array_distinct(F.concat(*(F.col(f"__{k}_flags") for k in COMPONENTS), F.when((F.col("segment") == "flat") & (F.col("class_kind") == "unknown"), F.array(F.lit("building_class_unknown"))).otherwise(F.expr("cast(array() as array<string>)"))))
    out = df.withColumns({f"{k}_raw": F.col(f"__{k}_score") for k in COMPONENTS} | {"total_raw": total, "confidence_raw": F.col("__sure"), "discount_raw": F.col("__off"), "gate_failures": failed, "reasons": told, "flags": flags})
    out = out.withColumns({"eligible": F.size("gate_failures") == 0, "gate_reason": F.get("gate_failures", F.lit(0)), "fallback_eligible": (F.size("gate_failures") > 0) & (F.size(F.array_except("gate_failures", F.array(*map(F.lit, SUPPORTS_FALLBACK)))) == 0)})
    return out.drop(*(f"__{k}_{part}" for k in COMPONENTS for part in Component._fields), "__bonus", "__extra", "__sure", "__weighted", "__off")


def alert_scores(offers: DataFrame, version: str = VERSION, only: list[str] | None = None) -> DataFrame:
    """alert_parts as they are stored: score_version, a whole score for each component, total_score, confidence and discount_pct rounded.

    Cut off in the shared folder, so that filters behind it don't repeat the whole score; with ``only``, just these columns are made and kept.
    """
    parts = alert_parts(offers)
    tenth = lambda x: stats.half_up(x * 10) / 10
    rounded = {f"{k}_score": stats.half_up(F.col(f"{k}_raw")).cast("int") for k in COMPONENTS}
    rounded |= {"score_version": F.lit(version), "total_score": tenth(F.col("total_raw")), "confidence": stats.half_up(F.col("confidence_raw") * 100) / 100, "discount_pct": tenth(F.col("discount_raw"))}
    scores = parts.withColumns(rounded).drop(*(f"{k}_raw" for k in COMPONENTS), "total_raw", "confidence_raw", "discount_raw")
    return cut(scores if only is None else scores.select(*only))


def score_base(listings: DataFrame) -> DataFrame:
    """Listings that are scored: active visible sales with a kind, a positive price, area and unit price, whose portal doesn't say they are gone."""
    positive = (F.col("price") > 0) & (F.col("area_m2") > 0) & (F.col("price_per_m2") > 0)
    gone = F.coalesce(F.col("portal_status"), F.lit("")).isin("sold", "reserved", "expired")
    kind = F.col("property_kind").isNotNull() | F.col("property_type").isNotNull()
    return listings.filter((F.col("offer_type") == "sale") & F.col("is_active") & F.col("is_visible") & kind & positive & ~gone)


def unscored(listings: DataFrame, scores: DataFrame, key: str, version: str = VERSION, seen_since: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Listings without a score of this version; if asked for, only those first seen since then, or only those of ``keys``."""
    out = listings.join(scores.filter(F.col("score_version") == version).select(key), key, "left_anti")
    if seen_since is not None:
        out = out.filter(F.coalesce("first_seen_at", "listed_at", "scraped_at") >= seen_since)
    return out if keys is None else out.join(keys.select(key).distinct(), key, "left_semi")


def stored_scores(held: DataFrame, fresh: DataFrame, key: str, now: Column, days: int = STORED_DAYS) -> DataFrame:
    """held with fresh ones in place of those of the same key and version; fresh ones expire after ``days``."""
    new = fresh.withColumns({"computed_at": now, "expires_at": now + F.make_interval(days=F.lit(days))}).select(*held.columns)
    return held.join(new.select(key, "score_version"), [key, "score_version"], "left_anti").unionByName(new)


def refreshed_alerts(alerts: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """alerts (key, score_version, score, segment, region, ...) with the values of the stored score that they point at."""
    now = scores.select(key, "score_version", F.col("total_score").alias("__score"), F.col("segment").alias("__segment"), F.col("region").alias("__region"), F.lit(True).alias("__there"))
    j = alerts.join(now, [key, "score_version"], "left")
    new = {c: F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("score", "segment", "region")}
    return j.withColumns(new).select(*alerts.columns)
