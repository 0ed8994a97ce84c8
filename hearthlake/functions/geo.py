"""Distances, boxes, cells and rings as columns. Rings are array<struct<lat, lng>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEGREE = 111_320.0
# Region boxes (least lat, most lat, least lng, most lng); the first that holds a point wins.
REGION_BOXES = {"malopolskie": (49.15, 50.55, 19.05, 21.45), "slaskie": (49.35, 51.02, 18.3, 20.05)}
# City boxes in their order.
CITY_BOXES = {
    "Kraków": (50.02, 50.12, 19.80, 20.12),
    "Tarnów": (49.98, 50.05, 20.90, 21.05),
    "Nowy Sącz": (49.58, 49.66, 20.64, 20.78),
    "Zakopane": (49.24, 49.34, 19.88, 20.04),
    "Oświęcim": (49.98, 50.06, 19.22, 19.38),
    "Wieliczka": (49.97, 50.03, 20.02, 20.11),
    "Krynica": (49.38, 49.46, 20.90, 21.02),
}


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def first_box(lat: Column, lng: Column, boxes: dict) -> Column:
    out = None
    for name, box in boxes.items():
        out = F.when(in_box(lat, lng, box), name) if out is None else out.when(in_box(lat, lng, box), name)
    return out


def region(lat: Column, lng: Column) -> Column:
    return first_box(lat, lng, REGION_BOXES)


def region_by_centre(lat: Column, lng: Column) -> Column:
    """The box that holds a point; of several, or of none, that of the nearest centre; the first of equal ones."""
    options = []
    for k, (name, (south, north, west, east)) in enumerate(REGION_BOXES.items()):
        apart = F.pow(lat - (south + north) / 2, 2) + F.pow(lng - (west + east) / 2, 2)
        options.append(F.struct((~in_box(lat, lng, (south, north, west, east))).alias("outside"), apart.alias("apart"), F.lit(k).alias("k"), F.lit(name).alias("name")))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.array_min(F.array(*options))["name"])


def city(lat: Column, lng: Column) -> Column:
    return F.coalesce(first_box(lat, lng, CITY_BOXES), F.when(lat.isNotNull(), "reszta").otherwise("brak lokalizacji"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def flat_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular metres at the first point's latitude; good for short ways."""
    return F.hypot((lat2 - lat1) * M_PER_DEGREE, (lng2 - lng1) * M_PER_DEGREE * F.cos(F.radians(lat1)))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def edges(ring: Column) -> Column:
    """The ring's sides, closed: array<struct<a, b>>."""
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return _paired(ring, turned)


def _paired(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def point_in_ring(ring: Column, lat: Column, lng: Column) -> Column:
    """Even-odd rule."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lng"]
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lng < at), F.lit(False))

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Square metres by the shoelace formula at the ring's mean latitude."""
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["lng"] * e["b"]["lat"] - e["b"]["lng"] * e["a"]["lat"])
    return F.abs(twice) / 2 * 110_574.0 * M_PER_DEGREE * F.cos(F.radians(mean))


def ring_perimeter(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + haversine(e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"]))


def compactness(area: Column, perimeter: Column) -> Column:
    return F.try_divide(F.lit(4 * 3.141592653589793) * area, perimeter * perimeter)


def segment_distance(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """Metres from a point to the segment a-b in the plane at the point's latitude."""
    k = F.cos(F.radians(lat)) * M_PER_DEGREE
    ax, ay = (a["lng"] - lng) * k, (a["lat"] - lat) * M_PER_DEGREE
    dx, dy = (b["lng"] - a["lng"]) * k, (b["lat"] - a["lat"]) * M_PER_DEGREE
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy))), F.lit(0.0))
    return F.hypot(ax + t * dx, ay + t * dy)


def line_distance(lat: Column, lng: Column, line: Column) -> Column:
    """Metres to the nearest side of a polyline."""
    parts = _paired(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))))
    return F.array_min(F.transform(parts, lambda e: segment_distance(lat, lng, e["a"], e["b"])))


def ring_distance(lat: Column, lng: Column, ring: Column, inside: Column | None = None) -> Column:
    """Metres to the ring's nearest side; 0 inside, by the even-odd rule or, if given, where ``inside`` holds."""
    away = F.array_min(F.transform(edges(ring), lambda e: segment_distance(lat, lng, e["a"], e["b"])))
    return F.when(point_in_ring(ring, lat, lng) if inside is None else inside, 0.0).otherwise(away)


def nearest_of(lat: Column, lng: Column, centres: dict[str, tuple[float, float]], most_m: float | None = None) -> Column:
    """struct<name, distance_m> of the nearest of a few fixed centres, the first of equal ones; null beyond most_m."""
    far = [F.struct(haversine(lat, lng, F.lit(a), F.lit(b)).alias("distance_m"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, (a, b)) in enumerate(centres.items())]
    best = F.array_min(F.array(*far))
    found = F.struct(best["name"].alias("name"), best["distance_m"].alias("distance_m"))
    return F.when(lat.isNotNull() & lng.isNotNull() & (F.lit(True) if most_m is None else best["distance_m"] <= most_m), found)


def box_centres(boxes: dict[str, tuple[float, float, float, float]]) -> dict[str, tuple[float, float]]:
    return {name: ((a + b) / 2, (c + d) / 2) for name, (a, b, c, d) in boxes.items()}
