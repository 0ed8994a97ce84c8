"""Layers around points and parcels: rasters, shares of an area, polygons of several rings, simplified rings, frontage along lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.crs import once
from ..shared import narrow
from .spatial import BORDER, near_shapes, points_in_rings

# Metres of a degree, the step of a slope, the grid of a share, roads' reach, chords and decimals of rings.
LAT_M, LNG_M, STEP_M = 110_574.0, 111_320.0, 30.0
GRID_STEPS = (-1.0, -0.5, 0.0, 0.5, 1.0)
ROAD_M, CHORD, DECIMALS, PASSES, WIDER = 10.0, 1.5e-5, 5, 3, 1.02


def raster_values(points: DataFrame, tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """points (lat, lng, ...) with ``value``: that of the raster cell that holds the point; null outside all tiles, or where the cell isn't a number.

    tiles: tile, min_lat, max_lat, min_lng, max_lng, width, height; a tile spans the whole degree of its name (min_lat, min_lng) or a part of it.
    cells: tile, row (from the north), col, value. One row a tile, so the tiles are broadcast if they are few; cells are looked up by
    an equi-join.
    """
    t = tiles.select("tile", *(F.col(c).alias(f"__{c}") for c in ("min_lat", "max_lat", "min_lng", "max_lng", "width", "height")))
    t = t.withColumns({"__a": F.floor(F.col("__min_lat")), "__o": F.floor(F.col("__min_lng"))})
    p = points.withColumns({"__a": F.floor(F.col("lat")), "__o": F.floor(F.col("lng"))}).join(narrow(t), ["__a", "__o"], "left")
    inside = F.col("lng").between(F.col("__min_lng"), F.col("__max_lng")) & F.col("lat").between(F.col("__min_lat"), F.col("__max_lat"))
    part = lambda share, n: F.least(F.col(n) - 1, F.greatest(F.lit(0), F.floor(share * F.col(n)))).cast("int")
    p = p.withColumn("row", F.when(inside, part((F.col("__max_lat") - F.col("lat")) / (F.col("__max_lat") - F.col("__min_lat")), "__height")))
    p = p.withColumn("col", F.when(inside, part((F.col("lng") - F.col("__min_lng")) / (F.col("__max_lng") - F.col("__min_lng")), "__width")))
    v = F.col("value").cast("double")
    good = cells.select("tile", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("value"))
    return p.join(good, ["tile", "row", "col"], "left").select(*points.columns, "value")


def terrain(points: DataFrame, key: str, tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """key, elevation_m, slope_deg: the raster at a point and the slope between its four neighbours 30 m away, one of which may lie in another tile."""
    north = STEP_M / LAT_M
    east = F.lit(STEP_M) / (F.lit(LNG_M) * F.cos(F.radians("lat")))
    spots = [("c", F.lit(0.0), F.lit(0.0)), ("n", F.lit(north), F.lit(0.0)), ("s", F.lit(-north), F.lit(0.0)), ("e", F.lit(0.0), east), ("w", F.lit(0.0), -east)]
    around = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (F.col("lat") + a).alias("lat"), (F.col("lng") + o).alias("lng")) for s, a, o in spots)))
    read = raster_values(points.select(key, around.alias("at")).select(key, "at.*"), tiles, cells)
    z = read.groupBy(key).agg(*(F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s, _, _ in spots))
    slope = F.degrees(F.atan(F.hypot((F.col("e") - F.col("w")) / (2 * STEP_M), (F.col("n") - F.col("s")) / (2 * STEP_M))))
    return z.select(key, F.col("c").alias("elevation_m"), F.when(F.col("c").isNotNull(), slope).alias("slope_deg"))


def grid_share(points: DataFrame, key: str, rings: DataFrame, radius_m: float, cell: float = 0.01, inside: Column | None = None) -> DataFrame:
    """key, share: how many of 5 x 5 spots within radius_m of a point lie in a ring at least; ``inside`` is as in points_in_rings."""
    up = F.lit(radius_m / LNG_M)
    aside = F.lit(radius_m) / (F.lit(LNG_M) * F.greatest(F.lit(0.2), F.cos(F.radians("lat"))))
    spots = F.explode(F.array(*(F.struct(F.lit(5 * i + j).alias("spot"), (F.col("lat") + a * up).alias("lat"), (F.col("lng") + b * aside).alias("lng")) for i, a in enumerate(GRID_STEPS) for j, b in enumerate(GRID_STEPS))))
    placed = points.filter("lat is not null and lng is not null")
    hits = points_in_rings(placed.select(key, spots.alias("at")).select(key, "at.*"), rings, cell, inside=inside).select(key, "spot").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    return placed.select(key).join(hits, key, "left").select(key, (F.coalesce("hits", F.lit(0)) / len(GRID_STEPS) ** 2).alias("share"))


def in_polygon(rings: Column, lat: Column, lng: Column) -> Column:
    """Even-odd over all rings of a polygon, so that holes and parts count; a ring whose box doesn't hold the point isn't tried."""

    def holds(ring: Column) -> Column:
        lats, lngs = F.transform(ring, lambda q: q["lat"]), F.transform(ring, lambda q: q["lng"])
        return lat.between(F.array_min(lats), F.array_max(lats)) & lng.between(F.array_min(lngs), F.array_max(lngs)) & geo.point_in_ring(ring, lat, lng)

    return F.size(F.filter(rings, holds)) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, rings: str = "rings", inside: Column | None = None) -> DataFrame:
    """Pairs of a point and a polygon (array of rings) that holds it. A polygon is copied to the cells that its box touches; ``inside`` is as in points_in_rings."""
    p = points.filter("lat is not null and lng is not null").withColumns({"__ca": geo.cell(F.col("lat"), size), "__co": geo.cell(F.col("lng"), size)})
    corners = F.flatten(rings)
    lats, lngs = F.transform(corners, lambda q: q["lat"]), F.transform(corners, lambda q: q["lng"])
    cells = lambda v: F.sequence(geo.cell(F.array_min(v) - BORDER, size), geo.cell(F.array_max(v) + BORDER, size))
    g = polygons.filter(F.size(corners) > 0).withColumn("__ca", F.explode(cells(lats))).withColumn("__co", F.explode(cells(lngs)))
    return p.join(g, ["__ca", "__co"]).filter(in_polygon(F.col(rings), F.col("lat"), F.col("lng")) if inside is None else inside).drop("__ca", "__co")


def _kept(ring: Column, inner: Column, keep) -> Column:
    """The ring's first point, then those points k of ``inner`` that keep(ring, last kept point, k)."""
    return F.aggregate(inner, F.slice(ring, 1, 1), lambda out, k: F.when(keep(ring, F.element_at(out, F.lit(-1)), k), F.concat(out, F.array(F.element_at(ring, k)))).otherwise(out))


def thinned(ring: Column, least: Column | float) -> Column:
    """A ring without points closer than ``least`` degrees to the one kept before; closed again. Rings of five points or fewer, and those of which
    fewer than four points would stay, stay whole."""

    def thin(r: Column) -> Column:
        def keep(pts: Column, last: Column, k: Column) -> Column:
            p = F.element_at(pts, k)
            return F.pow(p["lng"] - last["lng"], 2) + F.pow(p["lat"] - last["lat"], 2) >= F.lit(least) * F.lit(least)

        def closed(out: Column) -> Column:
            whole = F.concat(out, F.slice(r, 1, 1))
            return F.when(F.size(whole) >= 4, whole).otherwise(r)

        return F.when(F.size(r) <= 5, r).otherwise(once(_kept(r, F.sequence(F.lit(2), F.greatest(F.size(r) - 1, F.lit(2))), keep), closed))

    return once(ring, thin)


def smoothed(ring: Column, chord: float = CHORD, passes: int = PASSES, decimals: int = DECIMALS) -> Column:
    """A ring without points that lie within ``chord`` of the line between the one kept before and the next one, pass by pass; rounded.

    A pass needs more than five points and must leave four; else the ring stays as the pass before has left it.
    """

    def keep(pts: Column, last: Column, k: Column) -> Column:
        p, after = F.element_at(pts, k), F.element_at(pts, k + 1)
        dx, dy = after["lng"] - last["lng"], after["lat"] - last["lat"]
        long = F.hypot(dx, dy)
        away = F.when(long == 0, F.hypot(p["lng"] - last["lng"], p["lat"] - last["lat"])).otherwise(F.abs((p["lng"] - last["lng"]) * dy - (p["lat"] - last["lat"]) * dx) / long)
        return away > chord

    def one(r: Column) -> Column:
        passed = F.concat(_kept(r, F.sequence(F.lit(2), F.greatest(F.size(r) - 1, F.lit(2))), keep), F.slice(r, -1, 1))
        return F.when(F.size(r) <= 5, r).otherwise(once(passed, lambda out: F.when(F.size(out) < 4, r).otherwise(out)))

    out = ring
    for _ in range(passes):
        out = once(out, one)
    turned = lambda v: F.floor(v * 10**decimals + 0.5) / 10**decimals
    return F.transform(out, lambda p: F.struct(turned(p["lat"]).alias("lat"), turned(p["lng"]).alias("lng")))


def widened(ring: Column, by: float = WIDER) -> Column:
    """A ring grown from the mean of its points, then smoothed; empty if it has fewer than four points."""

    def grow(r: Column) -> Column:
        mean = lambda c: F.aggregate(r, F.lit(0.0), lambda s, p: s + p[c]) / F.size(r)
        return once(F.struct(mean("lat").alias("lat"), mean("lng").alias("lng")), lambda m: F.transform(r, lambda p: F.struct(*((m[c] + (p[c] - m[c]) * by).alias(c) for c in ("lat", "lng")))))

    small = F.expr("cast(array() as array<struct<lat: double, lng: double>>)")
    return F.when(F.size(ring) >= 4, smoothed(once(ring, grow))).otherwise(small)


def frontage(parcels: DataFrame, key: str, lines: DataFrame, reach_m: float = ROAD_M) -> DataFrame:
    """key, frontage_m: the length of a ring's sides whose middle lies within reach_m of a line; a side counts once however many lines run along it."""
    sides = parcels.select(key, F.posexplode(geo.edges(F.col("ring"))).alias("side", "e"))
    length = geo.haversine(F.col("e.a.lat"), F.col("e.a.lng"), F.col("e.b.lat"), F.col("e.b.lng"))
    middle = sides.select(key, "side", length.alias("length_m"), ((F.col("e.a.lat") + F.col("e.b.lat")) / 2).alias("lat"), ((F.col("e.a.lng") + F.col("e.b.lng")) / 2).alias("lng"))
    near = near_shapes(middle, lines.select("line"), reach_m, "line", False).select(key, "side", "length_m").distinct()
    found = near.groupBy(key).agg(F.sum("length_m").alias("frontage_m"))
    return parcels.select(key).join(found, key, "left").select(key, F.coalesce("frontage_m", F.lit(0.0)).alias("frontage_m"))
