"""Transverse Mercator grids to degrees and back, in closed form, as columns.

Series in the third flattening up to its fourth power: well under a millimetre in the zones used here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ellipsoid of both grids.
SEMI_MAJOR_M, FLATTENING = 6378137.0, 1 / 298.257222101

N = FLATTENING / (2 - FLATTENING)
RADIUS_M = SEMI_MAJOR_M / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
TO_GRID = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280]
FROM_GRID = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280]
TO_LATITUDE = [2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630]


@dataclass(frozen=True)
class Grid:
    meridian: float
    scale: float
    east_m: float
    north_m: float


# The national grid, and its city grid's zone 21.
GRID_1992 = Grid(19.0, 0.9993, 500_000.0, -5_300_000.0)
GRID_2000_21 = Grid(21.0, 0.999923, 7_500_000.0, 0.0)


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plane(xi: Column, eta: Column, grid: Grid) -> tuple[Column, Column]:
    """East and north."""
    north = xi + _sum([F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(TO_GRID, 1)])
    east = eta + _sum([F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(TO_GRID, 1)])
    return F.lit(grid.east_m) + grid.scale * RADIUS_M * east, F.lit(grid.north_m) + grid.scale * RADIUS_M * north


def _tangent(sine: Column) -> Column:
    e = 2 * N**0.5 / (1 + N)
    return F.sinh(F.atanh(sine) - F.lit(e) * F.atanh(F.lit(e) * sine))


def _sphere(t: Column, turn: Column) -> tuple[Column, Column]:
    """xi and eta."""
    return F.atan(t / F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))


def to_grid(lat: Column, lng: Column, grid: Grid) -> Column:
    """struct<east, north> in metres."""
    pair = lambda p, names: F.struct(*(c.alias(n) for c, n in zip(p, names, strict=True)))
    start = once(F.sin(F.radians(lat)), lambda s: F.struct(_tangent(s).alias("t"), F.radians(lng - grid.meridian).alias("turn")))
    return once(once(start, lambda p: pair(_sphere(p["t"], p["turn"]), ("xi", "eta"))), lambda p: pair(_plane(p["xi"], p["eta"], grid), ("east", "north")))


def _back(xi: Column, eta: Column) -> tuple[Column, Column]:
    """up and aside."""
    up = xi - _sum([F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(FROM_GRID, 1)])
    return up, eta - _sum([F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(FROM_GRID, 1)])


def _angles(up: Column, aside: Column) -> tuple[Column, Column]:
    """chi, and degrees from the meridian."""
    return F.asin(F.sin(up) / F.cosh(aside)), F.degrees(F.atan2(F.sinh(aside), F.cos(up)))


def _latitude(chi: Column) -> Column:
    return F.degrees(chi + _sum([F.lit(d) * F.sin(2 * j * chi) for j, d in enumerate(TO_LATITUDE, 1)]))


def with_grid(df: DataFrame, lat: Column, lng: Column, grid: Grid, east: str, north: str) -> DataFrame:
    """df with to_grid's two columns; each step is a column, which is compiled and computed once."""
    df = df.withColumn("__sine", F.sin(F.radians(lat))).withColumns({"__t": _tangent(F.col("__sine")), "__turn": F.radians(lng - grid.meridian)})
    df = df.withColumns(dict(zip(("__xi", "__eta"), _sphere(F.col("__t"), F.col("__turn")), strict=True)))
    df = df.withColumns(dict(zip((east, north), _plane(F.col("__xi"), F.col("__eta"), grid), strict=True)))
    return df.drop("__sine", "__t", "__turn", "__xi", "__eta")


def with_degrees(df: DataFrame, east: Column, north: Column, grid: Grid, lat: str, lng: str) -> DataFrame:
    """df with to_degrees' two columns, likewise."""
    k = grid.scale * RADIUS_M
    df = df.withColumns({"__xi": (north - grid.north_m) / k, "__eta": (east - grid.east_m) / k})
    df = df.withColumns(dict(zip(("__up", "__aside"), _back(F.col("__xi"), F.col("__eta")), strict=True)))
    df = df.withColumns(dict(zip(("__chi", "__turn"), _angles(F.col("__up"), F.col("__aside")), strict=True)))
    return df.withColumns({lat: _latitude(F.col("__chi")), lng: F.lit(grid.meridian) + F.col("__turn")}).drop("__xi", "__eta", "__up", "__aside", "__chi", "__turn")


def to_degrees(east: Column, north: Column, grid: Grid) -> Column:
    """struct<lat, lng>; null where a coordinate is."""
    k = grid.scale * RADIUS_M
    pair = lambda p, names: F.struct(*(c.alias(n) for c, n in zip(p, names, strict=True)))
    start = F.struct(((north - grid.north_m) / k).alias("xi"), ((east - grid.east_m) / k).alias("eta"))
    angles = once(once(start, lambda p: pair(_back(p["xi"], p["eta"]), ("up", "aside"))), lambda p: pair(_angles(p["up"], p["aside"]), ("chi", "turn")))
    degrees = once(angles, lambda p: F.struct(_latitude(p["chi"]).alias("lat"), (F.lit(grid.meridian) + p["turn"]).alias("lng")))
    return F.when(east.isNotNull() & north.isNotNull(), degrees)
