"""Transactions from geographic packages: three tables with binary geometries to one shape of rows.

Tables come as DataFrames, or from package files, each one task: a package is a database file that only its own format can be read by, so
it is taken whole by one task and its rows are streamed. Geometries are decoded for a whole Arrow batch at once; coordinates are turned
into degrees by columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..operators.sinks import insert_ignore

# Tables and columns of the packages, words of the market, the country's box (south, north, west, east).
TABLES = {
    "parcel": ("transakcje_dzialki", "dzi_id_dzialki", ["dzi_pow_ewid", "nier_pow_gruntu"], ["dzi_cena_brutto", "tran_cena_brutto"], {"land_use": "dzi_sposob_uzyt", "zoning": "dzi_przezn_wmpzp"}),
    "building": ("transakcje_budynki", "bud_id_budynku", ["bud_pow_uzyt", "nier_pow_gruntu"], ["bud_cena_brutto", "tran_cena_brutto"], {}),
    "unit": ("transakcje_lokale", "lok_id_lokalu", ["lok_pow_uzyt"], ["lok_cena_brutto", "tran_cena_brutto"], {"rooms": "lok_liczba_izb", "floor": "lok_nr_kond"}),
}
MARKETS = {"pierwotny": 2, "wtorny": 1}
COUNTRY = (48.9, 55.1, 14.0, 24.3)
HECTARE_M2, LEAST_M2 = 10_000, 5
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}  # bytes by the header's code


def _body(blob: bytes) -> int:
    """Where the geometry proper begins: behind the envelope that the flags name, else at the first header that makes sense; -1 without one."""
    told = 8 + ENVELOPES.get(blob[3] >> 1 & 7, 0)
    for at in (told, *range(8, min(64, len(blob) - 5))):
        if at + 5 <= len(blob) and blob[at] in (0, 1) and 1 <= struct.unpack_from("<I" if blob[at] else ">I", blob, at + 1)[0] <= 7:
            return at
    return -1


def _vertices(blob: bytes, at: int) -> tuple[list[np.ndarray], int]:
    """All coordinates of the geometry at ``at``, and where it ends."""
    order = "<" if blob[at] else ">"
    count = lambda p: struct.unpack_from(order + "I", blob, p)[0]
    kind, at = count(at + 1) & 0xFF, at + 5

    def points(p: int, n: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(blob, order + "f8", 2 * n, p).reshape(-1, 2), p + 16 * n

    found: list[np.ndarray] = []
    if kind == 1:
        some, at = points(at, 1)
        return [some], at
    n, at = count(at), at + 4
    if kind == 2:
        some, at = points(at, n)
        return [some], at
    for _ in range(n):
        if kind == 3:
            some, at = points(at + 4, count(at))
            found.append(some)
        else:
            more, at = _vertices(blob, at)
            found += more
    return found, at


def mean_point(blob: bytes | None) -> tuple[float, float] | None:
    """Mean of all vertices of a package's geometry; null for empty, broken and cut ones."""
    if blob is None or len(blob) < 8 or blob[:2] != b"GP" or blob[3] & 0x10 or (at := _body(blob)) < 0:
        return None
    try:
        every = np.concatenate(_vertices(blob, at)[0] or [np.empty((0, 2))])
    except (struct.error, ValueError, IndexError, RecursionError):
        return None
    return tuple(every.astype(float).mean(axis=0)) if len(every) else None


def _alike(same: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equally long geometries (rows of bytes) the means of all that are a point, a line or a polygon of one ring at ``at``, and which these are."""
    size, out, done = same.shape[1], np.full((len(same), 2), np.nan), np.zeros(len(same), bool)
    for mark, order in ((0, ">"), (1, "<")):
        number = lambda p, order=order: np.ascontiguousarray(same[:, p : p + 4]).view(f"{order}u4")[:, 0]
        for kind, start in ((1, at + 5), (2, at + 9), (3, at + 13)):
            if start + 16 > size:
                continue
            fits = (same[:, at] == mark) & (number(at + 1) == kind)
            if kind == 3:
                fits &= number(at + 5) == 1
            n = np.ones(len(same), int) if kind == 1 else number(start - 4).astype(int)
            for count in np.unique(n[fits & (n > 0) & (n <= (size - start) // 16)]):
                rows = fits & (n == count)
                out[rows] = np.ascontiguousarray(same[rows, start : start + 16 * count]).view(f"{order}f8").reshape(-1, count, 2).astype(float).mean(axis=1)
                done |= rows
    return out, done


def mean_points(blobs: pd.Series) -> pd.DataFrame:
    """x, y for each; those of one length and header are decoded together, but for rare shapes."""
    given = blobs.tolist()
    out = np.full((len(given), 2), np.nan)
    alike: dict[tuple, list[int]] = {}
    for k, blob in enumerate(given):
        if blob is not None and len(blob) >= 8:
            alike.setdefault((len(blob), bytes(blob[:4])), []).append(k)
    for (size, head), found in alike.items():
        if head[:2] != b"GP" or head[3] & 0x10:
            continue
        rows = np.array(found)
        means, done = _alike(np.frombuffer(b"".join(given[k] for k in found), np.uint8).reshape(-1, size), 8 + ENVELOPES.get(head[3] >> 1 & 7, 0))
        out[rows[done]] = means[done]
        for k in rows[~done]:
            if (point := mean_point(given[k])) is not None:
                out[k] = point
    return pd.DataFrame({"x": pd.array(out[:, 0], "Float64"), "y": pd.array(out[:, 1], "Float64")}).where(lambda d: ~np.isnan(out))


def located(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """df with lat and lng in place of its geometry; null without one, or outside the country."""
    decode = F.pandas_udf(mean_points, "x double, y double")
    at = crs.with_degrees(df.withColumn("__xy", decode(F.col(geometry))), F.col("__xy.x"), F.col("__xy.y"), crs.GRID_1992, "__lat", "__lng")
    south, north, west, east = COUNTRY
    inside = (F.col("__lat") > south) & (F.col("__lat") < north) & (F.col("__lng") > west) & (F.col("__lng") < east)
    return at.withColumns({"lat": F.when(inside, F.col("__lat")), "lng": F.when(inside, F.col("__lng"))}).drop("__xy", "__lat", "__lng", geometry)


def number(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")), n)


def rows_of(table: DataFrame, kind: str, area_code: str) -> DataFrame:
    """One of the three tables as transactions; rows without an id of their own are left out.

    A transaction can span several parcels or units, so the part's id belongs to the row's.
    """
    _, ident, areas, prices, more = TABLES[kind]
    uid, part = F.coalesce(F.col("tran_lokalny_id_iip").cast("string"), F.lit("")), F.coalesce(F.col(ident).cast("string"), F.lit(""))
    given = located(table.filter(uid != ""))
    area = F.coalesce(*(number(F.col(c)) for c in areas)) * (HECTARE_M2 if kind == "parcel" else 1)
    price = F.coalesce(*(number(F.col(c)) for c in prices))
    market = F.coalesce(*(F.when(F.col("tran_rodzaj_rynku") == word, code) for word, code in MARKETS.items()))
    return given.select(
        F.concat(F.lit(f"{area_code}-G/"), uid, F.when(part != "", F.concat(F.lit("/"), part)).otherwise("")).alias("transaction_id"), F.try_to_timestamp("dok_data").alias("date"), price.alias("price"), area.alias("area_m2"),
        F.when(area >= LEAST_M2, price / area).alias("price_per_m2"), (number(F.col(more["rooms"])).cast("int") if "rooms" in more else F.lit(None).cast("int")).alias("rooms"),
        (F.col(more["floor"]).cast("string") if "floor" in more else F.lit(None).cast("string")).alias("floor"), market.alias("market"), F.lit(kind).alias("kind"), "lat", "lng",
        (F.nullif(part, F.lit("")) if kind == "parcel" else F.lit(None).cast("string")).alias("parcel_id"),
    )


def transactions(tables: dict[str, DataFrame], area_code: str) -> DataFrame:
    """All rows of the tables that are there (parcel, building, unit) in one shape."""
    out = None
    for kind, table in tables.items():
        rows = rows_of(table, kind, area_code)
        out = rows if out is None else out.unionByName(rows)
    return out


def parcel_facts(table: DataFrame) -> DataFrame:
    """parcel_id, land_use, zoning, area_ha of the parcels' table: a row for each parcel, the latest document's."""
    _, ident, areas, _, more = TABLES["parcel"]
    facts = F.struct(*(F.col(c).cast("string").alias(n) for n, c in more.items()), number(F.col(areas[0])).alias("area_ha"))
    newest = F.max_by(facts, F.struct(F.coalesce(F.try_to_timestamp("dok_data"), F.lit("0001-01-01").cast("timestamp")), F.col("tran_lokalny_id_iip").cast("string"), facts))
    return table.filter(F.coalesce(F.col(ident).cast("string"), F.lit("")) != "").groupBy(F.col(ident).cast("string").alias("parcel_id")).agg(newest.alias("f")).select("parcel_id", "f.*")


def new_transactions(held: DataFrame, rows: DataFrame) -> DataFrame:
    """What the import adds: rows with a date and a price whose id isn't held yet, the first of several."""
    return insert_ignore(held, rows.filter("date is not null and price is not null"), ["transaction_id"], [F.asc("date"), F.asc("kind"), F.asc("price")])


def read_packages(spark: SparkSession, path: str, kind: str, batch: int = 5000) -> DataFrame:
    """A table of all package files under a path, with the file's name; files without the table have no rows."""
    name, ident, areas, prices, more = TABLES[kind]
    columns = list(dict.fromkeys(["tran_lokalny_id_iip", "tran_rodzaj_rynku", "dok_data", ident, *areas, *prices, *more.values()]))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for given in batches:
            for source, content in zip(given.column("path").to_pylist(), given.column("content").to_pylist(), strict=True):
                with sqlite3.connect(":memory:") as held:
                    held.deserialize(content)
                    if not held.execute("select 1 from sqlite_master where type = 'table' and name = ?", (name,)).fetchone():
                        continue
                    rows = held.execute(f"select {', '.join(f'cast({c} as text)' for c in columns)}, geometry from {name}")
                    while some := rows.fetchmany(batch):
                        found = list(zip(*some, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([source] * len(some)), *(pa.array(c, pa.string()) for c in found[:-1]), pa.array(found[-1], pa.binary())], names=["source", *columns, "geometry"])

    return files.mapInArrow(run, ", ".join(f"{c} string" for c in ["source", *columns]) + ", geometry binary")
