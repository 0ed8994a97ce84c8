"""Queries of the importers. Their files and binary geometries are written from the supplied tables into the shared folder first."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs
from ..shared import cut, shared_folder
from ..sources import packages, pages, registry
from .catalog import MEDIANS_SQL, branded, query, r, t

NAMESPACES = 'xmlns:rcn="urn:registry" xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink"'


def place_sql(k: str) -> str:
    """Coordinates within the city grid, but for every 17th key, which lies east of it."""
    return f"49.85 + ({k} * 7919 % 450) / 1000.0 as lat, 19.65 + ({k} * 104729 % 750) / 1000.0 + case when {k} % 17 = 0 then 2 else 0 end as lng"


def _pos(k, there):
    """A position as the registry writes it, northing first; easting first for even keys."""
    lat, lng = F.lit(49.85) + k * 7919 % 450 / 1000.0, F.lit(19.65) + k * 104729 % 750 / 1000.0 + F.when(k % 17 == 0, 2).otherwise(0)
    at = crs.to_grid(lat, lng, crs.GRID_2000_21)
    east, north = F.format_string("%.4f", at["east"]), F.format_string("%.4f", at["north"])
    text = F.when(k % 2 == 0, F.concat(east, F.lit(" "), north)).otherwise(F.concat(north, F.lit(" "), east))
    return F.when(there, F.struct(F.struct(text.alias("gml:pos")).alias("gml:Point")))


def _square(k):
    """A surface of 5 corners around a key's place."""
    lat, lng = F.lit(49.85) + k * 7919 % 450 / 1000.0, F.lit(19.65) + k * 104729 % 750 / 1000.0
    corners = [crs.to_grid(lat + a, lng + b, crs.GRID_2000_21) for a, b in ((0, 0), (0, 0.001), (0.001, 0.001), (0.001, 0), (0, 0))]
    text = F.concat_ws(" ", *(F.format_string("%.4f %.4f", c["north"], c["east"]) for c in corners))
    return F.struct(F.struct(F.struct(F.struct(text.alias("gml:posList")).alias("gml:LinearRing")).alias("gml:exterior")).alias("gml:Polygon"))


def _ref(there, prefix: str, k):
    return F.when(there, F.struct(F.concat(F.lit(prefix), k.cast("string")).alias("_xlink:href")))


#: Of a written file, which one task has to read.
ROWS_A_FILE = 50_000


def _write_xml(df: DataFrame, folder: str, root: str, row: str) -> None:
    """Compressed and without indents: tags are most of the text, which would be many times its table."""
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "indent": ""}
    df.write.format("xml").options(rootTag=root, rowTag=row, validateName=False, maxRecordsPerFile=ROWS_A_FILE, **packed).save(folder)


def registry_files(spark, sf, *only: str) -> dict[str, str]:
    """Folders by type: lines as transactions of parts (properties with a unit), which have a supplier's parcel, building and address; orders as documents.

    Of the types named, if any: a query that reads one type has no use for the others' files.
    """
    folder = shared_folder(spark, "registry")
    ident = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string")).alias("_gml:id")
    k, n, p, s, o = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p_partkey"), F.col("s_suppkey"), F.col("o_orderkey")
    key = k * 10 + n
    own = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s"))
    parts = t(spark, sf, "part").join(own, "p_partkey", "left").select("p_partkey", F.coalesce("s", F.lit(1).cast("long")).alias("s"))
    if not only:
        parts = cut(parts)  # two types are made of them
    suppliers = t(spark, sf, "supplier")
    kinds = {
        "RCN_Transakcja": t(spark, sf, "lineitem").select(
            ident("T", key), F.when(n != 2, F.concat(F.lit("TX/"), key.cast("string"))).alias("rcn:oznaczenieTransakcji"), F.when(n == 5, "2").otherwise("1").alias("rcn:rodzajTransakcji"),
            F.when(F.col("l_linestatus") == "O", "1").otherwise("2").alias("rcn:rodzajRynku"), F.col("l_extendedprice").cast("string").alias("rcn:cenaTransakcjiBrutto"), _ref(k % 11 != 0, "D", k).alias("rcn:podstawaPrawna"),
            _ref(key % 19 != 0, "N", F.col("l_partkey")).alias("rcn:nieruchomosc")),
        "RCN_Dokument": t(spark, sf, "orders").select(ident("D", o), F.when(o % 13 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("rcn:dataSporzadzeniaDokumentu")),
        "RCN_Nieruchomosc": parts.select(ident("N", p), _ref(p % 9 != 0, "L", p).alias("rcn:lokal"), _ref(p % 5 != 0, "P", F.col("s")).alias("rcn:dzialka"), _ref(F.lit(True), "B", F.col("s")).alias("rcn:budynek"), _pos(p + 1, p % 4 == 1).alias("rcn:geometria")),
        "RCN_Lokal": parts.select(ident("L", p), F.when(p % 8 == 0, "2").otherwise("1").alias("rcn:funkcjaLokalu"), (p % 7).cast("string").alias("rcn:nrKondygnacji"), F.when(p % 6 != 0, F.concat((p % 90 + 10).cast("string"), F.lit(".5"))).alias("rcn:powUzytkowaLokalu"),
            (p % 5).cast("string").alias("rcn:liczbaIzb"), _ref(p % 3 != 0, "A", F.col("s")).alias("rcn:adresBudynkuZLokalem"), _pos(p, p % 4 == 0).alias("rcn:georeferencja")),
        "RCN_Adres": suppliers.select(ident("A", s), F.concat(F.lit("ul. Mała "), (s % 40).cast("string")).alias("rcn:ulica"), F.when(s % 4 != 0, (s % 99).cast("string")).alias("rcn:numerPorzadkowy")),
        "RCN_Dzialka": suppliers.select(ident("P", s), F.concat(F.lit(" 126105_9."), s.cast("string"), F.lit(" ")).alias("rcn:idDzialki"), _pos(s + 2, s % 3 == 0).alias("rcn:georeferencja"), F.when(s % 2 == 0, _square(s)).alias("rcn:geometria")),
        "RCN_Budynek": suppliers.select(ident("B", s), _pos(s + 3, s % 3 == 1).alias("rcn:georeferencja")),
    }
    kinds = {kind: df for kind, df in kinds.items() if not only or kind in only}
    for kind, df in kinds.items():
        _write_xml(df, f"{folder}/{kind}", f"registry {NAMESPACES}", f"rcn:{kind}")
    return {kind: f"{folder}/{kind}" for kind in kinds}


REGISTRY_SQL = f"""with own as (select l_partkey, min(l_suppkey) as s from lineitem group by 1), pr as (select p_partkey as p, coalesce(s, 1) as s from part left join own on l_partkey = p_partkey),
a0 as (select p, {place_sql('p')} from pr where p % 4 = 0), a1 as (select p, {place_sql('(p + 1)')} from pr where p % 4 = 1), a2 as (select s_suppkey as s, {place_sql('(s_suppkey + 2)')} from supplier where s_suppkey % 3 = 0), a3 as (select s_suppkey as s, {place_sql('(s_suppkey + 3)')} from supplier where s_suppkey % 3 = 1),
x as (select l.*, l_orderkey * 10 + l_linenumber as key, pr.p, pr.s, p % 9 <> 0 as has_unit, p % 8 <> 0 as flat, case when p % 6 <> 0 then p % 90 + 10.5 end as area, o_orderdate, o_orderkey,
  coalesce(case when a0.lng < 21 and p % 9 <> 0 then [a0.lat, a0.lng] end, case when a1.lng < 21 then [a1.lat, a1.lng] end, case when a2.lng < 21 and p % 5 <> 0 then [a2.lat, a2.lng] end, case when a3.lng < 21 then [a3.lat, a3.lng] end) as spot
  from lineitem l left join pr on pr.p = l_partkey and (l_orderkey * 10 + l_linenumber) % 19 <> 0 left join a0 using (p) left join a1 using (p) left join a2 on a2.s = pr.s left join a3 on a3.s = pr.s left join orders on o_orderkey = l_orderkey and l_orderkey % 11 <> 0 and l_orderkey % 13 <> 0),
y as (select case when l_linenumber = 2 then 'T' else 'TX/' end || key as transaction_id, case when p is not null and p % 9 <> 0 then area end as area, cast(o_orderdate as date) as date, l_extendedprice as price, spot, case when l_linestatus = 'O' then 1 else 2 end as market, p, s,
  case when l_linenumber = 5 then 'not_sale' when p is null or p % 9 = 0 or p % 8 = 0 then 'not_flat' when spot is null then 'no_place' when o_orderkey is null then 'no_date' end as reason from x)"""


@query(REGISTRY_SQL + """ select transaction_id, strftime(date, '%Y-%m-%d') as date, price, rnd(price / area, 4) as price_per_m2, area as area_m2, nullif(cast(p % 5 as integer), 0) as rooms, cast(p % 7 as varchar) as floor, case when p % 3 <> 0 then 'ul. Mała ' || (s % 40) end as street,
case when p % 3 <> 0 and s % 4 <> 0 then cast(s % 99 as varchar) end as street_number, market, rnd(spot[1], 6) as lat, rnd(spot[2], 6) as lng, case when p % 5 <> 0 and s % 2 = 0 then '126105_9.' || s end as parcel_id from y where reason is null""")
def registry_import(spark, sf):
    """What the import of the written files adds."""
    rows = registry.transactions(spark, registry_files(spark, sf), imported=True).drop("reason")
    return rows.withColumns({"date": F.date_format("date", "yyyy-MM-dd"), "price_per_m2": r("price_per_m2"), "lat": r("lat", 6), "lng": r("lng", 6)})


@query(REGISTRY_SQL + " select coalesce(reason, 'imported') as reason, count(*) as n from y group by 1")
def registry_skips(spark, sf):
    return registry.transactions(spark, registry_files(spark, sf)).groupBy(F.coalesce("reason", F.lit("imported")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(REGISTRY_SQL + """, u as (select transaction_id, max(case when p % 5 <> 0 and s % 2 = 0 then '126105_9.' || s end) as parcel_id from y where reason is null group by 1),
h as (select case when l_linenumber = 2 then 'T' else 'TX/' end || (l_orderkey * 10 + l_linenumber) as transaction_id, 'old' as parcel_id from lineitem where l_orderkey % 2 = 0)
select transaction_id, case when u.transaction_id is not null then u.parcel_id else h.parcel_id end as parcel_id from h left join u using (transaction_id)""")
def parcel_backfill(spark, sf):
    """Parcels of all transactions that were read, onto those that were held before."""
    updates = registry.transactions(spark, registry_files(spark, sf), imported=True).select("transaction_id", "parcel_id")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    held = t(spark, sf, "lineitem").filter("l_orderkey % 2 = 0").select(F.concat(F.when(F.col("l_linenumber") == 2, "T").otherwise("TX/"), key.cast("string")).alias("transaction_id"), F.lit("old").alias("parcel_id"))
    return registry.backfill(held, updates, "transaction_id", "parcel_id")


@query("""select '126105_9.' || s_suppkey as registry_id, rnd(49.85 + (s_suppkey * 7919 % 450) / 1000.0 + 0.0005, 6) as lat, rnd(19.65 + (s_suppkey * 104729 % 750) / 1000.0 + 0.0005, 6) as lng, 5 as corners from supplier where s_suppkey % 2 = 0""")
def registry_parcels(spark, sf):
    return registry.parcels(spark, registry_files(spark, sf, "RCN_Dzialka")).select("registry_id", r("lat", 6).alias("lat"), r("lng", 6).alias("lng"), F.size("ring").alias("corners"))


# ---- packages ---------------------------------------------------------------------------------------


def _geometry(x: pd.Series, y: pd.Series, k: pd.Series) -> pd.Series:
    """Points, with an envelope for every third key, polygons for every fourth, big-endian ones for every fifth, empty or cut ones at times."""

    def one(a: float, b: float, n: int) -> bytes:
        order, mark = (">", b"\0") if n % 5 == 0 else ("<", b"\1")
        head = b"GP\0" + bytes([(2 if n % 3 == 0 else 0) | (16 if n % 23 == 0 else 0)]) + struct.pack("<i", 2180) + (struct.pack("<4d", a, a, b, b) if n % 3 == 0 else b"")
        if n % 4 == 0:
            ring = [(a - 30, b - 20), (a + 30, b - 20), (a + 30, b + 20), (a - 30, b + 20)]
            body = mark + struct.pack(f"{order}III8d", 3, 1, 4, *(v for p in ring for v in p))
        else:
            body = mark + struct.pack(f"{order}I2d", 1, a, b)
        return (head + body)[: 20 if n % 29 == 0 else None]

    return pd.Series([one(a, b, int(n)) for a, b, n in zip(x, y, k, strict=True)])


def _shaped(df: DataFrame, k) -> DataFrame:
    lat, lng = F.lit(49.2) + k * 7919 % 1300 / 1000.0, F.lit(19.1) + k * 104729 % 2300 / 1000.0 + F.when(k % 31 == 0, 9).otherwise(0)
    at = crs.with_grid(df, lat, lng, crs.GRID_1992, "__east", "__north")
    return at.withColumn("geometry", F.when(k % 7 != 0, F.pandas_udf(_geometry, "binary")("__east", "__north", k)))


def package_tables(spark, sf) -> dict[str, DataFrame]:
    """Lines as parcels, orders as buildings, parts as units."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    market = lambda c: F.when(c % 3 == 0, "pierwotny").when(c % 3 == 1, "wtorny").otherwise("inny").alias("tran_rodzaj_rynku")
    parcel = _shaped(t(spark, sf, "lineitem"), k).select(
        F.when(k % 41 != 0, F.col("l_orderkey").cast("string")).alias("tran_lokalny_id_iip"), market(k), F.when(k % 8 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("dok_data"), F.concat(F.lit("P"), k.cast("string")).alias("dzi_id_dzialki"),
        F.when(k % 5 != 0, F.col("l_quantity") / 100).alias("dzi_pow_ewid"), F.lit(0.5).alias("nier_pow_gruntu"), F.when(k % 6 != 0, F.col("l_extendedprice")).alias("dzi_cena_brutto"), F.lit(1000.0).alias("tran_cena_brutto"),
        F.col("l_returnflag").alias("dzi_sposob_uzyt"), F.col("l_linestatus").alias("dzi_przezn_wmpzp"), "geometry")
    building = _shaped(t(spark, sf, "orders"), o).select(
        o.cast("string").alias("tran_lokalny_id_iip"), market(o), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dok_data"), F.when(o % 2 == 0, F.concat(F.lit("B"), o.cast("string"))).otherwise("").alias("bud_id_budynku"),
        F.when(o % 5 != 0, (o % 400).cast("double")).alias("bud_pow_uzyt"), F.lit(3.0).alias("nier_pow_gruntu"), F.lit(None).cast("double").alias("bud_cena_brutto"), F.when(o % 9 != 0, F.col("o_totalprice")).alias("tran_cena_brutto"), "geometry")
    unit = _shaped(t(spark, sf, "part"), p).select(
        p.cast("string").alias("tran_lokalny_id_iip"), market(p), F.lit("2020-05-01").alias("dok_data"), F.concat(F.lit("U"), p.cast("string")).alias("lok_id_lokalu"), (p % 80 + 1).cast("double").alias("lok_pow_uzyt"), F.col("p_retailprice").alias("lok_cena_brutto"),
        F.lit(None).cast("double").alias("tran_cena_brutto"), (p % 6).alias("lok_liczba_izb"), (p % 9).cast("string").alias("lok_nr_kond"), "geometry")
    return {"parcel": parcel, "building": building, "unit": unit}


def _there_sql(k: str, value: str) -> str:
    return f"case when {k} % 7 <> 0 and {k} % 23 <> 0 and {k} % 29 <> 0 and {k} % 31 <> 0 then {value} end"


def _at_sql(k: str) -> str:
    return f"{_there_sql(k, f'49.2 + ({k} * 7919 % 1300) / 1000.0')} as lat, {_there_sql(k, f'19.1 + ({k} * 104729 % 2300) / 1000.0')} as lng"


def _market_sql(k: str) -> str:
    return f"case {k} % 3 when 0 then 2 when 1 then 1 end as market"


PACKAGE_SQL = f"""with l as (select *, l_orderkey * 10 + l_linenumber as k from lineitem),
z as (select '1261-G/' || l_orderkey || '/P' || k as transaction_id, case when k % 8 <> 0 then cast(l_shipdate as date) end as date, case when k % 6 <> 0 then l_extendedprice else 1000.0 end as price, case when k % 5 <> 0 then l_quantity / 100 else 0.5 end * 10000 as area_m2, cast(null as integer) as rooms, cast(null as varchar) as floor,
  {_market_sql('k')}, 'parcel' as kind, {_at_sql('k')}, 'P' || k as parcel_id from l where k % 41 <> 0
union all select '1261-G/' || o_orderkey || case when o_orderkey % 2 = 0 then '/B' || o_orderkey else '' end, cast(o_orderdate as date), case when o_orderkey % 9 <> 0 then o_totalprice end, case when o_orderkey % 5 <> 0 then o_orderkey % 400 else 3.0 end, null, null, {_market_sql('o_orderkey')}, 'building', {_at_sql('o_orderkey')}, null from orders
union all select '1261-G/' || p_partkey || '/U' || p_partkey, date '2020-05-01', p_retailprice, p_partkey % 80 + 1, cast(p_partkey % 6 as integer), cast(p_partkey % 9 as varchar), {_market_sql('p_partkey')}, 'unit', {_at_sql('p_partkey')}, null from part)
"""


@query(PACKAGE_SQL + "select transaction_id, strftime(date, '%Y-%m-%d') as date, rnd(price, 2) as price, rnd(area_m2, 4) as area_m2, rnd(case when area_m2 >= 5 then price / area_m2 end, 4) as price_per_m2, rooms, floor, market, kind, rnd(lat, 6) as lat, rnd(lng, 6) as lng, parcel_id from z")
def package_rows(spark, sf):
    """All rows of the three tables in one shape, with coordinates out of their geometries."""
    rows = packages.transactions(package_tables(spark, sf), "1261").withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return rows.withColumns({"price": r("price", 2), "area_m2": r("area_m2"), "price_per_m2": r("price_per_m2"), "lat": r("lat", 6), "lng": r("lng", 6)})


@query(PACKAGE_SQL + """select kind, count(*) as n, count(lat) as placed from (select *, row_number() over (partition by transaction_id order by date, kind, price) as turn from z where date is not null and price is not null
and not (kind = 'parcel' and cast(substr(parcel_id, 2) as bigint) % 3 = 0)) where turn = 1 group by 1""")
def package_import(spark, sf):
    """What the import adds to a third of the parcels' rows that are held already."""
    rows = packages.transactions(package_tables(spark, sf), "1261")
    held = rows.filter((F.col("kind") == "parcel") & (F.substring("parcel_id", 2, 30).cast("long") % 3 == 0)).select("transaction_id")
    return packages.new_transactions(held, rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("placed"))


@query("""with l as (select *, l_orderkey * 10 + l_linenumber as k from lineitem),
o as (select *, case when k % 5 <> 0 then l_quantity / 100 end as ha, row_number() over (partition by k order by case when k % 8 <> 0 then cast(l_shipdate as date) else date '0001-01-01' end desc, case when k % 41 <> 0 then cast(l_orderkey as varchar) end desc nulls last, l_returnflag desc, l_linestatus desc, l_quantity desc) as turn from l)
select 'P' || k as parcel_id, l_returnflag as land_use, l_linestatus as zoning, rnd(ha, 4) as area_ha from o where turn = 1""")
def parcel_facts(spark, sf):
    return packages.parcel_facts(package_tables(spark, sf)["parcel"]).withColumn("area_ha", r("area_ha"))


def grid_sql(lat: str, lng: str, grid: crs.Grid) -> tuple[str, str]:
    """East and north by the forward formula."""
    e, k = 2 * crs.N**0.5 / (1 + crs.N), grid.scale * crs.RADIUS_M
    t_ = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    turn = f"radians({lng} - {grid.meridian})"
    xi, eta = f"atan({t_} / cos({turn}))", f"atanh(sin({turn}) / sqrt(1 + pow({t_}, 2)))"
    north = " + ".join([xi, *(f"({a!r}) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(crs.TO_GRID, 1))])
    east = " + ".join([eta, *(f"({a!r}) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(crs.TO_GRID, 1))])
    return f"{grid.east_m} + {k!r} * ({east})", f"({grid.north_m}) + {k!r} * ({north})"


EAST_SQL, NORTH_SQL = grid_sql("lat", "lng", crs.GRID_1992)


@query(f"""with p as (select c_custkey, 49.2 + (c_custkey * 7919 % 1300) / 1000.0 as lat, 19.1 + (c_custkey * 104729 % 2300) / 1000.0 as lng from customer)
select c_custkey, rnd({EAST_SQL}, 3) as east, rnd({NORTH_SQL}, 3) as north, rnd(lat, 7) as lat, rnd(lng, 7) as lng from p""")
def grid_round_trip(spark, sf):
    """Degrees to the national grid and back."""
    k = F.col("c_custkey")
    p = t(spark, sf, "customer").select("c_custkey", (F.lit(49.2) + k * 7919 % 1300 / 1000.0).alias("lat"), (F.lit(19.1) + k * 104729 % 2300 / 1000.0).alias("lng"))
    p = p.withColumn("at", crs.to_grid(F.col("lat"), F.col("lng"), crs.GRID_1992)).withColumn("back", crs.to_degrees(F.col("at.east"), F.col("at.north"), crs.GRID_1992))
    return p.select("c_custkey", r("at.east", 3).alias("east"), r("at.north", 3).alias("north"), r("back.lat", 7).alias("lat"), r("back.lng", 7).alias("lng"))


# ---- pages ------------------------------------------------------------------------------------------


def survey_files(spark, sf) -> str:
    """Customers' parcels on pages of the land survey; a third of them is on two pages, the second a year later."""
    folder = shared_folder(spark, "survey")
    k = F.col("c_custkey")
    lat, lng = F.lit(49.6) + k * 7919 % 900 / 1000.0, F.lit(19.2) + k * 104729 % 2000 / 1000.0 + F.when(k % 19 == 0, 5).otherwise(0)
    corners = [(0, 0), (0, 0.001), (0, 0.001), (0.0008, 0.001), (0.0008, 0), (0, 0)]
    pos = F.concat_ws(" ", *(F.format_string("%.6f %.6f", lat + a, lng + b) for a, b in corners))

    def page(df, year: int):
        return df.select(
            F.when(k % 23 != 0, F.concat(F.lit("126101_1."), k.cast("string"))).alias("ms:ID_DZIALKI"), F.concat(F.lit("Obręb "), (k % 7).cast("string")).alias("ms:NAZWA_OBREBU"), F.when(k % 4 != 0, "Gmina").alias("ms:NAZWA_GMINY"),
            F.when(k % 3 == 0, "brak_uprawnień").when(k % 3 == 1, " R ").alias("ms:KLASOUZYTKI_EGIB"), (k % 5 + year % 10).cast("string").alias("ms:GRUPA_REJESTROWA"), F.lit(f"{year}-01-01").alias("ms:DATA"),
            F.struct(F.struct(F.struct(F.struct(pos.alias("gml:posList")).alias("gml:LinearRing")).alias("gml:exterior")).alias("gml:Polygon")).alias("ms:msGeometry"),
        )

    c = t(spark, sf, "customer")
    pages = page(c, 2021).unionByName(page(c.filter(k % 3 == 2), 2022))
    _write_xml(pages, folder, 'FeatureCollection xmlns:ms="urn:ms" xmlns:gml="http://www.opengis.net/gml/3.2"', "ms:dzialki")
    return folder


@query("""with c as (select c_custkey as k, 49.6 + (c_custkey * 7919 % 900) / 1000.0 as lat from customer where c_custkey % 19 <> 0 and c_custkey % 23 <> 0)
select '126101_1.' || k as parcel_id, 4 as corners, 'Obręb ' || (k % 7) as district, case when k % 4 <> 0 then 'Gmina' end as commune, case when k % 3 = 1 then 'R' end as land_use_class, cast(k % 5 + case when k % 3 = 2 then 2 else 1 end as varchar) as register_group,
case when k % 3 = 2 then '2022-01-01' else '2021-01-01' end as as_of, rnd(0.0008 * 110574.0 * 0.001 * 111320.0 * cos(radians(lat + 0.0004)) / 10000, 3) as area_ha from c""")
def survey_parcels(spark, sf):
    """Parcels of the written pages, each once."""
    p = registry.survey_parcels(spark, survey_files(spark, sf))
    return p.select("parcel_id", F.size("ring").alias("corners"), "district", "commune", "land_use_class", "register_group", "as_of", r("area_ha", 3).alias("area_ha"))


@query("""with p as (select c_custkey as k, c_name, 49.9 + (c_custkey % 300) / 1000.0 as lat, 19.8 + (c_custkey % 400) / 1000.0 as lng from customer where c_custkey % 17 <> 0 and c_custkey % 13 <> 0)
select k // 10 as map, c_name || ' & park' as name, substr(sha1(c_name || ' & park|' || printf('%.6f', lat) || '|' || printf('%.6f', lng)), 1, 20) as external_id, rnd(lat, 6) as lat, rnd(lng, 6) as lng,
case k % 4 when 0 then 2024 when 1 then 1995 when 2 then 2031 end as year from p""")
def map_placemarks(spark, sf):
    """Ten customers a map file; some have no name or no coordinates."""
    k = F.col("c_custkey")
    said = F.element_at(F.array(*map(F.lit, ("<![CDATA[rok oddania: ok. 2024<br/>umowa z 2019]]>", "plan z 1950 i 1995 r.", "realizacja w 2031", "kod 20245 i nr 1899"))), (k % 4).cast("int") + 1)
    at = F.concat(F.format_string("%.3f", F.lit(19.8) + k % 400 / 1000.0), F.lit(","), F.format_string("%.3f", F.lit(49.9) + k % 300 / 1000.0), F.lit(",0"))
    mark = F.concat(F.lit('<Placemark id="x">'), F.when(k % 17 != 0, F.concat(F.lit("<name>"), F.col("c_name"), F.lit(" &amp; <b>park</b></name>"))).otherwise("<name> </name>"), F.lit("<description>"), said, F.lit("</description><Point><coordinates> "), F.when(k % 13 != 0, at).otherwise("x,y"), F.lit(" </coordinates></Point></Placemark>"))
    maps = t(spark, sf, "customer").groupBy(F.floor(k / 10).alias("map")).agg(F.concat(F.lit("<kml>"), F.concat_ws("\n", F.collect_list(mark)), F.lit("</kml>")).alias("kml"))  # ten marks a file
    return pages.placemarks(maps).select("map", "name", "external_id", r("lat", 6).alias("lat"), r("lng", 6).alias("lng"), "year")


@query(MEDIANS_SQL + """, c as (select p_brand, period, rnd(overall_median, 2) as m, overall_n as n, dense_rank() over (order by p_brand) % 5 as shape from w),
g as (select p_brand, max(period) as latest from c group by 1)
select lower(replace(p_brand, '#', '')) as slug, case when shape = 1 then lower(replace(p_brand, '#', '')) else p_brand end as name, latest as latest_quarter, period as quarter, m as median_m2, cast(n as double) as n from c join g using (p_brand) where shape <> 4 and m > 0""")
def embedded_series(spark, sf):
    """Brands' quarterly medians in the state of a city's page: nested, at the top, and broken ones."""
    from ..operators import prices

    m = prices.period_medians(branded(spark, sf), ["p_brand"], "l_shipdate", "unit")
    point = F.struct(F.col("period").alias("quarter"), r("overall_median", 2).alias("medianM2"), F.col("overall_n").alias("n"))
    cities = m.groupBy("p_brand").agg(F.collect_list(point).alias("trend"), F.max("period").alias("latestQuarter"))
    shape = F.dense_rank().over(Window.orderBy("p_brand")) % 5
    slug = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    city = F.to_json(F.struct(slug.alias("slug"), F.when(F.col("shape") != 1, F.col("p_brand")).alias("name"), "latestQuarter", "trend"))
    state = F.when(F.col("shape") == 4, "{not json").otherwise(F.concat(F.lit('{"other": 1, "cm-rcn-city:'), slug, F.lit('": '), F.when(F.col("shape") == 0, F.concat(F.lit('{"city": '), city, F.lit(', "peers": []}'))).otherwise(city), F.lit("}")))
    html_ = F.concat(F.lit('<html><script id="ng-state" type="application/json">'), state, F.lit("</script></html>"))
    given = cities.withColumn("shape", shape).select(slug.alias("slug"), html_.alias("html"))
    return pages.city_series(given)
