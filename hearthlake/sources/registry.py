"""The city registry's XML: features by type, joined along their references to one row a transaction.

Each type is one scan of the files by its row tag; a file is read by one task, feature by feature, so a large registry comes in
several files (any types in any of them). If the types lie in folders of their own, a path for each type spares the scans of the others' files. Positions lie at any depth of a feature, so what the schema doesn't name is kept
as text and searched. References may be hot (one property with a third of the transactions); the joins are equi-joins on
ids of a table with one row an id, which Spark splits where they are skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, geo

# Names of the format, and the bounds within which a coordinate is an easting or a northing.
TYPES = {
    "RCN_Transakcja": (["oznaczenieTransakcji", "rodzajTransakcji", "rodzajRynku", "cenaTransakcjiBrutto"], ["podstawaPrawna", "nieruchomosc"]),
    "RCN_Dokument": (["dataSporzadzeniaDokumentu"], []),
    "RCN_Nieruchomosc": ([], ["lokal", "dzialka", "budynek"]),
    "RCN_Lokal": (["funkcjaLokalu", "nrKondygnacji", "powUzytkowaLokalu", "liczbaIzb"], ["adresBudynkuZLokalem"]),
    "RCN_Adres": (["ulica", "numerPorzadkowy"], []),
    "RCN_Dzialka": (["idDzialki"], []),
    "RCN_Budynek": ([], []),
}
EASTINGS, NORTHINGS = (7_400_000.0, 7_460_000.0), (5_520_000.0, 5_580_000.0)
SALE, FLAT = "1", "1"


def number(text: Column) -> Column:
    """The number that a text begins with; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def _numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda p: p.try_cast("double"))


def _pair(a: Column, b: Column, first: Column) -> Column:
    """struct<lat, lng> of two coordinates of which the first or the second is the easting; null out of bounds."""
    sides = F.struct(F.when(first, a).otherwise(b).alias("east"), F.when(first, b).otherwise(a).alias("north"))
    return crs.once(sides, lambda p: F.when(p["east"].between(*EASTINGS) & p["north"].between(*NORTHINGS), crs.to_degrees(p["east"], p["north"], crs.GRID_2000_21)))


def position(text: Column) -> Column:
    """struct<lat, lng> of "northing easting" or the other way round; null if a part isn't a number."""

    def at(parts: Column) -> Column:
        good = (F.size(parts) >= 2) & ~F.exists(parts, lambda p: p.isNull() | F.isnan(p))
        a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        return F.when(good, _pair(a, b, a.between(*EASTINGS)))

    return crs.once(_numbers(text), at)


def ring(text: Column) -> Column:
    """array<struct<lat, lng>> of a list of coordinates; the first pair tells the order of all, pairs out of bounds are left out; null under 4 points."""

    def corners(parts: Column) -> Column:
        good = (F.size(parts) >= 6) & ~F.exists(parts, lambda p: p.isNull() | F.isnan(p))
        first = F.get(parts, F.lit(0)).between(*EASTINGS)
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda k: _pair(F.get(parts, 2 * k), F.get(parts, 2 * k + 1), first))
        known = first | F.get(parts, F.lit(1)).between(*EASTINGS)
        return F.filter(F.when(good & known, pairs), lambda p: p.isNotNull())

    return crs.once(crs.once(_numbers(text), corners), lambda out: F.when(F.size(out) >= 4, out))


def features(spark: SparkSession, path: str | dict[str, str], kind: str) -> DataFrame:
    """id, the fields and references of a type, pos_text, ring_text (null if there is none). ``path`` has files of all types, or is a path by type."""
    path = path[kind] if isinstance(path, dict) else path
    fields, refs = TYPES[kind]
    columns = ["_id string", *(f"{f} array<string>" for f in fields), *(f"{r} array<struct<_href: string>>" for r in refs), "xs_any array<string>"]
    reader = spark.read.format("xml").option("rowTag", kind).option("ignoreNamespace", True).option("multiLine", True).option("recursiveFileLookup", True)
    rest = F.array_join(F.coalesce("xs_any", F.array().cast("array<string>")), " ")
    inside = lambda tag: F.nullif(F.regexp_extract(rest, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>([^<]*)</", 1), F.lit(""))
    one = [F.array_join(f, "").alias(f) for f in fields]
    last = [F.try_element_at(F.filter(F.transform(r, lambda x: x["_href"]), lambda h: h.isNotNull()), F.lit(-1)).alias(r) for r in refs]
    return reader.schema(", ".join(columns)).load(path).select(F.col("_id").alias("id"), *one, *last, inside("pos").alias("pos_text"), inside("posList").alias("ring_text"))


def parcels(spark: SparkSession, path: str | dict[str, str]) -> DataFrame:
    """id, registry_id, ring, lat, lng (the box's centre), south, north, west, east: parcels with a usable surface."""
    p = features(spark, path, "RCN_Dzialka").select("id", F.trim("idDzialki").alias("registry_id"), ring(F.col("ring_text")).alias("ring")).filter("registry_id <> '' and ring is not null")
    lats, lngs = F.transform("ring", lambda q: q["lat"]), F.transform("ring", lambda q: q["lng"])
    p = p.withColumns({"south": F.array_min(lats), "north": F.array_max(lats), "west": F.array_min(lngs), "east": F.array_max(lngs)})
    return p.withColumns({"lat": (F.col("south") + F.col("north")) / 2, "lng": (F.col("west") + F.col("east")) / 2})


def transactions(spark: SparkSession, path: str | dict[str, str], imported: bool = False) -> DataFrame:
    """One row for each transaction; ``reason`` tells why it isn't imported (not_sale, not_flat, no_place, no_date; null if it is).

    transaction_id, date, price, price_per_m2, area_m2, rooms, floor, street, street_number, market, lat, lng, parcel_id, reason. The point is
    the unit's own, else the property's, the parcel's, the building's. With ``imported`` there are only those without a reason.

    Properties get all that they refer to first, so that the transactions, by far the most rows, are moved twice only: to their documents and to
    their properties.
    """
    at = lambda df: df.withColumn("at", position(F.col("pos_text")))
    prop = at(features(spark, path, "RCN_Nieruchomosc")).select(F.col("id").alias("nieruchomosc"), "lokal", "dzialka", "budynek", F.col("at").alias("at1"))
    unit = at(features(spark, path, "RCN_Lokal")).select(F.col("id").alias("lokal"), "funkcjaLokalu", "nrKondygnacji", "powUzytkowaLokalu", "liczbaIzb", "adresBudynkuZLokalem", F.col("at").alias("at0"))
    parcel = at(features(spark, path, "RCN_Dzialka")).select(F.col("id").alias("dzialka"), F.col("at").alias("at2"), F.when(ring(F.col("ring_text")).isNotNull(), F.nullif(F.trim("idDzialki"), F.lit(""))).alias("parcel_id"))
    building = at(features(spark, path, "RCN_Budynek")).select(F.col("id").alias("budynek"), F.col("at").alias("at3"))
    document = features(spark, path, "RCN_Dokument").select(F.col("id").alias("podstawaPrawna"), F.try_to_timestamp(F.trim("dataSporzadzeniaDokumentu")).alias("date"))
    address = features(spark, path, "RCN_Adres").select(F.col("id").alias("adresBudynkuZLokalem"), F.nullif("ulica", F.lit("")).alias("street"), F.nullif("numerPorzadkowy", F.lit("")).alias("street_number"))
    j = prop.join(unit, "lokal", "left").join(parcel, "dzialka", "left").join(building, "budynek", "left").join(address, "adresBudynkuZLokalem", "left")
    place, size, rooms = F.coalesce("at0", "at1", "at2", "at3"), number(F.col("powUzytkowaLokalu")), number(F.col("liczbaIzb")).cast("int")
    whole = j.select(
        "nieruchomosc", F.coalesce(F.col("funkcjaLokalu") == FLAT, F.lit(False)).alias("flat"), F.when(size > 0, size).alias("area_m2"), F.when(rooms > 0, rooms).alias("rooms"), F.nullif("nrKondygnacji", F.lit("")).alias("floor"),
        "street", "street_number", place["lat"].alias("lat"), place["lng"].alias("lng"), place.isNotNull().alias("placed"), "parcel_id",
    )
    tx = features(spark, path, "RCN_Transakcja").select(
        F.coalesce("oznaczenieTransakcji", "id").alias("transaction_id"), F.coalesce(F.col("rodzajTransakcji") == SALE, F.lit(False)).alias("sale"), F.coalesce(number(F.col("cenaTransakcjiBrutto")), F.lit(0.0)).alias("price"),
        number(F.col("rodzajRynku")).cast("int").alias("market"), "podstawaPrawna", "nieruchomosc",
    )
    if imported:
        tx, document, whole, how = tx.filter("sale"), document.filter("date is not null"), whole.filter("flat and placed"), "inner"
    else:
        how = "left"
    j = tx.join(document, "podstawaPrawna", how).join(whole, "nieruchomosc", how)
    lacks = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~F.col("sale"), "not_sale").when(lacks("flat"), "not_flat").when(lacks("placed"), "no_place").when(F.col("date").isNull(), "no_date")
    return j.select("transaction_id", "date", "price", (F.col("price") / F.col("area_m2")).alias("price_per_m2"), "area_m2", "rooms", "floor", "street", "street_number", "market", "lat", "lng", "parcel_id", reason.alias("reason"))


# Elements of the land survey's pages, bounds of the tracked regions, the placeholder for a value that isn't shown.
SURVEY, REGION = {"parcel_id": "ID_DZIALKI", "district": "NAZWA_OBREBU", "commune": "NAZWA_GMINY", "land_use_class": "KLASOUZYTKI_EGIB", "register_group": "GRUPA_REJESTROWA", "as_of": "DATA"}, (48.5, 51.0, 18.5, 22.0)
NOT_SHOWN = "brak_uprawnie"


def degrees_ring(text: Column) -> Column:
    """array<struct<lat, lng>> of "lat lng lat lng ...", open and without points that repeat the one before; null if a number is missing, odd or out of the regions."""
    parts = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda p: p.try_cast("double"))
    at = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda k: F.struct(F.get(parts, 2 * k).alias("lat"), F.get(parts, 2 * k + 1).alias("lng")))
    south, north, west, east = REGION
    fits = F.forall(at, lambda p: F.coalesce(p["lat"].between(south, north) & p["lng"].between(west, east), F.lit(False)))
    good = (F.size(parts) >= 6) & (F.size(parts) % 2 == 0)

    def tidy(ring: Column) -> Column:
        distinct = F.filter(ring, lambda p, k: (k == 0) | (F.get(ring, F.greatest(k - 1, F.lit(0))) != p))
        return crs.once(distinct, lambda r: F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))

    return F.when(good, crs.once(at, lambda ring: F.when(fits, tidy(ring))))


def survey_parcels(spark: SparkSession, path: str) -> DataFrame:
    """parcel_id, ring, district, commune, land_use_class, register_group, as_of, area_ha of the land survey's pages; one row a parcel, that of
    several pages' copies with the latest date."""
    columns = ", ".join(f"{e} string" for e in SURVEY.values())
    pages = spark.read.format("xml").option("rowTag", "dzialki").option("ignoreNamespace", True).option("multiLine", True).option("recursiveFileLookup", True).schema(f"{columns}, xs_any array<string>").load(path)
    rest = F.array_join(F.coalesce("xs_any", F.array().cast("array<string>")), " ")
    lists = F.array_join(F.regexp_extract_all(rest, F.lit(r"(?s)<(?:\w+:)?posList(?:\s[^>]*)?>([^<]*)</"), F.lit(1)), "")
    shown = lambda c: F.when(~F.lower(F.trim(c)).startswith(NOT_SHOWN), F.nullif(F.trim(c), F.lit("")))
    named = {n: shown(F.col(e)) if n in ("land_use_class", "register_group") else F.nullif(F.col(e), F.lit("")) for n, e in SURVEY.items()}
    rows = pages.select(*(c.alias(n) for n, c in named.items()), degrees_ring(F.nullif(lists, F.lit(""))).alias("ring")).filter(F.col("parcel_id").isNotNull() & (F.size("ring") >= 3))
    newest = rows.groupBy("parcel_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "parcel_id")), F.struct(F.coalesce("as_of", F.lit("")), F.col("ring").cast("string"))).alias("x")).select("parcel_id", "x.*")
    return newest.withColumn("area_ha", geo.ring_area(F.col("ring")) / 10_000)


def backfill(held: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """held with ``column`` from updates where the key is among them, also if it is null there; the largest of several."""
    new = updates.groupBy(key).agg(F.max(column).alias("__new"), F.lit(True).alias("__there"))
    return held.join(new, key, "left").withColumn(column, F.when(F.col("__there"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__there")
