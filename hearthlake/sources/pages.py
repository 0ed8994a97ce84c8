"""Placemarks of map files and quarterly series that pages carry in their state, as columns over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import decode_entities, state_json

# The phrase before a year of delivery, plausible years, the script that holds a page's state and the key of a city's series.
DELIVERED = r"(?iu)(?:planowany termin oddania do u[żz]ytkowania|rok oddania|oddano do u[żz]ytkowania|realizacja)[^0-9]{0,50}((?:19|20)\d{2})"
FIRST_YEAR, LAST_YEAR, LONGEST = 1990, 2035, 2000
STATE, CITY_KEY = "ng-state", "cm-rcn-city:"


def clean(raw: Column) -> Column:
    """Text of an element: character data and tags off, breaks to lines, entities decoded, white space tidied; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s*<!\[CDATA\[", ""), r"\]\]>\s*$", "")
    lines = F.regexp_replace(F.regexp_replace(decode_entities(bare), r"(?i)<br\s*/?>", "\n"), "<[^>]+>", " ")
    return F.nullif(F.trim(F.regexp_replace(lines, r"\s+", " ")), F.lit(""))


def element(block: Column, tag: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))


def delivery_year(description: Column) -> Column:
    """The year of a delivery's phrase, else the first plausible year."""
    said = F.nullif(F.regexp_extract(description, DELIVERED, 1), F.lit("")).try_cast("int")
    years = F.transform(F.regexp_extract_all(description, F.lit(r"(?<!\w)((?:19|20)\d{2})(?!\w)"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(said, F.get(F.filter(years, lambda y: y.between(FIRST_YEAR, LAST_YEAR)), F.lit(0)))


def placemarks(maps: DataFrame, body: str = "kml") -> DataFrame:
    """maps with a row for each placemark that has a name and coordinates: place (its number), name, description, lat, lng, year, external_id."""
    blocks = F.posexplode(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<Placemark\b[^>]*>(.*?)</Placemark>"), F.lit(1))).alias("place", "__block")
    rows = maps.select(*(c for c in maps.columns if c != body), blocks)
    b = F.col("__block")
    at = F.split(clean(element(b, "coordinates")), ",")
    rows = rows.withColumns({"name": clean(element(b, "name")), "description": clean(element(b, "description")), "lng": F.trim(F.get(at, F.lit(0))).try_cast("double"), "lat": F.trim(F.get(at, F.lit(1))).try_cast("double")}).drop("__block")
    good = rows.filter("name is not null and lat is not null and lng is not null")
    ident = F.substring(F.sha1(F.concat_ws("|", "name", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lng"))), 1, 20)
    return good.withColumns({"external_id": ident, "year": delivery_year(F.col("description")), "description": F.left("description", F.lit(LONGEST))})


def city_series(pages: DataFrame, body: str = "html", slug: str = "slug") -> DataFrame:
    """pages with a row for each quarter of the city's series that the page's state holds: name, latest_quarter, quarter, median_m2, n.

    The series is nested under ``city``, or lies at the top in older pages. Pages whose state isn't JSON, has another city, no latest quarter or fewer than two good
    points have no rows.
    """
    state = state_json(F.col(body), STATE)
    # a key with a colon can't be a path: the state is read as a map of its top
    top = F.from_json(state.cast("string"), "map<string, string>")
    raw = F.try_element_at(top, F.concat(F.lit(CITY_KEY), F.col(slug)))
    shape = "slug string, name string, latestQuarter string, firstQuarter string, trend array<struct<quarter: string, medianM2: double, n: double>>"
    nested = F.from_json(raw, f"city struct<{', '.join(f'{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}' for c in shape.split(', ', 4))}>")["city"]
    found = F.coalesce(nested, F.from_json(raw, shape))
    rows = pages.withColumn("__city", found).filter((F.col("__city.slug") == F.col(slug)) & F.col("__city.latestQuarter").isNotNull())
    points = F.filter("__city.trend", lambda p: p["quarter"].isNotNull() & (p["medianM2"] > 0))
    rows = rows.withColumn("__points", points).filter(F.size("__points") >= 2)
    keep = [c for c in pages.columns if c != body]
    rows = rows.select(*keep, F.coalesce("__city.name", F.col(slug)).alias("name"), F.col("__city.latestQuarter").alias("latest_quarter"), F.explode("__points").alias("p"))
    return rows.select(*keep, "name", "latest_quarter", F.col("p.quarter").alias("quarter"), F.col("p.medianM2").alias("median_m2"), F.when(F.col("p.n") > 0, F.col("p.n")).otherwise(0.0).alias("n"))
