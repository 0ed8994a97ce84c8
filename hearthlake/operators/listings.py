"""Listing filters, visibility, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key, property_kind, street_number
from ..shared import cut, narrow


def offer_filter(kind: str) -> Column:
    """Four cases of offer type."""
    o = F.col("offer_type")
    return {"all": F.lit(True), "rental": o.isin("long_term_rental", "short_term_rental"), "short": o == "short_term_rental", "sale": o == "sale"}.get(kind, F.lit(True))


def visible(listings: DataFrame, offer: str = "all", source: str | None = None, kind: str | None = None, days: int = 0, as_of: Column | None = None) -> DataFrame:
    """Composed predicates; they reach the scan."""
    cond = F.col("is_visible") & offer_filter(offer)
    if source:
        cond &= F.col("source") == source
    if kind:
        cond &= F.lit(False) if kind == "public-investments" else F.col("property_kind") == kind
    if days:
        cond &= F.coalesce("listed_at", "first_seen_at") >= as_of - F.expr(f"interval {int(days)} days")
    return listings.filter(cond)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page by offset; order must be total. Sizes are clamped to 1..500, pages start at 1."""
    size = min(500, max(1, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def first_wins(df: DataFrame, keys: list[Column], order: list[Column], only: Column) -> DataFrame:
    """Drops the rows under ``only`` that aren't first of their key tuple; all other rows stay."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__turn", turn).filter(~only | (F.col("__turn") == 1)).drop("__turn")


def shown(rows: DataFrame, hidden_sources: tuple[str, ...] = ()) -> DataFrame:
    """The listings that a reader should see.

    rows: id, source, external_id, title, address, price, area_m2, rooms, district, investment_id, scraped_at.
    Stand-ins of an investment go once its flats are there; a developer portal's rows covered by the
    investment map go; of two portals that share a feed, one portal's row goes if an earlier row has
    the same price, area, rooms and district. What the map covers is one set of keys, broadcast if it is small: only the
    last rule shuffles the listings.
    """
    r = rows.filter(~F.col("source").isin(*hidden_sources)) if hidden_sources else rows
    im, stand_in = F.col("source") == "investmap", F.coalesce(F.col("external_id").startswith("inv-"), F.lit(False))
    street, number = street_number(F.col("address"))
    head, name, whole = F.get(F.split("title", " — "), F.lit(0)), norm_key(F.get(F.split("title", "—"), F.lit(0))), norm_key(F.col("title"))
    key = lambda tag, *parts: F.concat_ws("\u0001", F.lit(tag), *parts)
    given = lambda ok, k: F.when(ok, k)
    # what the map's own flats cover, as one set of keys
    flats = F.array(given(F.col("investment_id").isNotNull(), key("id", F.concat(F.lit("inv-"), "investment_id"))), given(head.isNotNull(), key("title", head)))
    own = F.array(given(street.isNotNull() & number.isNotNull(), key("house", street, number)), given(street.isNotNull(), key("street", street)), given(name != "", key("name", name)))
    covered = cut(r.filter(im & ~stand_in).select(F.explode(F.array_compact(F.concat(flats, own))).alias("key")).distinct())
    first = narrow(covered)
    tests = {"__a": given(im & stand_in, key("id", "external_id")), "__b": given(im & stand_in, key("title", "title"))}
    kept = r.withColumns(tests)
    for k in tests:
        kept = kept.join(first.withColumnRenamed("key", k), k, "left_anti")
    kept = kept.select(*rows.columns)
    # a stand-in that goes covers nothing itself
    left = kept.filter(im & stand_in).select(F.explode(F.array_compact(own)).alias("key"))
    second = narrow(cut(covered.unionByName(left).distinct()))
    rp = F.col("source") == "rynekpierwotny"
    tests = {"__a": given(rp & street.isNotNull() & number.isNotNull(), key("house", street, number)), "__b": given(rp, key("name", whole)), "__c": given(rp & number.isNull() & street.isNotNull(), key("street", street))}
    rest = kept.withColumns(tests)
    for k in tests:
        rest = rest.join(second.withColumnRenamed("key", k), k, "left_anti")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("price", "area_m2", "rooms", "district")]
    return first_wins(rest.select(*rows.columns), keys, [F.desc("scraped_at"), F.desc("id")], F.col("source") == "gratka")


def derived(rows: DataFrame, buildings: DataFrame, now: Column, hidden_sources: tuple[str, ...] = ()) -> DataFrame:
    """rows with property_kind, is_visible, map_lat and map_lng made anew, derived_at, and ``changed``: whether any of the four is another than before.

    rows: as for shown, with property_type, building_id, lat, lng and the four as they were; buildings: building_id, lat, lng. An offer's place
    on the map is its building's, else its own.
    """
    at = buildings.select("building_id", F.col("lat").alias("__lat"), F.col("lng").alias("__lng"))
    # visible ids as one narrow table; rows are joined with it once
    seen = shown(rows.select("id", "source", "external_id", "title", "address", "price", "area_m2", "rooms", "district", "investment_id", "scraped_at"), hidden_sources).select("id", F.lit(True).alias("__seen"))
    j = rows.join(at, "building_id", "left").join(seen, "id", "left")
    made = {"property_kind": property_kind(F.col("source"), F.col("title"), F.col("property_type"), F.col("external_id")), "is_visible": F.coalesce("__seen", F.lit(False)), "map_lat": F.coalesce("__lat", "lat"), "map_lng": F.coalesce("__lng", "lng")}
    same = None
    for c, new in made.items():
        one = F.col(c).eqNullSafe(new)
        same = one if same is None else same & one
    return j.withColumn("changed", ~same).withColumns(made | {"derived_at": now}).select(*rows.columns, "derived_at", "changed")
