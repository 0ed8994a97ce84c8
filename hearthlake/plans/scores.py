"""Queries of the alert score, its storage, prose and fees.

Customers stand for offers; their key gives the fields that the supplied tables don't have. The inputs are written once, as expressions that both
engines read alike; the oracle goes its own way from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prose
from ..operators import leaders, quality, scoring
from ..shared import spread
from .catalog import as_of, query, r, t

INPUTS = {
    "listing_id": "c_custkey", "segment": "case c_custkey % 3 when 0 then 'flat' when 1 then 'house' else 'plot' end", "region": "case when c_nationkey % 2 = 0 then 'malopolskie' else 'slaskie' end",
    "city": "case c_custkey % 4 when 0 then 'krakow' when 1 then 'katowice' when 2 then 'gdow' end", "title": "c_name", "description": "case c_custkey % 6 when 0 then 'ogrzewanie miejskie, w bloku' when 1 then 'bez ogrzewania gazowego' when 2 then 'media na miejscu, mpzp' when 3 then 'brak mediow, kamienica' end",
    "price": "case when c_custkey % 41 <> 0 then 200000 + abs(c_acctbal) * 30 end", "area_m2": "case when c_custkey % 43 <> 0 then 30.0 + c_custkey % 90 end", "plot_area_m2": "case when c_custkey % 5 <> 0 then (c_custkey % 23) * 100.0 end", "rooms": "case when c_custkey % 7 <> 0 then c_custkey % 5 end",
    "floor": "case c_custkey % 9 when 0 then 'parter' when 1 then 'suterena' when 2 then '2/4' when 3 then '5' when 4 then 'floor 9' end", "build_year": "case when c_custkey % 8 <> 0 then 1930 + c_custkey % 95 end", "building_material": "case c_custkey % 10 when 0 then 'brick' when 1 then 'wielka płyta' when 2 then 'wood' when 3 then 'concrete' end",
    "condition": "case c_custkey % 11 when 0 then 'good' when 1 then 'new' when 2 then 'poor' end", "ownership": "case c_custkey % 13 when 0 then 'leasehold' when 1 then 'full_ownership' when 2 then 'share' end", "heating_type": "case c_custkey % 14 when 0 then 'gazowe' when 1 then 'MPEC' when 2 then 'heat pump' when 3 then ' ' end",
    "features_heating": "case c_custkey % 15 when 0 then 'electric' when 1 then 'urban' end", "building_type": "case c_custkey % 12 when 0 then 'detached' when 1 then 'block' when 2 then 'tenement' when 3 then 'apartment' end", "plot_type": "case c_custkey % 16 when 2 then 'budowlana' when 5 then 'rolna' when 8 then 'rekreacyjna' when 11 then 'siedliskowa' end",
    "has_balcony": "c_custkey % 2 = 0", "has_terrace": "c_custkey % 17 = 0", "has_garden": "c_custkey % 7 = 3", "has_elevator": "c_custkey % 5 = 1", "has_parking": "c_custkey % 3 = 2", "has_garage": "c_custkey % 19 = 4", "has_basement": "c_custkey % 11 = 5", "auction_type": "case when c_custkey % 21 = 0 then 'court' end",
    "lat": "case when c_custkey % 37 <> 0 then 50.0 + (c_custkey * 7919 % 400) / 1000.0 end", "lng": "case when c_custkey % 37 <> 0 then 19.0 + (c_custkey * 104729 % 1000) / 1000.0 end", "geo_known": "c_custkey % 37 <> 0", "placeholder_point": "c_custkey % 53 = 0",
    "tram_m": "case when c_custkey % 3 <> 1 then (c_custkey * 31 % 1800) * 1.0 end", "train_m": "(c_custkey * 37 % 6000) * 1.0", "bus_m": "case when c_custkey % 6 <> 0 then (c_custkey * 41 % 3500) * 1.0 end", "center_m": "(c_custkey * 43 % 16000) * 1.0", "rail_line_m": "case when c_custkey % 4 <> 0 then (c_custkey * 47 % 900) * 1.0 end",
    "park_m": "(c_custkey * 53 % 2500) * 1.0", "park_count": "(c_custkey % 4) * 1.0", "forest_m": "(c_custkey * 59 % 3000) * 1.0", "forest_share": "(c_custkey % 26) / 25.0", "lake_m": "case when c_custkey % 3 = 0 then (c_custkey * 61 % 3000) * 1.0 end", "river_m": "case when c_custkey % 5 <> 2 then (c_custkey * 67 % 2800) * 1.0 end",
    "water_m": "(c_custkey * 71 % 3500) * 1.0", "water_share": "(c_custkey % 13) / 25.0", "road_m": "(c_custkey * 73 % 700) * 1.0", "road_class": "case when c_custkey % 4 = 1 then 'asfalt' end", "plan_count": "(c_custkey % 3) * 1.0", "zoning_wz": "c_custkey % 8 = 1", "zoning_no_plan": "c_custkey % 8 = 2", "flood_risk": "c_custkey % 18 = 0",
    "slope_deg": "(c_custkey % 30) * 1.0", "coverage": "(c_custkey % 10) / 10.0", "nearest_building_m": "case when c_custkey % 6 <> 5 then (c_custkey * 79 % 700) * 1.0 end", "buildings_150m": "case when c_custkey % 6 <> 5 then (c_custkey % 7) * 1.0 end", "str_offers": "(c_custkey * 83 % 150) * 1.0", "str_sample": "(c_custkey % 12) * 1.0",
    "str_nightly": "(c_custkey * 89 % 800) * 1.0", "est_n": "case when c_custkey % 25 <> 0 then c_custkey * 3 % 31 end", "est_rcn": "c_custkey % 6", "est_spread": "(c_custkey * 97 % 50) * 1.0", "est_level": "case c_custkey % 3 when 0 then 'high' when 1 then 'low' else 'medium' end", "est_factor": "0.8 + (c_custkey % 19) / 20.0",
    "est_fair": "case when c_custkey % 25 <> 0 then (200000 + abs(c_acctbal) * 30) * (0.8 + (c_custkey * 7 % 83) / 50.0) end",
}


def offers(spark, sf) -> DataFrame:
    return spread(t(spark, sf, "customer"), "c_custkey").select(*(F.expr(e).alias(name) for name, e in INPUTS.items()))


def bands_sql(m: str, bands) -> str:
    limits, fallback = bands
    return f"case when {m} is null then {fallback} " + " ".join(f"when {m} <= {limit} then {p}" for limit, p in limits) + f" else {fallback} end"


ZONES_SQL = " union all ".join(f"select '{c}' as c, {a} as a, {b} as b" for (c, _), (a, b) in scoring.ANCHORS.items())
RAILS_SQL = " union all ".join(f"select {a} as a, {b} as b, {str(p).lower()} as planned" for a, b, p in scoring.STATIONS.values())
FAR_SQL = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(a - lat) / 2), 2) + cos(radians(lat)) * cos(radians(a)) * pow(sin(radians(b - lng) / 2), 2))))"

SCORE_SQL = f"""with i0 as (select {', '.join(f'{e} as {name}' for name, e in INPUTS.items())} from customer),
z as (select listing_id, min({FAR_SQL}) filter (city is null or city = 'gdow' or city = c) as zone_m from i0, ({ZONES_SQL}) group by 1),
q as (select listing_id, min_by(planned, d) as planned, min(d) as rail_m from (select listing_id, planned, {FAR_SQL} as d from i0, ({RAILS_SQL}) where abs(a - lat) <= 25000.0 / 111320) where d <= 25000 group by 1),
i as (select i0.*, zone_m, rail_m, coalesce(planned, false) as planned, coalesce(build_year >= 0, false) as aged, lower(coalesce(building_material, '')) as mat, lower(coalesce(building_type, '')) as bt, lower(coalesce(plot_type, '')) as pt,
  case when trim(heating_type) <> '' then case heating_type when 'gazowe' then 'gas' when 'MPEC' then 'district' else 'heatPump' end when features_heating is not null then case features_heating when 'urban' then 'district' else 'electric' end when description = 'ogrzewanie miejskie, w bloku' then 'district' else 'unknown' end as heat,
  coalesce(city in ('krakow', 'katowice'), false) and segment = 'flat' as tramflat, segment = 'flat' as flat, segment = 'house' as house, segment = 'plot' as plot, coalesce(price > 0 and est_fair > 0, false) as known from i0 left join z using (listing_id) left join q using (listing_id)),
j as (select *, 1 - price / est_fair as off, case when build_year >= 2015 then 8 when build_year >= 2000 then 5 when build_year >= 1980 then 1 when build_year >= 1960 then -2 when build_year is not null then -4 else 0 end as yp, case condition when 'good' then 4 when 'new' then 8 when 'poor' then -8 else 0 end as cp,
  case heat when 'district' then 8 when 'heatPump' then 8 when 'gas' then -7 when 'electric' then -12 else 0 end as hp, case ownership when 'full_ownership' then 4 when 'leasehold' then -8 when 'share' then -8 else 0 end as op, case mat when 'wielka płyta' then -12 when 'brick' then 4 when 'concrete' then 3 when 'wood' then 2 else 0 end as mp,
  case when bt = 'block' or mat = 'wielka płyta' then 'largePanel' when bt = 'tenement' then 'tenement' when bt = 'apartment' then 'apartmentBuilding' when mat in ('brick', 'concrete', 'wood') then mat end as style,
  case when bt = 'detached' then 'house' when mat = 'wielka płyta' then 'oldBlock' when bt = 'tenement' or description = 'brak mediow, kamienica' or build_year <= 1945 then 'tenement' when bt = 'apartment' then 'apartment'
    when bt = 'block' or description = 'ogrzewanie miejskie, w bloku' then case when build_year >= 2000 then 'newBlock' when build_year is not null then 'oldBlock' else 'block' end else 'unknown' end as class,
  case floor when 'parter' then 0 when 'suterena' then -1 when '2/4' then 2 when '5' then 5 when 'floor 9' then 9 end as fl from i),
v as (select *, case when not known then 40 when off <= -0.3 then 0 when off >= 0.3 then 100 when off <= -0.2 then (off + 0.3) / 0.1 * 5 when off <= -0.1 then 5 + (off + 0.2) / 0.1 * 15 when off <= 0 then 20 + (off + 0.1) / 0.1 * 30 when off <= 0.1 then 50 + off / 0.1 * 30 when off <= 0.2 then 80 + (off - 0.1) / 0.1 * 15 else 95 + (off - 0.2) / 0.1 * 5 end as vs,
  case when not known then 0.15 else greatest(0.05, least(1, case when plot and est_rcn < 3 then 0.65 else case est_level when 'high' then 0.95 when 'medium' then 0.75 else 0.45 end end * greatest(0.2, least(1.0, (coalesce(est_n, 0) - 2) / 18.0))
    * case when plot then greatest(0.7, case when est_spread <= 10 then 1 when est_spread >= 40 then 0.45 else 1 - (est_spread - 10) / 60 end) else case when est_spread <= 10 then 1 when est_spread >= 40 then 0.45 else 1 - (est_spread - 10) / 60 end end * case when est_rcn < 3 then case when plot then 0.9 else 0.85 end else 1 end)) end as vc,
  case when not geo_known then 45 else greatest(0, least(100, case when tramflat then ({bands_sql('tram_m', scoring.TRAM)}) * 0.45 + ({bands_sql('train_m', scoring.TRAIN)}) * 0.15 + ({bands_sql('bus_m', scoring.BUS)}) * 0.1 + ({bands_sql('zone_m', scoring.ZONE)}) * 0.3
    when flat then ({bands_sql('train_m', scoring.TRAIN)}) * 0.4 + ({bands_sql('bus_m', scoring.BUS)}) * 0.15 + ({bands_sql('zone_m', scoring.ZONE)}) * 0.45
    else ({bands_sql('train_m', scoring.TRAIN)}) * 0.25 + ({bands_sql('bus_m', scoring.BUS)}) * 0.1 + ({bands_sql('center_m', scoring.CENTRE)}) * 0.15 + ({bands_sql('rail_m', scoring.RAIL)}) * 0.5 end - case when rail_line_m < 100 then 20 when rail_line_m < 200 then 12 when rail_line_m < 400 then 5 else 0 end)) end as ts,
  case when not geo_known then 45 else greatest(0, least(100, ({bands_sql('park_m', scoring.PARK)}) * 0.3 + (({bands_sql('forest_m', scoring.NATURE)}) * 0.65 + forest_share * 35) * 0.35 + least(100, greatest({bands_sql('lake_m', scoring.NATURE)}, {bands_sql('river_m', scoring.NATURE)}) + least(10, water_share * 25)) * 0.35 + least(8, park_count * 4))) end as gs,
  (case when build_year <= 1945 then 10 when build_year <= 1980 then 6 else 0 end + case when mat = 'wood' then 12 else 0 end + case when plot_area_m2 >= 1500 then 6 else 0 end + case when nearest_building_m >= 500 then 20 when nearest_building_m >= 250 then 14 when nearest_building_m >= 100 then 10 else 0 end + case when buildings_150m = 0 then 10 when buildings_150m <= 4 then 4 else 0 end) as charm,
  greatest(0, least(100, 85 - case when not geo_known then 20 else 0 end - case when est_n is null then 15 when est_n < 5 then 10 else 0 end - case when est_spread > 30 then 8 else 0 end - case when est_factor > 1.35 and est_factor <= 1.6 then 8 else 0 end - case when rail_line_m < 200 then 15 else 0 end - case when flood_risk then 20 else 0 end
    - case when ownership in ('leasehold', 'share') then 12 else 0 end - case when auction_type is not null then 10 else 0 end - case when price is null or area_m2 is null then 10 else 0 end)) as rs from j),
p as (select *, greatest(0, least(100, case when flat then 60 + case when fl < 0 then -25 when fl = 0 then case when has_garden or has_terrace then -2 else -8 end when fl <= 3 then 6 when fl <= 6 then case when has_elevator then 3 else -3 end when fl > 6 then case when has_elevator then 3 else -10 end else 0 end + yp
    + case style when 'largePanel' then -12 when 'tenement' then 10 when 'apartmentBuilding' then 8 when 'brick' then 4 when 'concrete' then 3 when 'wood' then 2 else mp end + cp + case when has_balcony then 2 else 0 end + case when has_terrace then 3 else 0 end + case when has_garden then 3 else 0 end + case when has_elevator then 4 else 0 end
    + case when has_parking then 4 else 0 end + case when has_garage then 4 else 0 end + case when has_basement then 2 else 0 end + case when rooms is null then 0 when rooms = 1 then -2 when rooms <= 3 then 5 else 2 end + hp + op
  when house then 60 + case when plot_area_m2 >= 1000 then 8 when plot_area_m2 >= 500 then 5 when plot_area_m2 < 200 then -8 else 0 end + case when bt = 'detached' then 6 else 0 end + yp + cp + case when bt = 'tenement' then 0 else mp end + hp + op + case when has_garage then 6 else 0 end + case when has_garden then 8 else 0 end
    + case when has_terrace then 3 else 0 end + case when has_parking then 5 else 0 end + case when has_basement then 3 else 0 end + charm - case when nearest_building_m < 25 then 12 else 0 end
  else 60 + case pt when 'budowlana' then 10 when 'rolna' then -10 when 'siedliskowa' then 4 when 'rekreacyjna' then -2 else 0 end + case when coalesce(plot_area_m2, area_m2) >= 1500 then 3 when coalesce(plot_area_m2, area_m2) >= 500 then 5 when coalesce(plot_area_m2, area_m2) < 300 then -8 else 0 end + case when road_m <= 50 then 8 when road_m <= 150 then 4 when road_m > 500 then -6 else 0 end
    + case when road_class is not null then 4 else 0 end + case when zoning_wz then 6 else 0 end - case when zoning_no_plan then 4 else 0 end + case when plan_count > 0 then 4 else 0 end - case when flood_risk then 12 else 0 end - case when slope_deg > 25 then 10 when slope_deg > 15 then 5 else 0 end + case when coverage < 0.2 then 3 else 0 end
    + case when description = 'media na miejscu, mpzp' then 8 when description = 'brak mediow, kamienica' then -4 else 0 end + case when description = 'media na miejscu, mpzp' and not zoning_wz and plan_count = 0 then 4 else 0 end end)) as ps,
  sqrt(greatest(coalesce(plot_area_m2, area_m2, 0), 0) / pi()) + 20 as beside from v),
b as (select *, case when heat in ('district', 'heatPump') then 5 else 0 end + case when flat and zone_m <= 4000 then 6 else 0 end + case when plot and rail_m <= 20000 then case when planned then 12 else 8 end else 0 end + case when house and least(lake_m, river_m, water_m) <= 300 then 8 else 0 end + case when house and forest_m <= 300 then 6 else 0 end
  + case when house and park_m <= 500 then 5 else 0 end + case when house and nearest_building_m >= 500 then 14 when house and nearest_building_m >= 100 then 6 else 0 end + case when house and str_sample >= 5 then case when str_nightly >= 600 then 6 when str_nightly >= 400 then 4 when str_nightly >= 250 then 2 else 0 end else 0 end
  + case when flat then 0 when str_offers >= 120 then 6 when str_offers >= 60 then 4 when str_offers >= 30 then 2 else 0 end + case when tramflat and tram_m <= 300 then 5 else 0 end + case when train_m <= 1000 then 5 else 0 end
  + case when plot then case when forest_m <= beside then 9 when forest_m <= 3000 then 1 else 0 end + case when water_m <= beside then 6 when water_m <= 3000 then 0.7 else 0 end else case when park_m <= 300 then 3 else 0 end + case when water_m <= 500 then 2 else 0 end end
  + case when has_elevator then 2 else 0 end + case when has_parking or has_garage then 2 else 0 end as bonus, case segment when 'flat' then [0.3, 0.2, 0.2, 0.25, 0.05] when 'house' then [0.3, 0.1, 0.3, 0.25, 0.05] else [0.25, 0.15, 0.28, 0.27, 0.05] end as w from p),
s as (select *, w[1] * vc + w[2] * case when geo_known then 0.85 else 0.2 end + w[3] * case when geo_known then 0.8 else 0.2 end + w[4] * case when flat then 0.65 when house then 0.6 else 0.55 end + w[5] * 0.75 as sure, (w[1] * vs + w[2] * ts + w[3] * gs + w[4] * ps + w[5] * rs) / (w[1] + w[2] + w[3] + w[4] + w[5]) as raw, case when known then off * 100 end as pct from b),
x as (select *, greatest(0, least(100, 50 + (raw - 50) * (0.65 + 0.35 * sure))) as mid, coalesce(est_fair > 0 and est_n is not null, false) as est from s),
g as (select *, concat_ws(',', case when placeholder_point then 'placeholder_coordinates' end, case when flat and class = 'oldBlock' then 'old_block' end, case when flat and heat = 'unknown' then 'no_heating_evidence' end, case when flat and heat not in ('unknown', 'district', 'heatPump') then 'non_municipal_heating' end,
  case when flat and (zone_m is null or zone_m > 4000) then 'outside_centre_zone' end, case when plot and not (pt = 'budowlana' or zoning_wz or plan_count > 0) then 'not_building_plot' end,
  case when house and not (geo_known and (water_m <= 1000 or forest_m <= 800 or park_m <= 500 or forest_share >= 0.3 or water_share >= 0.2)) then 'no_nature_setting' end, case when house and charm = 0 then 'no_house_character' end, case when plot and (rail_m is null or rail_m > 20000) then 'outside_fast_rail' end,
  case when not est then 'no_comparable_estimate' end, case when est and est_n < 3 then 'thin_comps' end, case when est and (pct is null or pct < 10) then 'discount_below_gate' end, case when est and pct >= 55 then 'implausible_discount' end, case when est and pct >= 35 and pct < 55 and (est_n < 15 or est_spread > 25) then 'unverified_discount' end,
  case when est and (est_factor > 1.6 or est_factor < 0.9) then 'broken_index_factor' end, case when est and vs < 55 then 'value_score_below_gate' end, case when est and sure < 0.5 then 'confidence_below_gate' end) as failures from x)
"""


@query(SCORE_SQL + """select listing_id, rnd(vs, 0) as value_score, rnd(ts, 0) as transit_score, rnd(gs, 0) as green_score, rnd(ps, 0) as property_score, rnd(rs, 0) as risk_score, rnd(greatest(0, least(100, mid + bonus * least(1, greatest(0, (100 - mid) / 30)))), 3) as total, rnd(sure, 4) as confidence, rnd(pct, 3) as discount_pct,
failures as gate_failures, failures = '' as eligible, failures <> '' and failures in ('no_heating_evidence', 'not_building_plot', 'no_heating_evidence,not_building_plot') as fallback_eligible from g""")
def alert_scores(spark, sf):
    """Five components, their sum, and all failed gates of every offer. Unrounded here, so that halves don't tell engines apart."""
    s = scoring.alert_parts(offers(spark, sf))
    parts = [r(f"{k}_raw", 0).alias(f"{k}_score") for k in scoring.COMPONENTS]
    return s.select("listing_id", *parts, r("total_raw", 3).alias("total"), r("confidence_raw").alias("confidence"), r("discount_raw", 3).alias("discount_pct"), F.array_join("gate_failures", ",").alias("gate_failures"), "eligible", "fallback_eligible")


@query("""with l as (select *, c_custkey % 7 <> 0 as scored_now, c_custkey % 5 = 0 as scored_before from customer)
select count(*) filter (not scored_now and c_acctbal > 0 and c_custkey % 4 <> 3 and c_custkey % 9 <> 0) as missing, count(*) filter (scored_now) + count(*) filter (scored_before) as held,
  count(*) filter (scored_now) + count(*) filter (scored_before) + count(*) filter (not scored_now and c_acctbal > 0 and c_custkey % 4 <> 3 and c_custkey % 9 <> 0) as after,
  count(*) filter (scored_now) + count(*) filter (scored_before) + count(*) filter (not scored_now and c_acctbal > 0 and c_custkey % 4 <> 3 and c_custkey % 9 <> 0) as again from l""")
def incremental_scores(spark, sf):
    """Offers without a score of this version, what storing theirs leaves, and that storing them again changes nothing."""
    k = F.col("c_custkey")
    base = offers(spark, sf).join(t(spark, sf, "customer").select(k.alias("listing_id"), "c_acctbal"), "listing_id")
    ident = F.col("listing_id")
    listings = base.withColumns({"area_m2": F.coalesce("area_m2", F.lit(50.0)), "price": F.when(F.col("c_acctbal") > 0, F.coalesce("price", F.lit(1.0))), "price_per_m2": F.lit(1.0), "offer_type": F.lit("sale"), "is_active": F.lit(True), "is_visible": ident % 4 != 3, "property_kind": F.lit("x"), "property_type": F.lit(None).cast("string"), "portal_status": F.when(ident % 9 == 0, "sold")})
    columns = ["listing_id", "score_version", "segment", "region", "total_score", "eligible", "computed_at", "expires_at"]
    blank = lambda df, version: df.select("listing_id", F.lit(version).alias("score_version"), "segment", "region", F.lit(0.0).alias("total_score"), F.lit(False).alias("eligible"), as_of().alias("computed_at"), as_of().alias("expires_at"))
    held = blank(listings.filter(ident % 7 != 0), scoring.VERSION).unionByName(blank(listings.filter(ident % 5 == 0), "older"))
    todo = scoring.unscored(scoring.score_base(listings), held, "listing_id")
    fresh = scoring.alert_scores(todo)
    after = scoring.stored_scores(held, fresh, "listing_id", as_of()).select(*columns)
    again = scoring.stored_scores(after, fresh, "listing_id", as_of())
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(todo, "missing").crossJoin(count(held, "held")).crossJoin(count(after, "after")).crossJoin(count(again, "again"))


LEADER_SQL = SCORE_SQL + """, sc as (select listing_id, segment, floor(greatest(0, least(100, mid + bonus * least(1, greatest(0, (100 - mid) / 30)))) * 10 + 0.5) / 10 as total, failures = '' as eligible, price, area_m2, 'ul. Krótka ' || (listing_id % 40) as street, coalesce(city, '') as town,
  floor(vs + 0.5) as v, floor(sure * 100 + 0.5) / 100 as c, floor(pct * 10 + 0.5) / 10 as d from g where (failures = '' or failures in ('no_heating_evidence', 'not_building_plot', 'no_heating_evidence,not_building_plot')) and listing_id % 10 <> 3),
pool as (select *, case when price > 0 and area_m2 is not null then town || '|' || street || '|' || floor(area_m2 + 0.5) || '|' || floor(price / greatest(1000.0, price * 0.01) + 0.5) else 'x' || listing_id end as dup from sc where v >= 55 and c >= 0.5 and d >= 10),
da as (select *, row_number() over (partition by segment, dup order by eligible desc, total desc, listing_id) as k1 from pool), db as (select *, row_number() over (partition by segment, street order by eligible desc, total desc, listing_id) as k2 from da where k1 = 1),
dc as (select *, row_number() over (partition by segment order by eligible desc, total desc, listing_id) as rank from db where k2 <= 2)"""


def leaders_of(spark, sf):
    """Offers in streets that are one investment each; a tenth is no longer shown."""
    o = offers(spark, sf)
    ident = F.col("listing_id")
    street = F.concat(F.lit("ul. Krótka "), (ident % 40).cast("string"))
    shown = o.select(ident, (ident % 10 != 3).alias("is_visible"), F.lit(True).alias("is_active"), "city", street.alias("street"), "area_m2", "price", F.lit(None).cast("string").alias("investment_id"), street.alias("investment_title"))
    return leaders.leaderboard(scoring.alert_scores(o, only=["listing_id", *leaders.SCORED]), shown, "listing_id", scoring.VERSION)


@query(LEADER_SQL + " select segment, cast(rank as integer) as rank, listing_id, eligible, total as score from dc where rank <= 25")
def daily_leaders(spark, sf):
    """The list of the day from scored offers: gates, repeats on two portals, two units of an investment."""
    return leaders_of(spark, sf).select("segment", "rank", "listing_id", "eligible", "score")


@query(LEADER_SQL + """, best as (select listing_id, rank from dc where rank <= 25), old as (select c_custkey as listing_id, case when c_custkey % 2 = 0 then date '2001-11-05' else date '2001-11-04' end as day from customer where c_custkey % 3 = 0)
select strftime(day, '%Y-%m-%d') as alert_date, listing_id, 0 as rank, false as fresh from old where day <> date '2001-11-05' union all select '2001-11-05', b.listing_id, cast(b.rank as integer), o.listing_id is null from best b left join old o on o.listing_id = b.listing_id and o.day = date '2001-11-05'""")
def replaced_alerts(spark, sf):
    """Yesterday's alerts stay, today's are replaced; who was on the list before keeps its date."""
    k = F.col("listing_id")
    best = leaders_of(spark, sf)
    old = offers(spark, sf).filter(k % 3 == 0).select(k, F.when(k % 2 == 0, F.lit("2001-11-05").cast("date")).otherwise(F.lit("2001-11-04").cast("date")).alias("alert_date"), "segment", "region", F.lit(0).alias("rank"), F.lit(0.0).alias("score"), F.lit("old").alias("score_version"), F.lit("2001-01-01").cast("timestamp").alias("created_at"))
    now = leaders.replaced_day(old, best, "listing_id", F.to_date(as_of()), as_of())
    return now.select(F.date_format("alert_date", "yyyy-MM-dd").alias("alert_date"), "listing_id", "rank", (F.col("created_at") == as_of()).alias("fresh"))


# ---- prose ------------------------------------------------------------------------------------------

SAID = [
    "", "Ogrzewanie miejskie, blisko parku", "dom bez ogrzewania gazowego, ale z pompą ciepła", "piec gazowy dwufunkcyjny", "brak sieci miejskiej. Kominek z płaszczem wodnym", "kamienica z cegły", "nie w bloku, lecz w apartamentowiec", "mieszkanie w bloku z wielkiej płyty",
    "grzejniki elektryczne i maty grzewcze", "CO miejskie; zamiast kamienicy nowy blok",
]
FEES_SAID = [
    "", "czynsz administracyjny: 780 zł", "czynsz najmu: 3490 zł", "czynsz: 1 250,50 zł", "kaucja: czynsz 4000 zł", "opłaty około 300 zł za prąd 120 zł", "<li>prąd: wg zużycia</li><li>woda 60 zl</li><li>gaz: 40 pln</li>", "czynsz dodatkowo 500 zł", "czynsz 15 zł", "śmieci 30 zł, ogrzewanie 200 zł",
]


def said_sql(values: list[str], k: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][cast({k} % {len(values)} as integer) + 1]"


def said(values: list[str], k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)


def stated_sql(flat: str, patterns: dict[str, str]) -> str:
    one = lambda p: "(?is)^(.*?)(?:" + p.replace("'", "''") + ")"
    return "coalesce(" + ", ".join(f"case when regexp_matches({flat}, '(?i){p}') and not regexp_matches(right(regexp_extract({flat}, '{one(p)}', 1), 60), '(?i){prose.NEGATION}') then '{name}' end" for name, p in patterns.items()) + ")"


@query(f"""with x as (select doc_id, regexp_replace({said_sql(SAID, 'doc_id')} || ' ' || coalesce(text, '') || ' ' || {said_sql(SAID, '(doc_id // 10)')}, '\\s+', ' ', 'g') as s from documents)
select doc_id, {stated_sql('s', prose.HEATING)} as heating, {stated_sql('s', prose.STYLES)} as building from x""")
def prose_lexicon(spark, sf):
    """What texts with an offer's sentence before and behind them state."""
    k = F.col("doc_id")
    s = F.concat(said(SAID, k), F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" "), said(SAID, F.floor(k / 10)))
    return t(spark, sf, "documents").select("doc_id", prose.heating_stated(s).alias("heating"), prose.building_stated(s).alias("building"))


AMOUNT_SQL = prose.AMOUNT.replace("\\x{a0}", "\\x{00a0}")


def amount_sql(window: str) -> str:
    n = f"try_cast(regexp_replace(regexp_extract({window}, '(?i){AMOUNT_SQL}', 1), '[ \\x{{00a0}}]', '', 'g') as integer)"
    return f"case when {n} between 20 and 20000 then {n} end"


def behind_sql(line: str, words: str) -> str:
    return amount_sql(f"regexp_extract({line}, '(?i)(?:{words})(.{{0,60}})', 1)")


FEES_SQL = f"""with o as (select doc_id, doc_id % 7 as building, source as district, {said_sql(FEES_SAID, 'doc_id')} || chr(10) || coalesce(text, '') || chr(10) || {said_sql(FEES_SAID, '(doc_id // 10)')} as s from documents where doc_id % 3 <> 0 or doc_id % 2 = 0),
pl as (select *, regexp_replace(s, '<[^>]+>', chr(10), 'g') as plain from o), ln as (select doc_id, unnest(string_split_regex(plain, '\\r?\\n')) as line, generate_subscripts(string_split_regex(plain, '\\r?\\n'), 1) as k from pl),
ok as (select *, {behind_sql('line', prose.ANCHOR)} as n, regexp_matches(line, '(?i){prose.FEE_LINE}') as admin, regexp_matches(line, '(?i){prose.RENT}') as rent, {behind_sql('line', prose.FEE)} as named, regexp_matches(regexp_extract(line, '(?i)({prose.FEE})', 1), '(?i){prose.RENT}') as named_rent from ln),
e as (select doc_id, min_by(named, k) filter (named is not null and not named_rent) as explicit from ok group by 1),
f as (select doc_id, min_by(n, k) filter (n is not null and not rent and admin) as a, min_by(n, k) filter (n is not null and not rent and not admin) as b, {', '.join(f"min_by({behind_sql('line', w)}, k) filter ({behind_sql('line', w)} is not null) as {name}" for name, w in prose.FEES.items())} from ok where not regexp_matches(line, '(?i){prose.DEPOSIT}') group by 1),
h as (select o.doc_id, building, district, coalesce(explicit, a, b) as czynsz, {', '.join(prose.FEES)} from o left join e using (doc_id) left join f using (doc_id)),
own as (select *, coalesce(czynsz, {', '.join(prose.FEES)}) is not null as has from h)"""


@query(FEES_SQL + f""", w as (select *, case when doc_id % 4 <> 0 then building end as home from own), db as (select home, min(doc_id) as donor from w where has and home is not null group by 1), dd as (select district, min(doc_id) as donor from w where has and district is not null group by 1),
m as (select w.doc_id, w.has, case when w.has then w.doc_id when w.home is not null then db.donor else dd.donor end as source from w left join db on db.home = w.home left join dd on dd.district = w.district)
select m.doc_id, s.czynsz, {', '.join(f's.{k}' for k in prose.FEES)}, not m.has and source is not null as estimated from m left join own s on s.doc_id = m.source""")
def monthly_fees(spark, sf):
    """Fees that texts name, and those of a donor in the same building or district for the others."""
    k = F.col("doc_id")
    s = F.concat(said(FEES_SAID, k), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), said(FEES_SAID, F.floor(k / 10)))
    o = t(spark, sf, "documents").filter((k % 3 != 0) | (k % 2 == 0)).select("doc_id", F.when(k % 4 != 0, k % 7).alias("building"), F.col("source").alias("district"), prose.fees(s).alias("fees"))
    filled = prose.with_fees(o, "doc_id", "building", "district")
    return filled.select("doc_id", *(F.col(f"fees.{c}").alias(c) for c in ("czynsz", *prose.FEES)), "estimated")


# ---- quality ----------------------------------------------------------------------------------------

QUALITY_INPUTS = {k: INPUTS[k] for k in ("listing_id", "segment", "condition", "build_year", "building_type", "building_material", "has_elevator", "floor", "plot_type", "zoning_wz", "plan_count", "road_m", "slope_deg", "flood_risk")} | {
    "fact_media_count": "case when c_custkey % 4 <> 0 then c_custkey % 7 end", "fact_road_access": "case c_custkey % 5 when 0 then 'public' when 1 then 'private' when 2 then 'none' end", "land_use_class": "case c_custkey % 8 when 0 then ' Bp' when 1 then 'RIIIa' when 2 then 'Ls' when 3 then 'x' end",
    "fact_shape": "case c_custkey % 6 when 0 then 'narrow' when 1 then 'Elongated' when 2 then 'regular' end", "fact_heat_pump": "c_custkey % 9 = 0", "fact_air_conditioning": "c_custkey % 4 = 1", "fact_insulation": "c_custkey % 7 = 1", "fact_parking_spots": "c_custkey % 5", "floor_count": "case when c_custkey % 3 = 1 then 6 end",
    "fact_legal_status": "case c_custkey % 11 when 0 then 'share' when 1 then 'perpetual_usufruct' end", "fact_tenanted": "c_custkey % 13 = 0", "fact_technology": "case when c_custkey % 10 = 7 then 'prefab' end",
}
QUALITY_SQL = f"""with i as (select {', '.join(f'{e} as {name}' for name, e in QUALITY_INPUTS.items())} from customer),
p as (select listing_id, case when segment = 'plot' then coalesce(case when fact_media_count <= 0 then -5 when fact_media_count = 1 then -4 when fact_media_count = 2 then -3 when fact_media_count = 3 then -1.5 when fact_media_count = 4 then 1 when fact_media_count > 4 then 2 end, 0)
  + case fact_road_access when 'public' then 1.5 when 'private' then -1 when 'none' then -5 else 0 end + case when road_m <= 50 then 1 when road_m > 500 then -2 else 0 end + case when zoning_wz then 2 when plan_count > 0 then 1.5 else 0 end + case trim(land_use_class) when 'Bp' then 1 when 'RIIIa' then -1.5 when 'Ls' then -4 else 0 end
  + case plot_type when 'budowlana' then 1 when 'rolna' then -2 when 'rekreacyjna' then -1 else 0 end + case lower(fact_shape) when 'narrow' then -2.5 when 'elongated' then -1 else 0 end + case when slope_deg > 25 then -3 when slope_deg > 15 then -1.5 else 0 end - case when flood_risk then 4 else 0 end
else case condition when 'good' then 0 else 0 end + case when build_year is null then 0 when 2026 - build_year <= 5 then case segment when 'flat' then 4 else 3 end when 2026 - build_year <= 15 then 2 when 2026 - build_year <= 30 then 0 when 2026 - build_year <= 50 then -2 when 2026 - build_year <= 70 then -4 else -6 end
  + case building_type when 'block' then -2 when 'tenement' then -1 else 0 end - case when building_material = 'wood' then 1 else 0 end - case when fact_technology = 'prefab' then 1 else 0 end + case when fact_insulation then 1 else 0 end
  + least(2.5, case when fact_heat_pump then 1 else 0 end + case when fact_air_conditioning then 0.5 else 0 end + least(1.5, fact_parking_spots * 0.5))
  - case when not has_elevator and (coalesce(case floor when 'parter' then 0 when '2/4' then 2 when '5' then 5 when 'floor 9' then 9 end, 1) >= 4 or (floor_count >= 5 and coalesce(case floor when 'parter' then 0 when '2/4' then 2 when '5' then 5 when 'floor 9' then 9 end, 1) >= (floor_count - 1) / 2.0)) then 2 else 0 end
  - case fact_legal_status when 'perpetual_usufruct' then 3 when 'share' then 2 else 0 end - case when fact_tenanted then 1.5 else 0 end end as total from i)"""


@query(QUALITY_SQL + " select listing_id, rnd(greatest(-15.0, least(15.0, total)), 1) as quality_pct, true as quality_known from p")
def quality_adjustments(spark, sf):
    """Corrections of customers' offers from what the portal and the text say."""
    rows = t(spark, sf, "customer").select(*(F.expr(e).alias(name) for name, e in QUALITY_INPUTS.items()))
    return quality.adjusted(rows, 2026).select("listing_id", r("quality_pct", 1).alias("quality_pct"), "quality_known")
