"""Queries of the address index, the geocoding cascade, towns' clusters and buildings of points.

Customers stand for buildings: their key gives street, number, town and place. Orders stand for listings and transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components, geocode
from .catalog import HAVERSINE_SQL, query, r, t

PREFIXES, FIRST, SECOND, THIRD = ["ul. ", "Al. ", "os. ", ""], ["Księdza ", "Generała ", "", ""], ["Józefa ", "", "Anny "], ["Meiera", "Bojki", "Łąkowa", "Sarego", "Na Łąki"]
TOWNS = [None, "Kraków", "Tarnów", "Nowy  Sącz", "Bochnia", "Oświęcim"]


def listed(values: list) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def pick_sql(values: list, k: str) -> str:
    return f"{listed(values)}[cast({k} % {len(values)} as integer) + 1]"


def pick(values: list, k):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k % len(values)).cast("int") + 1)


def number_sql(k: str) -> str:
    return f"({k} % 13 + 1) || case when {k} % 11 = 0 then 'a' else '' end"


def number(k):
    return F.concat((k % 13 + 1).cast("string"), F.when(k % 11 == 0, "a").otherwise(""))


def key_sql(s: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower({s})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def street_key_sql(s: str) -> str:
    return key_sql(f"trim(regexp_replace({s}, '^(?i)(?:ul\\.?|al\\.?|aleja|os\\.?|osiedle|pl\\.?|plac|rynek|bulwar|rondo)\\s+', ''))")


def buildings(spark, sf) -> DataFrame:
    """Towns lie apart; a tenth of a town's buildings have strayed, and one town is two places of one name. No place lies on a cell's border."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    street = F.concat(pick(PREFIXES, k), pick(FIRST, k), pick(SECOND, k), pick(THIRD, k))
    away = F.when(n % 6 == 4, F.when(k % 2 == 0, 0.4).otherwise(0.0)).otherwise(F.when(k % 10 == 0, 0.5).otherwise(0.0))
    address = F.when(k % 29 != 0, F.concat(street, F.when(k % 17 != 0, F.concat(F.lit(" "), number(k))).otherwise("")))
    return t(spark, sf, "customer").select(
        k.alias("building_id"), address.alias("address"), pick(TOWNS, n).alias("city"), (F.lit(48.0007) + n % 6 * 0.1 + k % 7 * 0.004 + away).alias("lat"), (F.lit(19.0007) + n % 6 * 0.3 + k % 11 * 0.004).alias("lng")
    )


BUILDINGS_SQL = f"""b0 as (select c_custkey as building_id, case when c_custkey % 29 <> 0 then {pick_sql(PREFIXES, 'c_custkey')} || {pick_sql(FIRST, 'c_custkey')} || {pick_sql(SECOND, 'c_custkey')} || {pick_sql(THIRD, 'c_custkey')} end as street,
  case when c_custkey % 17 <> 0 then {number_sql('c_custkey')} end as number, {key_sql(pick_sql(TOWNS, 'c_nationkey'))} as city_key,
  48.0007 + (c_nationkey % 6) * 0.1 + (c_custkey % 7) * 0.004 + case when c_nationkey % 6 = 4 then case when c_custkey % 2 = 0 then 0.4 else 0.0 end else case when c_custkey % 10 = 0 then 0.5 else 0.0 end end as lat, 19.0007 + (c_nationkey % 6) * 0.3 + (c_custkey % 11) * 0.004 as lng from customer),
ix as materialized (select building_id, {street_key_sql('street')} as key, number, city_key, lat, lng from b0 where street is not null), st as (select key, min(building_id) as first from ix group by 1)"""

ASKED_STREET, ASKED_TOWN = [*THIRD, "Meiera Józefa", "ks. Meiera", "Nieznana", "Generała Anny Bojki"], [None, "Kraków", "tarnow", "Bochnia", "Wieliczka"]


def asked(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(
        "o_orderkey", F.concat(pick(["", "ul. "], k), pick(ASKED_STREET, k)).alias("street"), F.when(k % 8 != 0, number(k)).alias("number"), pick(ASKED_TOWN, k).alias("city"),
        (F.lit(48.0) + F.col("o_custkey") % 6 * 0.1 + k % 7 * 0.004 + 0.001).alias("lat"), (F.lit(19.0) + F.col("o_custkey") % 6 * 0.3 + k % 11 * 0.004).alias("lng"),
    )


#: Sets of streets for each distinct (query_key, hint) of q.
SETS_SQL = """qk as (select distinct query_key, hint from q where query_key <> ''), qs as (select query_key, hint, st.key, st.first from qk join st on case when len(list_filter(string_split(query_key, ' '), lambda w: length(w) >= 4)) = 0 then st.key = query_key
  else list_has_all(string_split(st.key, ' '), list_filter(string_split(query_key, ' '), lambda w: length(w) >= 4)) end),
sn as (select query_key, hint, coalesce(bool_or(city_key = hint), false) as here, bool_or(city_key is not null) as named from qs join ix using (key) group by 1, 2),
sets as materialized (select qs.*, (hint = '' or not named) as whole from qs join sn using (query_key, hint) where hint = '' or not named or here)"""
ASKED_SQL = f"""q as (select o_orderkey, {street_key_sql(f"{pick_sql(['', 'ul. '], 'o_orderkey')} || {pick_sql(ASKED_STREET, 'o_orderkey')}")} as query_key, coalesce({key_sql(pick_sql(ASKED_TOWN, 'o_orderkey'))}, '') as hint, case when o_orderkey % 8 <> 0 then {number_sql('o_orderkey')} end as number,
  48.0 + (o_custkey % 6) * 0.1 + (o_orderkey % 7) * 0.004 + 0.001 as lat, 19.0 + (o_custkey % 6) * 0.3 + (o_orderkey % 11) * 0.004 as lng from orders)"""
NUMBERED_SQL = "select q.o_orderkey, ix.building_id, ix.lat, ix.lng, row_number() over (partition by q.o_orderkey order by (sets.key <> sets.query_key), sets.first, ix.building_id) as turn from q join sets using (query_key, hint) join ix on ix.key = sets.key and ix.number = q.number where sets.whole or ix.city_key = q.hint"


@query(f"with {BUILDINGS_SQL}, {ASKED_SQL}, {SETS_SQL}, h as ({NUMBERED_SQL}) select o_orderkey, building_id, rnd(lat, 6) as lat, rnd(lng, 6) as lng from h where turn = 1")
def address_index(spark, sf):
    """Buildings of streets and numbers, in the town asked for."""
    found = geocode.by_address(asked(spark, sf), geocode.street_index(buildings(spark, sf)), "o_orderkey")
    return found.withColumns({"lat": r("lat", 6), "lng": r("lng", 6)})


def clusters_sql(points: str) -> str:
    """mc: g, lat, lng, n, of, clusters of each group g of ``points`` (g, lat, lng) with a main cluster."""
    return f"""cl as materialized (select g, cast(floor(lat / 0.02) as bigint) as r, cast(floor(lng / 0.02) as bigint) as c, count(*) as n, sum(lat) as a, sum(lng) as o from ({points}) group by 1, 2, 3),
reach as (select g, r, c, r as r0, c as c0 from cl union select cl.g, cl.r, cl.c, reach.r0, reach.c0 from reach join cl on cl.g = reach.g and abs(cl.r - reach.r) <= 1 and abs(cl.c - reach.c) <= 1),
lab as (select g, r, c, min((r0, c0)) as cluster from reach group by 1, 2, 3), big as (select g, cluster, sum(n) as n, sum(a) as a, sum(o) as o from lab join cl using (g, r, c) group by 1, 2),
whole as (select g, sum(n) as of, count(*) as clusters from big group by 1), mc as materialized (select g, a / n as lat, o / n as lng, n, of, clusters from big join whole using (g) where n >= of * 0.8)"""


@query(f"with recursive {BUILDINGS_SQL}, {clusters_sql('select city_key as g, lat, lng from b0 where city_key is not null')} select g as town, rnd(lat, 6) as lat, rnd(lng, 6) as lng, cast(n as bigint) as n, cast(of as bigint) as of, clusters from mc")
def town_clusters(spark, sf):
    """Centres of the towns whose buildings lie together, without strays."""
    b = buildings(spark, sf).select(geocode.name_key(F.col("city")).alias("town"), "lat", "lng").filter("town is not null")
    return components.main_clusters(b, ["town"]).withColumns({"lat": r("lat", 6), "lng": r("lng", 6)}).select("town", "lat", "lng", "n", "of", "clusters")


@query("""with recursive p as (select user_id, cast(floor(value / 20) as bigint) as r, cast(floor(epoch(ts) / 86400) as bigint) as c, count(*) as n from events where value is not null group by 1, 2, 3),
reach as (select user_id, r, c, r as r0, c as c0 from p union select p.user_id, p.r, p.c, reach.r0, reach.c0 from reach join p on p.user_id = reach.user_id and abs(p.r - reach.r) <= 1 and abs(p.c - reach.c) <= 1),
lab as (select user_id, r, c, min((r0, c0)) as cluster from reach group by 1, 2, 3)
select user_id, count(distinct cluster) as clusters, cast(sum(n) as bigint) as n, max(m) as largest from (select user_id, cluster, sum(n)::bigint as n, max(sum(n)) over (partition by user_id)::bigint as m from lab join p using (user_id, r, c) group by 1, 2) group by 1""")
def value_clusters(spark, sf):
    """Days and values of a user as cells that touch."""
    e = t(spark, sf, "events").select("user_id", (F.floor(F.col("value") / 20) * 0.02 + 0.01).alias("lat"), (F.floor(F.unix_timestamp("ts") / 86400) * 0.02 + 0.01).alias("lng"))
    g = components.cell_clusters(e, ["user_id"])
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), F.max("n").alias("largest"))


STORED = ["", "33-100, ", "73, 33-230, "]
LISTED_SQL = f"""l0 as (select o_orderkey, o_orderkey % 6 as m, {pick_sql(['', 'ul. '], 'o_orderkey')} || {pick_sql(ASKED_STREET, 'o_orderkey')} as street, {number_sql('o_orderkey')} as number, {pick_sql(TOWNS[1:], 'o_custkey')} as town, {pick_sql(THIRD, 'o_custkey')} as mined from orders),
l1 as (select o_orderkey, case m when 4 then '33-100' when 5 then null else street || case when m = 3 then '' else ' ' || number end end as part, m, number, town, mined, coalesce({key_sql('town')}, '') as hint from l0),
q as (select o_orderkey, hint, m >= 4 as streetless, case when m < 4 then {street_key_sql("regexp_replace(part, '\\s+\\d{1,4}[A-Za-z]?$', '')")} else '' end as query_key, case when m < 3 then number end as number, case when o_orderkey % 4 = 0 then {street_key_sql('mined')} end as mined_key from l1)"""


def centres_sql(sets: str, name: str) -> str:
    """Like clusters_sql, by question."""
    inner = clusters_sql(f"select (query_key, hint) as g, lat, lng from {sets} join ix using (key) where whole or city_key = hint")
    for part in ("cl", "reach", "lab", "big", "whole", "mc"):
        for a, b in ((f"{part} as", f"{name}_{part} as"), (f"from {part} ", f"from {name}_{part} "), (f"join {part} ", f"join {name}_{part} "), (f"from {part}\n", f"from {name}_{part}\n"), (f"{part}.", f"{name}_{part}.")):
            inner = inner.replace(a, b)
    return inner


@query(f"""with recursive {BUILDINGS_SQL}, {LISTED_SQL}, {SETS_SQL}, h as ({NUMBERED_SQL}),
t1 as (select o_orderkey, 'address' as tier, building_id, lat, lng from h where turn = 1),
one as (select query_key, hint from sets join ix using (key) where whole or city_key = hint group by 1, 2 having hint <> '' or count(distinct city_key) <= 1), {centres_sql('sets', 's')},
t2 as (select o_orderkey, 'street' as tier, cast(null as bigint) as building_id, c.lat, c.lng from q join one using (query_key, hint) join s_mc c on c.g = (query_key, hint) where o_orderkey not in (select o_orderkey from t1)),
mq as (select o_orderkey, mined_key as query_key, hint from q where mined_key is not null and o_orderkey not in (select o_orderkey from t1) and o_orderkey not in (select o_orderkey from t2)),
mk as (select distinct query_key, hint from mq), ms0 as (select query_key, hint, st.key from mk join st on case when len(list_filter(string_split(query_key, ' '), lambda w: length(w) >= 4)) = 0 then st.key = query_key else list_has_all(string_split(st.key, ' '), list_filter(string_split(query_key, ' '), lambda w: length(w) >= 4)) end),
mn as (select query_key, hint, coalesce(bool_or(city_key = hint), false) as here, bool_or(city_key is not null) as named from ms0 join ix using (key) group by 1, 2),
msets as materialized (select ms0.*, (hint = '' or not named) as whole from ms0 join mn using (query_key, hint) where hint = '' or not named or here),
mone as (select query_key, hint from msets join ix using (key) where whole or city_key = hint group by 1, 2 having hint <> '' or count(distinct city_key) <= 1), {centres_sql('msets', 'm')},
t3 as (select o_orderkey, 'mined_street' as tier, cast(null as bigint) as building_id, c.lat, c.lng from mq join mone using (query_key, hint) join m_mc c on c.g = (query_key, hint)),
{clusters_sql('select city_key as g, lat, lng from b0 where city_key is not null')},
t4 as (select o_orderkey, 'town' as tier, cast(null as bigint) as building_id, mc.lat, mc.lng from q join mc on mc.g = hint where streetless and o_orderkey not in (select o_orderkey from t1 union all select o_orderkey from t2 union all select o_orderkey from t3)),
every as (select * from t1 union all select * from t2 union all select * from t3 union all select * from t4)
select q.o_orderkey, tier, building_id, rnd(every.lat, 6) as lat, rnd(every.lng, 6) as lng from q left join every using (o_orderkey)""")
def geocode_cascade(spark, sf):
    """Each listing's first match; a quarter of them have a street mined from text beside the stored address."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 6
    street = F.concat(pick(["", "ul. "], k), pick(ASKED_STREET, k))
    part = F.when(m == 4, "33-100").when(m == 5, None).otherwise(F.concat(street, F.when(m == 3, "").otherwise(F.concat(F.lit(" "), number(k)))))
    town = pick(TOWNS[1:], F.col("o_custkey"))
    mined = F.when(k % 4 == 0, F.array(F.struct(pick(THIRD, F.col("o_custkey")).alias("street"), F.lit(None).cast("string").alias("number"))))
    listings = t(spark, sf, "orders").select("o_orderkey", F.when(m != 5, F.concat_ws(", ", part, town)).alias("address"), F.when(m == 5, town).alias("district"), mined.alias("mined"))
    found = geocode.geocode(listings, buildings(spark, sf), "o_orderkey", "mined")
    return found.select("o_orderkey", "tier", "building_id", r("lat", 6).alias("lat"), r("lng", 6).alias("lng"))


#: Buildings as squares of 40 m around their place; points near them.
SITES_SQL = f"""w as (select c_custkey as building_id, 49.5 + (c_custkey * 7919 % 3000) / 100000.0 as lat, 19.5 + (c_custkey * 104729 % 5000) / 100000.0 as lng, {pick_sql(THIRD, 'c_custkey')} || ' ' || {number_sql('c_custkey')} as address from customer),
x as (select o_orderkey, 49.5 + (o_orderkey * 6133 % 3000) / 100000.0 + 0.000013 as lat, 19.5 + (o_orderkey * 15485863 % 5000) / 100000.0 + 0.000017 as lng, {pick_sql(THIRD, 'o_orderkey')} as street, {number_sql('o_orderkey')} as number from orders where o_orderkey % 3 = 0)"""
SITE_HAVERSINE_SQL = HAVERSINE_SQL.replace("a.", "x.").replace("b.", "w.")
AWARE_SQL = f"""d as (select o_orderkey, building_id, x.street, x.number, w.address, abs(x.lat - w.lat) < 0.0002 and abs(x.lng - w.lng) < 0.0003 as inside, {SITE_HAVERSINE_SQL} as m from x join w on abs(x.lat - w.lat) < 0.006 and abs(x.lng - w.lng) < 0.006),
e as (select *, case when inside then 0 when m < 40 then 1 when m < 150 and starts_with(regexp_replace(lower(address), '[^a-z0-9]', '', 'g'), regexp_replace(lower(street), '[^a-z0-9]', '', 'g')) then 2 when m < 150 then 3 end as turn from d),
f as (select *, row_number() over (partition by o_orderkey order by turn, case when turn = 0 then 0 else m end, building_id) as rank from e where turn is not null)"""


def sites(spark, sf) -> tuple[DataFrame, DataFrame]:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    lat, lng = F.lit(49.5) + k * 7919 % 3000 / 100000.0, F.lit(19.5) + k * 104729 % 5000 / 100000.0
    corner = lambda a, b: F.struct((lat + a).alias("lat"), (lng + b).alias("lng"))
    ring = F.array(corner(-0.0002, -0.0003), corner(-0.0002, 0.0003), corner(0.0002, 0.0003), corner(0.0002, -0.0003))
    homes = t(spark, sf, "customer").select(k.alias("building_id"), lat.alias("lat"), lng.alias("lng"), F.concat(pick(THIRD, k), F.lit(" "), number(k)).alias("address"), ring.alias("ring"), F.lit(None).cast("string").alias("city"))
    deals = t(spark, sf, "orders").filter(o % 3 == 0).select(
        "o_orderkey", (F.lit(49.5) + o * 6133 % 3000 / 100000.0 + 0.000013).alias("lat"), (F.lit(19.5) + o * 15485863 % 5000 / 100000.0 + 0.000017).alias("lng"), pick(THIRD, o).alias("street"), number(o).alias("number")
    )
    return homes, deals


@query(f"with {SITES_SQL}, {AWARE_SQL} select o_orderkey, building_id, ['contained', 'near', 'street', 'any'][turn + 1] as how, rnd(case when turn = 0 then 0 else m end, 3) as distance_m from f where rank = 1")
def street_aware(spark, sf):
    """The building that holds a point, or the nearest, one on the same street first."""
    homes, deals = sites(spark, sf)
    return geocode.street_aware(deals, homes, "o_orderkey").withColumn("distance_m", r("distance_m", 3))


@query(f"""with {SITES_SQL}, {AWARE_SQL}, ix as (select building_id, {street_key_sql("regexp_replace(address, '\\s+\\d{1,4}[A-Za-z]?$', '')")} as key, regexp_extract(address, '(\\d{{1,4}}[A-Za-z]?)$', 1) as number, lat, lng from w),
g as (select x.o_orderkey, ix.building_id, {SITE_HAVERSINE_SQL.replace('w.', 'ix.')} as m from x join ix on list_has_all(string_split(ix.key, ' '), list_filter(string_split({street_key_sql('x.street')}, ' '), lambda u: length(u) >= 4)) and (len(list_filter(string_split({street_key_sql('x.street')}, ' '), lambda u: length(u) >= 4)) > 0 or ix.key = {street_key_sql('x.street')}) and ix.number = x.number and abs(x.lat - ix.lat) < 0.006 and abs(x.lng - ix.lng) < 0.006),
a as (select o_orderkey, building_id from (select *, row_number() over (partition by o_orderkey order by m, building_id) as k from g) where k = 1 and m <= 300)
select o_orderkey, building_id, 'address' as how from a union all select o_orderkey, building_id, ['contained', 'near', 'street', 'any'][turn + 1] from f where rank = 1 and o_orderkey not in (select o_orderkey from a)""")
def building_assignment(spark, sf):
    """A transaction's building: by street and number close by, else by place."""
    homes, deals = sites(spark, sf)
    return geocode.assign_buildings(deals, homes, "o_orderkey")
