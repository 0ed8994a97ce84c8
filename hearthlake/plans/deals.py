"""Queries of sale estimates, visibility, classifiers, tables' upkeep and further streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import comps, listings, prices, sinks, valuation
from ..streaming import streams
from .catalog import AS_OF, HAVERSINE_SQL, POINT_SQL, as_of, points, query, r, shared_folder, t

# ---- sale estimates ---------------------------------------------------------------------------------

ESTIMATE_SQL = f"""with a as (select s_suppkey as target_id, 40 + s_suppkey % 50 as t_area, s_acctbal * 1.0 as offer, {POINT_SQL.format(k='s_suppkey')} from supplier),
b as (select o_orderkey + 1000000 as c_id, 30 + o_orderkey % 90 as c_area, o_totalprice / (30 + o_orderkey % 90) as c_price, o_orderdate as c_date, 1 + o_orderkey % 2 as c_market, o_orderstatus = 'O' as listing, o_orderpriority = '1-URGENT' and o_orderstatus <> 'O' as building,
  case when o_orderkey % 4 <> 0 then 1 + (o_orderkey % 5) * 0.02 end as c_factor, {POINT_SQL.format(k='o_custkey')} from orders),
p as (select target_id, t_area, offer, c_id, c_price, listing, building, c_factor, c_area, {HAVERSINE_SQL} as dist, c_area / t_area as ratio, c_market = 1 as same, date_diff('second', c_date, timestamp '{AS_OF}') as age
  from a join b on {HAVERSINE_SQL} <= 8000 where c_date <= timestamp '{AS_OF}' and c_date >= timestamp '{AS_OF}' - interval 1825 days),
q as (select unnest(range(3)) as tier), f as (select p.*, tier from p, q where ratio between [0.87, 0.5, 0.25][tier + 1] and [1.15, 2.0, 4.0][tier + 1] and (same or tier = 2)),
n as (select target_id, listing, tier, count(*) as n from f group by 1, 2, 3), bt as (select target_id, listing, coalesce(min(tier) filter (n >= 3), max(tier)) as tier from n group by 1, 2),
w as (select f.*, pow(0.5, greatest(0.0, age / (30.44 * 86400)) / 24) * (1 / (1 + dist / 800)) * (1 / (1 + abs(ln(ratio)))) * case when same then 1 else 0.65 end * case when building then 2.0 else 1.0 end * case when listing then 0.5 else 1.0 end as weight from f join bt using (target_id, listing, tier)),
c as (select *, row_number() over (partition by target_id, listing order by weight desc, c_id) as k from w), d as (select *, row_number() over (partition by target_id order by weight desc, c_id) as rank from c where k <= 30),
e as (select *, c_price * case when listing then 0.95 * pow(c_area / t_area, 0.9) when c_factor > 0 then c_factor * pow(c_area / t_area, 0.9) else 1 end as price from d where rank <= 30),
h as (select *, sum(weight) over (partition by target_id order by price, weight rows unbounded preceding) as run, sum(weight) over (partition by target_id) as total from e),
g as (select target_id, count(*) as n, count(*) filter (not listing) as rcn, count(*) filter (not listing and c_factor is not null) as indexed, count(*) filter (building) as own, count(*) filter (not listing and age <= 365 * 86400) as recent,
  min(price) filter (run >= total * 0.25) as p25, min(price) filter (run >= total * 0.5) as p50, min(price) filter (run >= total * 0.75) as p75 from h group by 1 having count(*) >= 3),
s as (select *, least(p25, p50) as low, greatest(p75, p50) as high, (greatest(p75, p50) - least(p25, p50)) / p50 * 100 as spread from g),
z as (select s.*, offer, case when offer > 0 then (offer / p50 - 1) * 100 end as pct, least(40, rcn * 5) + case when own > 0 then 15 else 0 end + case when rcn > 0 and indexed / rcn >= 0.75 then 15 when rcn > 0 and indexed / rcn >= 0.4 then 8 else 0 end
  + case when spread <= 20 then 15 when spread <= 35 then 8 else 0 end + case when recent >= 3 then 15 when recent >= 1 then 8 else 0 end as raw from s join a using (target_id)),
y as (select *, case when rcn = 0 then least(raw, 35) else raw end as points from z)
select a.target_id, rnd(p50, 4) as fair, rnd(low, 4) as low, rnd(high, 4) as high, rnd(spread, 4) as spread_pct, rnd(pct, 4) as over_pct, case when pct <= -45 then case when y.n < 5 then 'discount_few_comps' when (high - low) / p50 > 0.8 then 'discount_wide_spread' end end as guard,
  cast(points as bigint) as points, case when points >= 75 then 'high' when points >= 45 then 'medium' when points is not null then 'low' end as confidence, rcn, case when y.target_id is null then 'insufficient_comps' end as reason from a left join y using (target_id)"""


@query(ESTIMATE_SQL)
def sale_estimate(spark, sf):
    """Suppliers ask their balance a square metre; orders are sales, or asks where they are open, at their customer's place."""
    k, o = F.col("o_orderkey"), t(spark, sf, "orders")
    place = points(o.select("o_custkey").distinct(), "o_custkey")
    area = (k % 90 + 30).cast("double")
    kind = F.when(F.col("o_orderstatus") == "O", "listing").when(F.col("o_orderpriority") == "1-URGENT", "building").otherwise("rcn")
    candidates = o.join(place, "o_custkey").select(
        (k + 1_000_000).alias("c_id"), "lat", "lng", area.alias("c_area"), (F.col("o_totalprice") / area).alias("c_price"), F.col("o_orderdate").alias("c_date"), (k % 2 + 1).alias("c_market"), kind.alias("c_set"),
        F.lit(None).cast("int").alias("c_rooms"), F.lit(0.95).alias("c_ratio"), F.when(k % 4 != 0, F.lit(1.0) + k % 5 * 0.02).alias("c_factor"),
    )
    s = t(spark, sf, "supplier")
    targets = points(s, "s_suppkey").join(s.select("s_suppkey", "s_acctbal"), "s_suppkey").select(
        F.col("s_suppkey").alias("target_id"), "lat", "lng", (F.col("s_suppkey") % 50 + 40).cast("double").alias("t_area"), F.col("s_acctbal").cast("double").alias("t_offer"), F.lit(1).cast("long").alias("t_market"),
        as_of().alias("t_as_of"), F.lit("plot").alias("t_kind"), F.lit(None).cast("int").alias("t_rooms"),
    )
    out = valuation.sale_estimates(targets, candidates, comps.Selection(radii_m=(8000.0,)), valuation.SIZE_POWER["plot"])
    return out.select("target_id", *(r(c).alias(c) for c in ("fair", "low", "high", "spread_pct", "over_pct")), "guard", F.col("points").cast("long").alias("points"), "confidence", "rcn", "reason")


@query("""with x as (select l_orderkey, l_linenumber, case when l_orderkey % 5 <> 0 then 0.7 + (l_orderkey % 13) * 0.1 end as narrow, case when l_linenumber <> 3 then 0.8 + (l_linenumber % 4) * 0.15 end as wide from lineitem)
select l_orderkey, l_linenumber, rnd(coalesce(case when narrow is null or narrow / wide > 1.5 or narrow / wide < 1 / 1.5 then coalesce(wide, narrow) else narrow end, 1.0), 6) as factor,
  rnd(case when coalesce(narrow, wide) is null then 0.7 when narrow / wide > 1.5 or narrow / wide < 1 / 1.5 then 0.5 else 1.0 end, 6) as weight from x""")
def guarded_factors(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    factor, weight = prices.guard_factor(F.when(k % 5 != 0, F.lit(0.7) + k % 13 * 0.1), F.when(n != 3, F.lit(0.8) + n % 4 * 0.15), F.lit(1.0))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(factor, 6).alias("factor"), r(weight, 6).alias("weight"))


# ---- visibility and classifiers ---------------------------------------------------------------------

LISTED_SQL = """with x as (select o_orderkey as id, case o_orderkey % 5 when 0 then 'investmap' when 1 then 'rynekpierwotny' when 2 then 'gratka' when 3 then 'morizon' else 'budujesie' end as source, o_orderkey % 10 = 0 as standin,
  'osiedle ' || (o_custkey % 40) as name, o_orderkey % 30 as inv, 'dluga' || chr(97 + cast(o_custkey % 7 as integer)) as street, case when o_orderkey % 3 <> 0 then cast(o_orderkey % 9 + 1 as varchar) end as number, cast(floor(o_totalprice / 20000) as bigint) as price, o_orderkey % 4 as area, o_orderkey % 3 as rooms, o_orderdate as seen from orders),
l as (select * from x where source <> 'budujesie'), im as (select * from l where source = 'investmap' and not standin),
k as (select * from l where not (source = 'investmap' and standin and (('inv-' || inv) in (select 'inv-' || inv from im where id % 15 = 5) or name in (select name from im)))),
iv as (select *, street from k where source = 'investmap'),
v as (select * from k where not (source = 'rynekpierwotny' and ((number is not null and (street || '|' || number) in (select street || '|' || number from iv where number is not null)) or (number is null and street in (select street from iv)) or name in (select name from iv)))),
f as (select *, row_number() over (partition by price, area, rooms order by seen desc, id desc) as turn from v)
select id, source from f where source <> 'gratka' or turn = 1"""


def listed(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    source = F.element_at(F.array(*map(F.lit, ("investmap", "rynekpierwotny", "gratka", "morizon", "budujesie"))), (k % 5 + 1).cast("int"))
    name = F.concat(F.lit("Osiedle "), (c % 40).cast("string"))
    flat = (k % 5 == 0) & (k % 10 != 0)
    address = F.concat(F.lit("ul. Długa".replace("ł", "l")), F.char((c % 7 + 97).cast("long")), F.when(k % 3 != 0, F.concat(F.lit(" "), (k % 9 + 1).cast("string"))).otherwise(""), F.lit(", Kraków"))
    return t(spark, sf, "orders").select(
        k.alias("id"), source.alias("source"), F.when(k % 10 == 0, F.concat(F.lit("inv-"), (k % 30).cast("string"))).otherwise(F.concat(F.lit("f"), k.cast("string"))).alias("external_id"),
        F.when(flat, F.concat(name, F.lit(" — m1"))).otherwise(name).alias("title"), address.alias("address"), F.floor(F.col("o_totalprice") / 20000).alias("price"), (k % 4).alias("area_m2"), (k % 3).alias("rooms"),
        F.lit(None).cast("string").alias("district"), F.when(flat & (k % 15 == 5), (k % 30).cast("string")).alias("investment_id"), F.col("o_orderdate").alias("scraped_at"),
    )


@query(LISTED_SQL)
def visible_listings(spark, sf):
    return listings.shown(listed(spark, sf), ("budujesie",)).select("id", "source")


DERIVED_SQL = f"""with vis as ({LISTED_SQL}), l as (select o_orderkey as id, o_orderkey % 5 as s, o_orderkey % 10 as e, o_orderkey % 11 as b, o_custkey from orders)
select l.id, case when s = 4 or (s = 0 and e = 0) then null when s = 0 then 'apartment' when s in (1, 2, 3) then case l.id % 3 when 0 then 'plot' else 'apartment' end end as property_kind, vis.id is not null as is_visible, case when b < 5 then 50.0 + b else case when l.id % 2 = 0 then 49.0 end end as map_lat, case when b < 5 then 20.0 + b else 19.0 end as map_lng,
not (vis.id is not null and ((s = 0 and e <> 0) or (s in (1, 2, 3) and l.id % 3 <> 0)) and b >= 5 and ((l.id % 7 = 0 and l.id % 2 = 0) or (l.id % 7 <> 0 and l.id % 2 = 1))) as changed from l left join vis on vis.id = l.id"""


@query(DERIVED_SQL)
def derived_columns(spark, sf):
    """Kind, visibility and place of every listing, and what has changed since the pass before."""
    k = F.col("id")
    rows = listed(spark, sf).withColumns({
        "property_type": F.when(F.col("source").isin("rynekpierwotny", "gratka", "morizon"), F.when(k % 3 == 0, "plot").when(k % 3 == 1, "flat")), "building_id": k % 11, "lat": F.when(k % 2 == 0, 49.0), "lng": F.lit(19.0), "property_kind": F.lit("apartment"),
        "is_visible": F.lit(True), "map_lat": F.when(k % 7 == 0, 49.0), "map_lng": F.lit(19.0),
    })
    n = F.col("r_regionkey").cast("long")
    buildings = t(spark, sf, "region").select(n.alias("building_id"), (n + 50.0).alias("lat"), (n + 20.0).alias("lng"))
    out = listings.derived(rows, buildings, as_of(), ("budujesie",))
    return out.select("id", "property_kind", "is_visible", "map_lat", "map_lng", "changed")


KIND_TITLES = ("Działka budowlana", "nieruchomość gruntowa", "grunt niezabudowany", "DZIAŁKA, grunt zabudowany", "Dom jednorodzinny", "BLIŹNIAK", "mieszkanie z balkonem", "Pokój do wynajęcia", "garaż", "Segmenty przy lesie")
KIND_TYPES = (None, "Flat", "TIPI", "działka", "Inwestycja", "lokal", "")


@query(f"""with x as (select o_orderkey, [{', '.join(f"'{x}'" for x in KIND_TITLES)}][o_orderkey % 10 + 1] as title, [{', '.join('null' if x is None else f"'{x}'" for x in KIND_TYPES)}][o_custkey % 7 + 1] as type, ['otodom', 'investmap', 'budujesie', 'licytacje'][o_orderkey % 4 + 1] as source, o_orderkey % 3 = 0 as standin from orders)
select o_orderkey, case when source = 'budujesie' or (source = 'investmap' and standin) or lower(type) = 'inwestycja' then null when lower(type) = 'flat' then 'apartment' when lower(type) = 'tipi' then 'house' when lower(type) = 'działka' then 'plot'
  when title in ('DZIAŁKA, grunt zabudowany') then 'house' when title in ('Działka budowlana', 'grunt niezabudowany') then 'plot' when title in ('Dom jednorodzinny', 'BLIŹNIAK', 'Segmenty przy lesie') then 'house' when title in ('mieszkanie z balkonem', 'Pokój do wynajęcia') then 'apartment'
  when source in ('investmap', 'otodom') then 'apartment' end as kind from x""")
def property_kinds(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    external = F.when(k % 3 == 0, "inv-7").otherwise("f7")
    return t(spark, sf, "orders").select("o_orderkey", text.property_kind(pick(("otodom", "investmap", "budujesie", "licytacje"), k), pick(KIND_TITLES, k), pick(KIND_TYPES, F.col("o_custkey")), external).alias("kind"))


PHRASES = ("PANORAMA miasta", "widok na GÓRY", "nad jeziorem", "przy parku", "las za domem", "cicha ulica", "klimatyzacja", "z kominkiem", "pompa ciepła", "po remoncie", "SŁONECZNE", "prąd i gaz ziemny", "MPZP", "teren zalewowy", "hałas", "nic")


@query(f"""with x as (select o_orderkey, [{', '.join(f"'{p}'" for p in PHRASES)}][o_orderkey % 16 + 1] as a, [{', '.join(f"'{p}'" for p in PHRASES)}][o_custkey % 16 + 1] as b from orders)
select o_orderkey, {', '.join(f"(a = '{p}' or b = '{p}') as {name}" for p, name in zip(PHRASES, text.FLAG_WORDS))} from x""")
def text_uniqueness(spark, sf):
    pick = lambda n: F.element_at(F.array(*map(F.lit, PHRASES)), (n % 16 + 1).cast("int"))
    advert = F.concat_ws("\n", pick(F.col("o_orderkey")), pick(F.col("o_custkey")))
    return t(spark, sf, "orders").select("o_orderkey", *text.flags(advert, text.FLAG_WORDS))


# ---- upkeep of tables -------------------------------------------------------------------------------


@query("""with p as (select o_orderkey, o_custkey from orders where o_orderdate >= timestamp '1998-01-01') select 'orders' as kind, o_orderkey as k, 0 as line from p union all select 'lines', l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from p)""")
def prune_dependents(spark, sf):
    kept, lines = sinks.prune(t(spark, sf, "orders"), F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"), "o_orderkey", (t(spark, sf, "lineitem"), "l_orderkey"))
    return kept.select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("k"), F.lit(0).alias("line")).unionByName(lines.select(F.lit("lines").alias("kind"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("line")))


@query("select c_custkey, coalesce(case when c_custkey % 3 = 0 then null else c_mktsegment end, case when c_custkey % 2 = 0 then 'FOUND' end) as c_mktsegment from customer")
def fill_nulls(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    facts = t(spark, sf, "customer").filter("c_custkey % 2 = 0").select("c_custkey", F.lit("FOUND").alias("c_mktsegment"))
    return sinks.fill_nulls(c, facts, "c_custkey", ["c_mktsegment"])


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id % 3 <> 0) where k = 1")
def insert_ignore(spark, sf):
    e = t(spark, sf, "events")
    held = e.filter("user_id % 3 = 0").select("user_id").distinct()
    return sinks.insert_ignore(held, e, ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@query("select o_orderstatus, count(*) as n, cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as bigint) as replaced from orders group by 1")
def replace_slice(spark, sf):
    """One slice of a partitioned table is written anew, the others stay."""
    path = shared_folder(spark, "slices")
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("version"))
    sinks.replace_slice(o, path, "o_orderstatus")
    sinks.replace_slice(o.filter("o_orderstatus = 'P'").withColumn("version", F.lit(1)), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("replaced"))


# ---- streams ----------------------------------------------------------------------------------------


@query("select user_id, event_type from events group by 1, 2")
def stream_distinct(spark, sf):
    """Arrivals once for each key, though they repeat, over several batches."""
    folder = shared_folder(spark, "arrivals")
    t(spark, sf, "events").select("user_id", "event_type", "ts").repartition(4, "event_id").write.parquet(f"{folder}/in")
    out = streams.distinct_arrivals(streams.source(spark, f"{folder}/in", files_a_batch=1), "ts", ["user_id", "event_type"], late="400 days")
    return streams.run_to_files(out.select("user_id", "event_type"), "append", f"{folder}/out")


@query("""with l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from (select user_id, event_id, ts from events))
select user_id, event_id, (select count(*) from events e where e.user_id = l.user_id) as history from l where k = 1""")
def stream_latest(spark, sf):
    """The latest row of each key over several batches, late ones among them, and the whole history."""
    folder = shared_folder(spark, "latest")
    e = t(spark, sf, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    e.repartition(4, "event_id").write.parquet(f"{folder}/in")
    last, history = streams.run_upserts(streams.source(spark, f"{folder}/in", files_a_batch=1), ["user_id"], "at", folder)
    return last.select("user_id", "event_id").join(history.groupBy("user_id").agg(F.count(F.lit(1)).alias("history")), "user_id")


def _in_turn(parts: list, folder: str) -> None:
    """One file a part, in the order in which a stream takes them: by when they were written."""
    import time

    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if n + 1 < len(parts):
            time.sleep(0.05)


LATE_SQL = """o as (select *, event_id % 10 <> 0 as on_time from events), wm as (select max(ts) - interval 2 days as mark from o where on_time)"""


@query(f"with {LATE_SQL} select date_trunc('hour', ts) as start, event_type, count(*) as n from o, wm where on_time or date_trunc('hour', ts) + interval 1 hour > mark group by 1, 2")
def stream_late(spark, sf):
    """Hourly counts in append mode. A tenth of the events come after the watermark has moved: those of closed hours are dropped."""
    folder = shared_folder(spark, "late")
    e = t(spark, sf, "events").select("event_id", "ts", "event_type")
    on_time = e.filter("event_id % 10 <> 0")
    last = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit("end").alias("event_type"))
    first = e.agg(F.min("ts").alias("ts")).select(F.lit(-2).cast("long").alias("event_id"), F.col("ts"), F.lit("tick").alias("event_type"))
    _in_turn([on_time, first, e.filter("event_id % 10 = 0"), last, last.withColumn("event_type", F.lit("end2"))], folder)
    out = streams.windowed_counts(streams.source(spark, f"{folder}/in", files_a_batch=1), "ts", "event_type", late="2 days")
    return streams.run_to_files(out, "append", f"{folder}/out").filter(~F.col("event_type").isin("tick", "end", "end2"))


@query("""with o as (select *, user_id % 3 <> 0 as on_time from events), wm as (select max(ts) - interval 2 days as mark from o where on_time)
select user_id, event_type from o, wm where on_time or ts > mark group by 1, 2""")
def stream_distinct_late(spark, sf):
    """Arrivals once for each key; keys of which only rows behind the watermark arrive don't count."""
    folder = shared_folder(spark, "late-arrivals")
    e = t(spark, sf, "events").select("user_id", "event_type", "ts")
    first = e.agg(F.min("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.lit("tick").alias("event_type"), "ts")
    _in_turn([e.filter("user_id % 3 <> 0"), first, e.filter("user_id % 3 = 0")], folder)
    out = streams.distinct_arrivals(streams.source(spark, f"{folder}/in", files_a_batch=1), "ts", ["user_id", "event_type"], late="2 days")
    return streams.run_to_files(out.select("user_id", "event_type"), "append", f"{folder}/out").filter("user_id >= 0")


@query("""with s as (select event_id, event_type, value * 2 + user_id % 10 as score from events), k as (select *, row_number() over (partition by event_type order by score desc, event_id) as rank from s)
select event_type, cast(rank as integer) as rank, event_id, rnd(score, 4) as score from k where rank <= 20""")
def stream_ranking(spark, sf):
    """Events scored on arrival over four batches, ranked anew after every second one; the last batch is run twice."""
    folder = shared_folder(spark, "ranking")
    e = t(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    e.repartition(4, "event_id").write.parquet(f"{folder}/in")
    score = lambda b: b.select("event_id", "event_type", (F.col("value") * 2 + F.col("user_id") % 10).alias("score"))
    each = streams.score_arrivals(score, "event_id", "event_type", [F.desc("score"), F.asc("event_id")], 20, folder, every=2)

    def twice(batch, number: int) -> None:
        each(batch, number)
        if number == 3:
            each(batch, number)

    streams.run_batches(streams.source(spark, f"{folder}/in", files_a_batch=1), twice, folder)
    return streams.newest_ranking(spark, folder).select("event_type", F.col("rank").cast("int").alias("rank"), "event_id", r("score").alias("score"))
