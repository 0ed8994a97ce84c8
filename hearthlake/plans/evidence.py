"""Queries of the estimators' backtest and of the upside of an estimate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, comps, forecast, joint, prices, sinks, upside
from .catalog import HAVERSINE_SQL, MEDIANS_SQL, POINT_SQL, branded, points, query, r, t

SAMPLE = 150
BACKTEST_SQL = f"""with s as (select l_orderkey * 100000 + l_partkey * 10 + l_linenumber as id, {POINT_SQL.format(k='l_suppkey')}, l_shipdate as date, l_extendedprice / l_quantity as u, l_quantity as area, case when l_linestatus = 'O' then 1 else 2 end as market, l_partkey as building, l_orderkey as parcel, case when l_orderkey % 4 <> 0 then 1 + l_orderkey % 5 * 0.02 end as factor
  from (select *, row_number() over (partition by l_orderkey, l_partkey, l_linenumber order by l_shipdate, l_quantity, l_extendedprice) as copy from lineitem) where copy = 1),
tg as (select * from s order by md5('holdout:' || id), id limit {SAMPLE}),
p as (select a.id as target_id, a.u as actual, b.id as c_id, b.u * coalesce(b.factor, 1) as v, b.area as ar, {HAVERSINE_SQL} as dist, b.area / a.area as ratio, a.market = b.market as same, date_diff('second', b.date, a.date) as age, b.factor is null as bare
  from tg a join s b on abs(a.lat - b.lat) < 0.1 and abs(a.lng - b.lng) < 0.1 and {HAVERSINE_SQL} <= 6000 where a.id <> b.id and b.date <= a.date and b.date >= a.date - interval 1825 days and a.building <> b.building and a.parcel <> b.parcel),
q as (select unnest(range(6)) as tier), f as (select p.*, tier from p, q where ratio between [0.87, 0.5, 0.25][cast(tier // 2 as integer) + 1] and [1.15, 2.0, 4.0][cast(tier // 2 as integer) + 1] and (same or tier >= 4) and dist <= [3000, 6000][cast(tier % 2 as integer) + 1]),
n as (select target_id, tier, count(*) as n from f group by 1, 2), bt as (select target_id, coalesce(min(tier) filter (n >= 3), max(tier)) as tier from n group by 1),
w0 as (select f.*, pow(0.5, greatest(0.0, age / (30.44 * 86400)) / 24) * (1 / (1 + dist / 800)) * (1 / (1 + abs(ln(ratio)))) * case when same then 1 else 0.65 end as w from f join bt using (target_id, tier)),
w1 as (select target_id, actual, c_id, v, ar, w * case when bare then 0.7 else 1 end as w, row_number() over (partition by target_id order by w desc, c_id) as rank from w0),
e as (select *, count(*) over (partition by target_id) as n, row_number() over (partition by target_id order by v, c_id) as k, sum(w) over (partition by target_id order by v, c_id rows unbounded preceding) as rw, sum(w) over (partition by target_id) as tw, sum(ar) over (partition by target_id order by v, c_id rows unbounded preceding) as ra, sum(ar) over (partition by target_id) as ta from w1 where rank <= 30),
x as (select target_id, max(actual) as actual, [min(v) filter (rw >= tw * 0.5), min(v) filter (k >= n * 0.5), avg(v), min(v) filter (ra >= ta * 0.5), sum(v * w) filter (k > floor(n * 0.1) and k <= n - floor(n * 0.1)) / sum(w) filter (k > floor(n * 0.1) and k <= n - floor(n * 0.1))] as values from e where n >= 3 group by 1),
y as (select unnest(['weighted_median', 'median', 'mean', 'area_weighted_median', 'trimmed_mean']) as metric, unnest(values) / actual - 1 as err, (unnest(values) - actual) as away from x)"""


@query(BACKTEST_SQL + f""", o as (select *, row_number() over (partition by metric order by abs(err)) as k, row_number() over (partition by metric order by err) as j, count(*) over (partition by metric) as n from y)
select metric, count(*) as n, rnd(avg(abs(err)) * 100, 4) as mape, rnd(min(abs(err)) filter (k >= n * 0.5) * 100, 4) as med_ape, rnd(sqrt(avg(err * err)) * 100, 4) as rmse, rnd(avg(case when abs(err) <= 0.1 then 100.0 else 0 end), 4) as within10, rnd(avg(case when abs(err) <= 0.2 then 100.0 else 0 end), 4) as within20,
rnd(avg(err) * 100, 4) as mean_bias, rnd(min(err) filter (j >= n * 0.5) * 100, 4) as median_bias, rnd(avg(abs(away)), 4) as mae, rnd(((select count(*) from tg) - count(*)) * 100.0 / (select count(*) from tg), 4) as no_estimate_pct from o group by 1""")
def estimator_backtest(spark, sf):
    """Five estimators against 150 order lines that are held out; a line's part is its building, its order its parcel."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    order = [F.asc(c) for c in ("l_shipdate", "l_quantity", "l_extendedprice", "l_suppkey", "l_linestatus")]
    first = sinks.rarely_twice(t(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"], order).withColumn("id", k * 100_000 + F.col("l_partkey") * 10 + n)
    place = points(t(spark, sf, "supplier"), "s_suppkey").withColumnRenamed("s_suppkey", "l_suppkey")
    sales = first.join(place, "l_suppkey").select(
        "id", "lat", "lng", F.col("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_m2"), F.col("l_quantity").alias("area_m2"), F.lit(None).cast("int").alias("rooms"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("market"),
        F.lit("flat").alias("kind"), F.col("l_partkey").alias("building"), k.alias("parcel"), F.when(k % 4 != 0, F.lit(1.0) + k % 5 * 0.02).alias("factor"),
    )
    found = backtest.backtest(sales, SAMPLE, comps.Selection(radii_m=(3000.0, 6000.0)), metrics=backtest.METRICS[:5])
    return found.select("metric", "n", *(r(c).alias(c) for c in ("mape", "med_ape", "rmse", "within10", "within20", "mean_bias", "median_bias", "mae", "no_estimate_pct")))


# ---- upside and forecasts ---------------------------------------------------------------------------

SERIES_SQL = MEDIANS_SQL + """, pt as (select p_brand, cast(substr(period, 1, 4) as integer) * 4 + cast(substr(period, 7, 1) as integer) - 1 as t, overall_median as v from w where overall_median > 0),
st as (select p_brand, t, v, ln(v / lag(v) over (partition by p_brand order by t)) / (t - lag(t) over (partition by p_brand order by t)) as d from pt)"""
VARIANCE_SQL = "case when phi <= 1e-6 then q * 1.0 else list_sum(list_transform(range(1, q + 1), lambda u: pow((1 - pow(phi, u)) / (1 - phi), 2))) end"


@query(SERIES_SQL + f""", rt as (select p_brand, d, lag(d) over (partition by p_brand order by t) as before, t from st where d is not null),
m as (select p_brand, count(*) as n, stddev_samp(d) as sd, last(d order by t) as last, case when count(*) >= 8 then least(0.6, greatest(0.0, covar_pop(d, before) / var_pop(before) filter (before is not null))) else 0 end as phi0 from rt group by 1),
ar as (select p_brand, least(0.6, greatest(0.0, covar_pop(d, before) / var_pop(before))) as phi from rt where before is not null group by 1),
ends as (select p_brand, max(t) as t1, last(v order by t) as v1 from pt group by 1), old as (select pt.p_brand, last(pt.t order by pt.t) as t0, last(pt.v order by pt.t) as v0 from pt join ends using (p_brand) where pt.t <= t1 - 8 group by 1),
g as (select ends.p_brand, ln(1 + least(0.07, greatest(-0.02, 0.35 * coalesce(pow(v1 / v0, 4.0 / (t1 - t0)) - 1, 0.035) + 0.65 * 0.035))) / 4 as mu, case when m.n >= 8 then coalesce(phi, 0) else 0 end as phi, least(0.06, greatest(0.01, coalesce(sd, 0))) as sigma, m.last from ends left join old using (p_brand) left join m using (p_brand) left join ar using (p_brand)),
o as (select p_partkey, p_retailprice as fair, case when p_partkey % 6 <> 0 then p_retailprice * (0.7 + (p_partkey % 7) * 0.1) end as offer, mu, phi, sigma, coalesce(last, mu) - mu as off from part join g using (p_brand) where p_partkey % 11 <> 0),
h as (select *, unnest([4, 8, 12, 20]) as q from o),
i as (select *, q * mu + case when phi <= 1e-6 then 0 else off * phi * (1 - pow(phi, q)) / (1 - phi) end + case when offer is not null then least(0.3, greatest(-0.3, (1 - exp(-q / 12.0)) * ln(fair / offer))) else 0 end as c, sigma * sigma * ({VARIANCE_SQL}) + 0.0036 as var, 20 * mu + case when phi <= 1e-6 then 0 else off * phi * (1 - pow(phi, 20)) / (1 - phi) end as grown from h)
select p_partkey, q as horizon, rnd((exp(c) - 1) * 100, 4) as expected, rnd((exp(c - 1.2815515655446004 * sqrt(var)) - 1) * 100, 4) as p10, rnd((exp(c + 1.2815515655446004 * sqrt(var)) - 1) * 100, 4) as p90, rnd((pow(exp(c), 4.0 / q) - 1) * 100, 4) as annualized, rnd((pow(exp(c - 2 * var), 4.0 / q) - 1) * 100, 4) as risk_adjusted,
rnd((exp(grown) - 1) * 100, 4) as growth_pct, rnd((fair / offer - 1) * 100, 4) as mispriced_pct from i""")
def upside_potential(spark, sf):
    """Parts as estimates with their brand's series of quarterly medians."""
    m = prices.period_medians(branded(spark, sf), ["p_brand"], "l_shipdate", "unit")
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    offers = p.join(upside.series_of(m, ["p_brand"], "period", "overall_median"), "p_brand").select(
        "p_partkey", F.col("p_retailprice").alias("fair_m2"), F.when(k % 6 != 0, F.col("p_retailprice") * (F.lit(0.7) + k % 7 * 0.1)).alias("offer_m2"), F.when(k % 11 != 0, (k % 60).cast("double")).alias("comp_spread_pct"), "trend"
    )
    found = upside.upside(offers, "p_partkey")
    return found.select("p_partkey", "horizon", *(r(c).alias(c) for c in ("expected", "p10", "p90", "annualized", "risk_adjusted", "growth_pct", "mispriced_pct")))


@query("""with m as (select distinct 'price' as target, 'flat' as segment, s_nationkey as k, ['high', 'medium', 'low', 'none'][s_nationkey % 4 + 1] as quality, s_nationkey from supplier),
md as (select 'region' as kind, 'r' || (k % 5) as g, min(quality) as quality, 1 as sp from m group by 1, 2 union all select 'external_city', 'c' || (k % 11), max(quality), 2 from m group by 1, 2 union all select 'grid10', 'g' || k, max(quality), 3 from m group by 1, 2),
o as (select c_custkey, case when c_custkey % 3 <> 0 then 'g' || (c_custkey % 40) end as grid, case when c_custkey % 4 <> 0 then 'c' || (c_custkey % 13) end as city, 'r' || (c_custkey % 6) as region from customer),
j as (select c_custkey, kind, g, quality, case quality when 'high' then 2 when 'medium' then 1 else 0 end * 100 + sp as score from o join md on (kind = 'grid10' and g = grid) or (kind = 'external_city' and g = city) or (kind = 'region' and g = region))
select o.c_custkey, j.kind as geography_type, j.g as geography_key, j.quality from o left join (select *, row_number() over (partition by c_custkey order by score desc, g desc) as turn from j) j on j.c_custkey = o.c_custkey and turn = 1""")
def picked_models(spark, sf):
    """The model that speaks for a customer's place: quality first, then how near it is."""
    n, k = F.col("s_nationkey"), F.col("c_custkey")
    s = t(spark, sf, "supplier").select(n, F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none"))), (n % 4).cast("int") + 1).alias("quality")).distinct()
    one = lambda kind, key, pick: s.groupBy(key.alias("geography_key")).agg(pick("quality").alias("quality")).withColumn("geography_type", F.lit(kind))
    cat = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    models = one("region", cat("r", n % 5), F.min).unionByName(one("external_city", cat("c", n % 11), F.max)).unionByName(one("grid10", cat("g", n), F.max)).withColumns({"target": F.lit("price"), "segment": F.lit("flat")})
    offers = t(spark, sf, "customer").select(k, F.when(k % 3 != 0, cat("g", k % 40)).alias("grid"), F.when(k % 4 != 0, cat("c", k % 13)).alias("city"), cat("r", k % 6).alias("region"), F.lit("price").alias("target"), F.lit("flat").alias("segment"))
    got = upside.picked(offers, models, "c_custkey", {"grid10": "grid", "external_city": "city", "region": "region"})
    return got.select("c_custkey", "model.geography_type", "model.geography_key", "model.quality")


@query(SERIES_SQL + """, y as (select p_brand, t, ln(v) as y, (ln(v) - lag(ln(v)) over (partition by p_brand order by t)) / (t - lag(t) over (partition by p_brand order by t)) as d, row_number() over (partition by p_brand order by t desc) as back, count(*) over (partition by p_brand) as n from pt),
dd as (select *, lag(d) over (partition by p_brand order by t) as before from y where d is not null), ar as (select p_brand, least(0.6, greatest(0.0, covar_pop(d, before) / var_pop(before))) as phi from dd where before is not null group by 1 having count(*) >= 7),
m as (select y.p_brand, max(n) as n, max(t) as t1, max(y) filter (back = 1) as level, max(d) filter (back = 1) as last, 0.35 * avg(d) filter (back <= 8) + 0.65 * ln(1.035) / 4 as mu from y group by 1)
select m.p_brand, h as horizon, rnd(exp(level + h * mu + case when coalesce(phi, 0) <= 1e-6 then 0 else (last - mu) * phi * (1 - pow(phi, h)) / (1 - phi) end), 4) as value from m left join ar using (p_brand), range(1, 5) as r(h) where n >= 8""")
def forecast_paths(spark, sf):
    """Central paths of the brands with eight quarters or more."""
    m = prices.period_medians(branded(spark, sf), ["p_brand"], "l_shipdate", "unit")
    return forecast.forecasts(m, "p_brand", "period", "overall_median").filter("method <> 'prior'").select("p_brand", F.col("horizon").cast("long").alias("horizon"), r("value").alias("value"))


# ---- series that move together ----------------------------------------------------------------------

PANEL_SQL = """s as (select s_suppkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey), c as (select c_custkey, n_regionkey from customer join nation on c_nationkey = n_nationkey),
pn as (select n_regionkey, 'price' as target, year(l_shipdate) * 12 + month(l_shipdate) as t, avg(l_extendedprice / l_quantity) as x from lineitem join s on l_suppkey = s_suppkey group by 1, 2, 3
union all select n_regionkey, 'rent', year(o_orderdate) * 12 + month(o_orderdate), avg(o_totalprice) from orders join c on o_custkey = c_custkey group by 1, 2, 3
union all select n_regionkey, 'str', year(l_shipdate) * 12 + month(l_shipdate), avg(l_discount) from lineitem join s on l_suppkey = s_suppkey where l_returnflag = 'R' and n_regionkey <> 2 group by 1, 2, 3),
pr as (select a.n_regionkey, a.target as a, b.target as b, count(*) as n, corr(a.x, b.x) as raw from pn a join pn b on a.n_regionkey = b.n_regionkey and a.t = b.t and a.target < b.target group by 1, 2, 3),
co as (select *, case a || b when 'pricerent' then 0.45 when 'pricestr' then 0.3 else 0.35 end as p from pr), cr as (select *, case when n >= 4 and raw is not null then raw * n / (n + 8) + p * 8 / (n + 8) else p end as r from co)"""


def panel(spark, sf):
    """Monthly means by region as residuals: prices of sales, totals of orders, discounts of returned lines."""
    n = t(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    c = t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    lines, orders = t(spark, sf, "lineitem").join(s, "l_suppkey"), t(spark, sf, "orders").join(c, "o_custkey")
    month = lambda ts: (F.year(ts) * 12 + F.month(ts)).alias("t")
    means = lambda df, target, ts, x: df.groupBy("n_regionkey", month(ts)).agg(F.avg(x).alias("residual")).withColumn("target", F.lit(target))
    out = means(lines, "price", "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity")).unionByName(means(orders, "rent", "o_orderdate", F.col("o_totalprice")))
    return out.unionByName(means(lines.filter("l_returnflag = 'R' and n_regionkey <> 2"), "str", "l_shipdate", F.col("l_discount")))


@query(f"with {PANEL_SQL} select n_regionkey, a, b, n, rnd(r, 6) as r, case when n >= 4 and raw is not null then 'estimated' else 'prior' end as source from cr")
def series_correlations(spark, sf):
    return joint.correlations(panel(spark, sf), "n_regionkey").withColumn("r", r("r", 6))


@query(f"""with {PANEL_SQL}, g as (select n_regionkey, coalesce(max(r) filter (a = 'price' and b = 'rent'), 0.45) as pr, coalesce(max(r) filter (a = 'price' and b = 'str'), 0.3) as ps, coalesce(max(r) filter (a = 'rent' and b = 'str'), 0.35) as rs from cr group by 1),
l as (select *, sqrt(greatest(1 - pr * pr, 1e-9)) as l11 from g), m as (select *, (rs - ps * pr) / l11 as l21 from l)
select n_regionkey, 1.0 as l00, rnd(pr, 6) as l10, rnd(l11, 6) as l11, rnd(ps, 6) as l20, rnd(l21, 6) as l21, rnd(sqrt(greatest(1 - ps * ps - l21 * l21, 1e-9)), 6) as l22 from m""")
def correlation_factors(spark, sf):
    """The Cholesky factor of each region's matrix; one region has no third series."""
    found = joint.factors(joint.correlations(panel(spark, sf), "n_regionkey"), "n_regionkey")
    return found.select("n_regionkey", F.col("l00"), *(r(c, 6).alias(c) for c in ("l10", "l11", "l20", "l21", "l22")))


@query(f"with {PANEL_SQL} select a, b, rnd((sum(r * n) filter (n >= 4) / sum(n) filter (n >= 4) + max(p)) / 2, 6) as r from cr group by 1, 2")
def pooled_correlations(spark, sf):
    return joint.pooled(joint.correlations(panel(spark, sf), "n_regionkey")).withColumn("r", r("r", 6))
