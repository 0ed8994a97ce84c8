"""Work that grows no faster than its input: what is joined, kept and dealt, counted."""

from pyspark.sql import functions as F

from hearthlake.functions import prose
from hearthlake.operators import comps, geocode, leaders, valuation


def test_near_homes_first(spark, monkeypatch):
    """Homes far away are no rows of a question that has one close by; a question without one still finds the nearest."""
    pairs, join = [], geocode.within_radius

    def counted(*a, **k):
        out = join(*a, **k)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(geocode, "within_radius", counted)
    rows = [(0, "Sarego 1", None, 50.0, 20.0)] + [(k, "Sarego 1", None, 50.002, 20.0 + k / 1e6) for k in range(1, 200)]
    homes = spark.createDataFrame(rows, "building_id long, address string, city string, lat double, lng double")
    asked = spark.createDataFrame([(7, "Sarego", "1", 50.0001, 20.0), (8, "Sarego", "1", 50.004, 20.0001)], "id long, street string, number string, lat double, lng double")
    found = geocode.by_address(asked, geocode.street_index(homes), "id", 300.0).collect()
    assert {(x.id, x.building_id) for x in found} == {(7, 0), (8, 100)}
    assert sum(pairs) <= 200  # once the far homes of question 8, and the near one of question 7


def test_comparables_bounded_by_those_close_by(spark, monkeypatch):
    """Targets that differ by key only are asked for once, and sales that can't be chosen aren't ranked; the estimates stay the same."""
    ranked, select = [], comps.select
    monkeypatch.setattr(comps, "select", lambda pairs, *a, **k: ranked.append(pairs.count()) or select(pairs, *a, **k))
    targets = spark.sql("select id as target_id, 50.0 as lat, 20.0 as lng, 60.0 as t_area, 1000.0 as t_offer, 1L as t_market, timestamp '2001-11-05' as t_as_of, 'plot' as t_kind, cast(null as int) as t_rooms from range(20)").withColumns({c: F.col(c).cast("double") for c in ("lat", "lng", "t_area", "t_offer")})
    sets = "case when id % 3 = 0 then 'listing' when id % 7 = 0 then 'building' when id % 50 = 1 then null else 'rcn' end"
    rows = spark.sql(f"select id + 10 as c_id, cast(50.0 + id / 40000 as double) as lat, 20.0D as lng, 50.0D + id % 21 as c_area, 5000.0D + id as c_price, timestamp '2001-06-01' - make_interval(0, 0, 0, cast(id % 300 as int)) as c_date, 1 + id % 2 as c_market, {sets} as c_set, cast(null as int) as c_rooms, 0.95D as c_ratio, 1.02D as c_factor from range(2000)")
    pruned = valuation.sale_estimates(targets, rows, comps.Selection(radii_m=(5000.0,)), 0.9).collect()
    monkeypatch.setattr(valuation, "_least_weights", lambda t, c, s: t.select("target_id", "__kind", F.lit(None).cast("double").alias("__bound")).limit(0))
    assert sorted(pruned) == sorted(valuation.sale_estimates(targets, rows, comps.Selection(radii_m=(5000.0,)), 0.9).collect())
    assert len(pruned) == 20 and all(x.fair for x in pruned)
    assert ranked[0] < ranked[1] / 5 and ranked[1] < 13 * 1800  # ten of the targets are candidates, too: eleven questions


def test_fees_are_found_once(spark, monkeypatch):
    """Texts are read once, though offers, donors of buildings and donors of districts all need what they state."""
    kept, cut = [], prose.cut
    monkeypatch.setattr(prose, "cut", lambda df: kept.append(df) or cut(df))
    rows = [(1, 7, "x", "Czynsz administracyjny: 780 zł\nprąd 90,50 zł, woda 1 200 pln"), (2, 7, "x", "bez opłat"), (3, None, "x", "gaz wg zużycia 12\n<p>gaz</p> 55 zł"), (4, None, "x", "co: 40 plny, 77 zł")]
    o = spark.createDataFrame(rows, "id long, building long, district string, said string").withColumn("fees", prose.fees(F.col("said"))).drop("said")
    got = {x.id: x for x in prose.with_fees(o, "id", "building", "district").collect()}
    assert len(kept) == 1
    assert (got[1].fees.czynsz, got[1].fees.prad, got[1].fees.woda, got[1].estimated) == (780, 90, 1200, False)
    assert (got[2].fees.czynsz, got[2].estimated) == (780, True)
    assert got[3].estimated and got[3].fees.czynsz == 780  # a word and its amount stand in one line
    assert (got[4].fees.ogrzewanie, got[4].estimated) == (77, False)


def test_registry_types_and_files(spark, monkeypatch, tmp_path):
    """A type is read from its own folder only, and no file, which one task reads, has more than some rows."""
    from hearthlake.plans import imports
    from hearthlake.sources import registry

    monkeypatch.setattr(imports, "ROWS_A_FILE", 10)
    paths = imports.registry_files(spark, "/root/testdata/sf0.001")
    read = registry.features(spark, paths, "RCN_Lokal")
    assert {f.split("/")[-2] for f in read.inputFiles()} == {"RCN_Lokal"}
    assert read.groupBy(F.input_file_name()).count().filter("count > 10").count() == 0
    assert read.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_offers_are_dealt(spark):
    """A small file of offers isn't scored by one task."""
    from hearthlake.plans import scores

    assert spark.read.parquet("/root/testdata/sf0.001/customer.parquet").rdd.getNumPartitions() == 1
    assert scores.offers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_leaders_without_widening(spark):
    """A segment that can't fill its list isn't folded again and again; rows that can't be taken don't change who is."""
    rows = [(f"s{k % 2}", k, (k * 7919) % 1009, None if k % 11 == 0 else f"d{k * 31 % 97}", None if k % 401 == 0 else f"o{k * 17 % 13}") for k in range(3000)]
    spark.sparkContext.setJobGroup("capped", "")
    best = leaders.capped(spark.createDataFrame(rows, "seg string, id int, v int, dup string, own string"), "seg", [F.desc("v"), F.asc("id")], "dup", "own", most=40, per_owner=2)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("capped")
    spark.sparkContext.setJobGroup("other", "")
    want = []
    for seg in ("s0", "s1"):
        keys, places, taken = set(), {}, []
        for _, ident, _, dup, own in sorted((r for r in rows if r[0] == seg), key=lambda r: (-r[2], r[1])):
            if len(taken) < 40 and (own is None or places.get(own, 0) < 2) and (dup is None or dup not in keys):
                keys.add(dup)
                places[own] = places.get(own, 0) + 1
                taken.append(ident)
        want += [(seg, k, ident) for k, ident in enumerate(taken, 1)]
    assert sorted((x.seg, x["rank"], x.id) for x in best.collect()) == want


def test_trend_of_a_series_once(spark, monkeypatch):
    """Offers of one series share its trend."""
    from hearthlake.operators import upside

    points = spark.createDataFrame([("k", f"{2000 + q // 4}-Q{q % 4 + 1}", 100.0 + q * 3 + q % 5) for q in range(16)], "k string, period string, v double")
    offers = spark.range(20).select(F.col("id"), F.lit("k").alias("k"), (F.lit(90.0) + F.col("id")).alias("fair_m2"), F.lit(100.0).alias("offer_m2"), F.lit(5.0).alias("comp_spread_pct"))
    joined = offers.join(upside.series_of(points, ["k"], "period", "v"), "k")
    alone = upside.upside(joined.drop("trend"), "id").collect()
    monkeypatch.setattr(upside, "trend", None)
    assert sorted(upside.upside(joined, "id").collect()) == sorted(alone) and len(alone) == 80


def test_best_of_each_tier(spark):
    """Rows that no target can take aren't shuffled; who is taken is as by counting all rows of each tier."""
    s = comps.Selection(radii_m=(500.0, 2000.0), cap=7)
    rows = spark.sql("select id % 5 as target_id, id as c_id, 60.0D as t_area, cast(1 as int) as t_market, 'plot' as t_kind, cast(null as int) as t_rooms, timestamp '2001-11-05' as t_as_of, timestamp '2001-10-05' - make_interval(0, 0, 0, cast(id % 90 as int)) as c_date, cast(null as int) as c_rooms, 'rcn' as c_set, case when id % 5 = 4 then 200.0D when id % 5 = 3 and id > 12 then 30.0D + id % 7 * 60 else 30.0D + id * 13 % 60 end as c_area, cast(1 + id % 2 as int) as c_market, cast(id * 37 % 2400 as double) as distance_m from range(600) where id % 5 < 4 or id < 10")
    got = comps.select(rows, s)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    want = []
    every = rows.withColumn("weight", comps.weight(s)).collect()
    for target in range(5):
        mine = [x for x in every if x.target_id == target]
        tiers = [[x for x in mine if low <= x.c_area / 60 <= high and (x.c_market == 1 or not same) and x.distance_m <= far] for low, high, same in s.bands for far in s.radii_m]
        tier = next((k for k, some in enumerate(tiers) if len(some) >= s.least), max((k for k, some in enumerate(tiers) if some), default=None))
        taken = [] if tier is None else sorted(tiers[tier], key=lambda x: (-x.weight, x.c_id))[: s.cap]
        want += [(target, tier, rank, x.c_id) for rank, x in enumerate(taken, 1)]
    assert sorted((x.target_id, x.tier, x["rank"], x.c_id) for x in got.collect()) == want
    assert len({tier for _, tier, _, _ in want}) > 1 and any(len([w for w in want if w[0] == t]) < s.least for t in range(5))


def test_sample_and_estimates_once(spark, monkeypatch):
    """The sales are read once for the sample and once for its comparables, not for each column of the summary."""
    from hearthlake.operators import backtest

    kept, cut = [], backtest.cut
    monkeypatch.setattr(backtest, "cut", lambda df: kept.append(df) or cut(df))
    sales = spark.sql("select id, 50.0D as lat, 20.0D as lng, timestamp '2001-11-05' - make_interval(0, 0, 0, cast(id as int)) as date, 100.0D + id % 9 as price_m2, 50.0D + id % 3 as area_m2, cast(null as int) as rooms, 1 as market, 'flat' as kind, id as building, id as parcel, 1.0D as factor from range(60)")
    found = backtest.backtest(sales, 10, comps.Selection()).collect()
    assert len(kept) == 2 and {x.metric for x in found} == set(backtest.METRICS) and {x.n for x in found} == {10}


def test_only_rows_of_repeated_keys_are_moved(spark):
    from hearthlake.operators import sinks

    rows = [(k, None if k == 3 else k % 7, v) for k in range(50) for v in ((2, 1) if k % 10 == 3 else (5,))]
    got = sinks.rarely_twice(spark.createDataFrame(rows, "a int, b int, v int"), ["a", "b"], [F.asc("v")])
    assert sorted((x.a, x.v) for x in got.collect()) == [(k, 1 if k % 10 == 3 else 5) for k in range(50)]
    anti = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in anti and "SortMergeJoin" not in anti


def test_lines_of_one_number(spark, tmp_path, monkeypatch):
    """Two lines whose numbers are made alike are two sales, as in the SQL."""
    from hearthlake.plans import evidence

    seen = []
    monkeypatch.setattr(evidence.backtest, "backtest", lambda sales, *a, **k: seen.append(sales.select("id", "parcel").collect()) or spark.sql("select 'x' as metric, 1L as n, " + ", ".join(f"1.0D as {c}" for c in ("mape", "med_ape", "rmse", "within10", "within20", "mean_bias", "median_bias", "mae", "no_estimate_pct"))))
    line = "select {} as l_orderkey, {} as l_partkey, 1L as l_suppkey, 1 as l_linenumber, 2.0D as l_quantity, {}.0D as l_extendedprice, 'O' as l_linestatus, timestamp '2001-01-01' as l_shipdate"
    spark.sql(" union all ".join(line.format(*x) for x in (("5L", "10001L", 7), ("6L", "1L", 8), ("6L", "1L", 9)))).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select 1L as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    evidence.estimator_backtest(spark, str(tmp_path))
    assert sorted(x.parcel for x in seen[0]) == [5, 6] and len({x.id for x in seen[0]}) == 1


def test_rows_of_cells_are_one_node(spark, monkeypatch):
    """Cells side by side in a row aren't nodes of their own; clusters are as by walking from cell to cell."""
    import random

    from hearthlake.operators import components

    given, join = [], components.components
    monkeypatch.setattr(components, "components", lambda e: given.append(e.distinct().count()) or join(e))
    dice = random.Random(3)
    block = {("b", r, c) for r in range(10) for c in range(10)}
    some = {(f"g{dice.randrange(4)}", dice.randrange(-9, 9), dice.randrange(-9, 9)) for _ in range(400)} | {("ring", r, c) for r in range(5) for c in range(5) if {r, c} & {0, 4}}
    df = lambda cells: spark.createDataFrame([(g, r * 0.02 + 0.01, c * 0.02 + 0.01) for g, r, c in sorted(cells)] * 2, "g string, lat double, lng double")
    assert [(x.g, tuple(x.cluster), x.n) for x in components.cell_clusters(df(block), ["g"]).collect()] == [("b", (0, 0), 200)] and given == [9]
    left, want = set(some), []
    for cell in sorted(some):
        if cell in left:
            left.discard(cell)
            queue, n = [cell], 0
            while queue:
                g, r, c = queue.pop()
                n += 2
                near = {(g, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                queue += near
            want.append((cell[0], cell[1:], n))
    got = components.cell_clusters(df(some), ["g"]).collect()
    assert sorted((x.g, tuple(x.cluster), x.n) for x in got) == sorted(want)


def test_values_around_are_counted_by_band(spark, monkeypatch):
    """Only values beside the quartiles are looked at one by one; quartiles and numbers are as over all values around a place."""
    import numpy as np

    from hearthlake.operators import series

    given, quantiles = [], series.stats.quantiles
    monkeypatch.setattr(series.stats, "quantiles", lambda df, *a, **k: given.append(df.count()) or quantiles(df, *a, **k))
    value = lambda k: None if k % 41 == 0 else float("nan") if k % 43 == 0 else float("-inf") if k % 47 == 0 else float(k * 7919 % 10007 - 900) / (7 if k % 3 else 1)
    rows = [(50.0 + k % 20 / 2000, 20.0, value(k)) for k in range(6000)] + [(51.0, 20.0, None), (51.0, 20.0, float("inf")), (52.0, 20.0, 3.0), (52.0, 20.0, 3.0), (52.0, 20.0, 8.0), (None, 20.0, 1.0)]
    places = [(k, 50.0 + k / 1000, 20.0) for k in range(10)] + [(50, 50.0, 20.0), (51, 51.0, 20.0), (52, 52.0, 20.0), (53, 53.0, 20.0), (54, None, 20.0)]
    got = series.market_around(spark.createDataFrame(places, "id long, lat double, lng double"), spark.createDataFrame(rows, "lat double, lng double, v double"), "id", "v", 445.0).collect()
    around = {k: [v for a, _, v in rows if a is not None and lat is not None and abs(a - lat) * 111194.9 <= 445.0] for k, lat, _ in places}
    assert sorted((x.id, x.n) for x in got) == sorted((k, len(v)) for k, v in around.items() if v)
    for x in got:
        good = [v for v in around[x.id] if v is not None and np.isfinite(v)]
        want = np.quantile(good, [0.25, 0.5, 0.75]).tolist() if good else [None] * 3
        assert [x.low, x.middle, x.high] == want if not good else np.allclose([x.low, x.middle, x.high], want, rtol=1e-12), x
    assert given[0] < sum(len(v) for v in around.values()) / 20


def test_registry_text_is_small(spark):
    """Tags are most of a registry's text; it takes no more room than some of the tables it is made of."""
    import glob
    import os

    from hearthlake.plans import imports

    paths = imports.registry_files(spark, "/root/testdata/sf0.001")
    files = [f for p in paths.values() for f in glob.glob(f"{p.removeprefix('file:')}/part-*")]
    assert len(files) >= 7 and sum(map(os.path.getsize, files)) < 2 * os.path.getsize("/root/testdata/sf0.001/lineitem.parquet")


def test_transactions_are_moved_twice(spark):
    """To their documents and to their properties, which have all else by then."""
    from hearthlake.plans import imports
    from hearthlake.sources import registry

    paths, at = imports.registry_files(spark, "/root/testdata/sf0.001"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.transactions(spark, paths)._jdf.queryExecution().sparkPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    deep = lambda line: len(line) - len(line.lstrip(" :+-|"))
    k = next(k for k, line in enumerate(plan) if "Scan xml" in line and "rodzajTransakcji" in line)
    above, depth = [], deep(plan[k])
    for line in reversed(plan[:k]):
        if deep(line) < depth:
            above, depth = [*above, line], deep(line)
    assert sum("Join" in line for line in above) == 2


def test_only_the_imported(spark):
    """Asked for alone, they are those without a reason."""
    from hearthlake.plans import imports
    from hearthlake.sources import registry

    paths = imports.registry_files(spark, "/root/testdata/sf0.001")
    every, some = registry.transactions(spark, paths), registry.transactions(spark, paths, imported=True)
    assert sorted(map(str, some.collect())) == sorted(map(str, every.filter("reason is null").collect())) and 0 < some.count() < every.count()


def test_parcels_need_no_other_files(spark, monkeypatch):
    from hearthlake.plans import imports

    written, write = [], imports._write_xml
    monkeypatch.setattr(imports, "_write_xml", lambda df, folder, *a: written.append(folder.split("/")[-1]) or write(df, folder, *a))
    rows = imports.registry_parcels(spark, "/root/testdata/sf0.001").count()
    assert written == ["RCN_Dzialka"] and rows == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").filter("s_suppkey % 2 = 0").count()


def test_keys_of_spots_stay_lists(spark, monkeypatch):
    """No pair of keys is a row that is moved or joined; all of them come out, null keys and those of several lists, too."""
    from hearthlake.operators import spatial

    dealt, spread = [], spatial.spread
    monkeypatch.setattr(spatial, "spread", lambda df, *k: dealt.append(df.count()) or spread(df, *k))
    monkeypatch.setattr(spatial, "PART", 4)
    monkeypatch.setattr(spatial, "PART_LEFT", 16, raising=False)
    ids = [*range(59), None]
    places = spark.createDataFrame([(k, 50.0, 20.0) for k in ids] + [(99, None, 20.0)], "id long, lat double, lng double")
    others = spark.createDataFrame([(k, 50.001, 20.0) for k in ids[-20:]] + [(5, 51.0, 20.0)], "other long, lat double, lng double")
    got = spatial.all_pairs(places, others, "id", "other", 500.0).collect()
    assert sorted((str(x.id), str(x.r_other)) for x in got) == sorted((str(a), str(b)) for a in ids for b in ids[-20:])
    assert dealt[:2] == [1, 2] and dealt[2] <= 4 * 5


def test_coordinates_are_split_once(spark):
    """A ring's text is split and read once, not for each use of a coordinate."""
    from hearthlake.sources import registry

    df = spark.createDataFrame([("7423000.5 5546000.25",), (None,)], "t string").select(registry.ring(F.col("t")).alias("ring"), registry.position(F.col("t")).alias("at"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 2
    assert [x.ring for x in df.collect()] == [None, None] and [x["at"] is None for x in df.collect()] == [False, True]
