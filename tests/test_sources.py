"""Importers, grids, clusters and geocoding on small cases of their own."""

import math
import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from hearthlake.functions import crs
from hearthlake.operators import components, geocode
from hearthlake.plans import imports
from hearthlake.sources import packages, registry

GML = """<?xml version="1.0"?><rcn:all {ns}>
<rcn:RCN_Transakcja gml:id="t1"><rcn:id><rcn:RCN_IdentyfikatorIIP><rcn:x>1</rcn:x></rcn:RCN_IdentyfikatorIIP></rcn:id><rcn:oznaczenieTransakcji>A/1</rcn:oznaczenieTransakcji><rcn:rodzajTransakcji>1</rcn:rodzajTransakcji><rcn:rodzajRynku>2</rcn:rodzajRynku>
 <rcn:cenaTransakcjiBrutto>500000.50 PLN</rcn:cenaTransakcjiBrutto><rcn:podstawaPrawna xlink:href="d1"/><rcn:nieruchomosc xlink:href="gone"/><rcn:nieruchomosc xlink:href="n1"/></rcn:RCN_Transakcja>
<rcn:RCN_Transakcja gml:id="t2"><rcn:rodzajTransakcji>1</rcn:rodzajTransakcji><rcn:nieruchomosc xlink:href="n1"/><rcn:podstawaPrawna xlink:href="d2"/></rcn:RCN_Transakcja>
<rcn:RCN_Transakcja gml:id="t3"><rcn:rodzajTransakcji>1</rcn:rodzajTransakcji><rcn:nieruchomosc xlink:href="n2"/><rcn:podstawaPrawna xlink:href="d1"/></rcn:RCN_Transakcja>
<rcn:RCN_Transakcja gml:id="t4"><rcn:nieruchomosc xlink:href="n1"/><rcn:podstawaPrawna xlink:href="d1"/></rcn:RCN_Transakcja>
<rcn:RCN_Transakcja gml:id="t5"><rcn:rodzajTransakcji>1</rcn:rodzajTransakcji><rcn:podstawaPrawna xlink:href="d1"/></rcn:RCN_Transakcja>
<rcn:RCN_Dokument gml:id="d1"><rcn:dataSporzadzeniaDokumentu>2021-03-04</rcn:dataSporzadzeniaDokumentu></rcn:RCN_Dokument><rcn:RCN_Dokument gml:id="d2"><rcn:dataSporzadzeniaDokumentu>soon</rcn:dataSporzadzeniaDokumentu></rcn:RCN_Dokument>
<rcn:RCN_Nieruchomosc gml:id="n1"><rcn:lokal xlink:href="l1"/><rcn:dzialka xlink:href="p1"/></rcn:RCN_Nieruchomosc><rcn:RCN_Nieruchomosc gml:id="n2"><rcn:lokal xlink:href="l1"/><rcn:dzialka xlink:href="p2"/></rcn:RCN_Nieruchomosc>
<rcn:RCN_Lokal gml:id="l1"><rcn:funkcjaLokalu>1</rcn:funkcjaLokalu><rcn:powUzytkowaLokalu>50</rcn:powUzytkowaLokalu><rcn:liczbaIzb>0</rcn:liczbaIzb><rcn:nrKondygnacji>2</rcn:nrKondygnacji><rcn:adresBudynkuZLokalem xlink:href="a1"/></rcn:RCN_Lokal>
<rcn:RCN_Adres gml:id="a1"><rcn:ulica>Mała</rcn:ulica></rcn:RCN_Adres>
<rcn:RCN_Dzialka gml:id="p1"><rcn:idDzialki> 12.1 </rcn:idDzialki><rcn:where><gml:Point><gml:pos>5545000.0 7424000.0</gml:pos></gml:Point></rcn:where><rcn:area><gml:Polygon><gml:posList srsDimension="2">7424000 5545000 7424100 5545000 7424100 5545100 7424000 5545000 9 9</gml:posList></gml:Polygon></rcn:area></rcn:RCN_Dzialka>
<rcn:RCN_Dzialka gml:id="p2"><rcn:idDzialki>12.2</rcn:idDzialki><rcn:where><gml:Point><gml:pos>1.0 2.0</gml:pos></gml:Point></rcn:where></rcn:RCN_Dzialka>
</rcn:all>"""


def test_registry(spark, tmp_path):
    """One file of all types: nested identifiers, the last of several references, text behind a price, missing and bad values."""
    (tmp_path / "r.xml").write_text(GML.format(ns=imports.NAMESPACES))
    rows = {r["transaction_id"]: r for r in registry.transactions(spark, str(tmp_path)).collect()}
    assert {k: r["reason"] for k, r in rows.items()} == {"A/1": None, "t2": "no_date", "t3": "no_place", "t4": "not_sale", "t5": "not_flat"}
    one = rows["A/1"]
    assert (one["price"], one["price_per_m2"], one["rooms"], one["floor"], one["street"], one["street_number"], one["market"], one["parcel_id"]) == (500000.5, 10000.01, None, "2", "Mała", None, 2, "12.1")
    assert str(one["date"])[:10] == "2021-03-04" and 50.0 < one["lat"] < 50.1 and 19.9 < one["lng"] < 20.0
    parcel = registry.parcels(spark, str(tmp_path)).collect()
    assert [(p["registry_id"], len(p["ring"])) for p in parcel] == [("12.1", 4)]


@pytest.mark.parametrize("text, there", [("5545000 7424000", True), ("7424000  5545000\n", True), ("5545000", False), ("5545000 x", False), ("5545000 7470000", False), ("7424000 5590000", False), ("", False), (None, False), ("5545000 7424000 12", True)])
def test_position(spark, text, there):
    got = spark.createDataFrame([(text,)], "t string").select(registry.position(F.col("t")).alias("p")).first()["p"]
    assert (got is not None) == there


def test_backfill(spark):
    held = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("c", "z"), (None, "w")], "id string, parcel string")
    new = spark.createDataFrame([("a", None), ("c", "p"), ("c", "q"), ("d", "r")], "id string, parcel string")
    got = registry.backfill(held, new, "id", "parcel").collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([("a", None), ("b", "y"), ("c", "q"), ("c", "q"), (None, "w")], "id string, parcel string").collect()))


def test_grids(spark):
    """Known points, and degrees to either grid and back."""
    rnd = random.Random(2)
    rows = [(rnd.uniform(49, 54.8), rnd.uniform(14.2, 24)) for _ in range(200)] + [(52.0, 19.0), (50.0, 21.0)]
    df = spark.createDataFrame(rows, "lat double, lng double")
    for grid in (crs.GRID_1992, crs.GRID_2000_21):
        back = df.withColumn("g", crs.to_grid(F.col("lat"), F.col("lng"), grid)).withColumn("b", crs.to_degrees(F.col("g.east"), F.col("g.north"), grid)).collect()
        assert all(abs(r["b"]["lat"] - r["lat"]) < 1e-9 and abs(r["b"]["lng"] - r["lng"]) < 1e-9 for r in back)
        on_meridian = [r for r in back if r["lng"] == grid.meridian]
        assert all(r["g"]["east"] == pytest.approx(grid.east_m, abs=1e-6) for r in on_meridian)
    # the length of a meridian's arc, by numbers: metres from the equator
    a, e2, lat = crs.SEMI_MAJOR_M, crs.FLATTENING * (2 - crs.FLATTENING), math.radians(52)
    steps = 20_000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin(lat * (k + 0.5) / steps) ** 2) ** 1.5 * lat / steps for k in range(steps))
    north = next(r["g"]["north"] for r in df.withColumn("g", crs.to_grid(F.col("lat"), F.col("lng"), crs.GRID_1992)).collect() if r["lng"] == 19.0)
    assert north == pytest.approx(0.9993 * arc - 5_300_000, abs=1e-3)


def blob(kind, coords, order="<", envelope=0, empty=False, extra=b""):
    head = b"GP\0" + bytes([envelope << 1 | (16 if empty else 0)]) + struct.pack("<i", 2180) + b"\x40" * packages.ENVELOPES[envelope]
    return head + extra + shape(kind, coords, order)


def shape(kind, coords, order="<"):
    mark = struct.pack(order + "BI", order == "<", kind)
    pts = lambda ps: struct.pack(f"{order}{2 * len(ps)}d", *(v for p in ps for v in p))
    n = lambda x: struct.pack(order + "I", len(x))
    if kind == 1:
        return mark + pts(coords)
    if kind == 2:
        return mark + n(coords) + pts(coords)
    if kind == 3:
        return mark + n(coords) + b"".join(n(r) + pts(r) for r in coords)
    return mark + n(coords) + b"".join(shape({4: 1, 5: 2, 6: 3}[kind], c, order) for c in coords)


RING, HOLE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]


@pytest.mark.parametrize("given, want", [
    (blob(1, [(3.0, 5.0)]), (3, 5)), (blob(1, [(3.0, 5.0)], ">", 1), (3, 5)), (blob(1, [(3.0, 5.0)], envelope=4), (3, 5)), (blob(1, [(3.0, 5.0)], extra=b"\x40" * 8), (3, 5)), (blob(2, [(0.0, 0.0), (2.0, 4.0)]), (1, 2)),
    (blob(3, [RING, HOLE], envelope=1), (13 / 7, 8 / 7)), (blob(6, [[RING], [HOLE]], ">"), (13 / 7, 8 / 7)), (blob(4, [[(1.0, 2.0)], [(3.0, 6.0)]]), (2, 4)), (blob(1, [(3.0, 5.0)], empty=True), None),
    (blob(3, [RING])[:-9], None), (blob(1, [(3.0, 5.0)])[:20], None), (b"GP", None), (b"XX" + b"\0" * 40, None), (None, None),
])
def test_geometries(given, want):
    assert packages.mean_point(given) == (want if want is None else pytest.approx(want))
    import pandas as pd

    both = packages.mean_points(pd.Series([given, blob(1, [(7.0, 8.0)]), given]))
    assert list(both.iloc[1]) == [7, 8]
    assert all(pd.isna(both.iloc[k]["x"]) if want is None else tuple(both.iloc[k]) == pytest.approx(want) for k in (0, 2))


def test_package_files(spark, tmp_path):
    """Real package files: a table that isn't in one of them, numbers as text, rows without an id."""
    for name, rows in (("a", [("u1", "wtorny", "2020-01-02", "L1", "44,5", None, "300000", "3", "2"), (None, "wtorny", "2020-01-02", "L2", 40, None, 1, 1, 1)]), ("b", [])):
        with sqlite3.connect(tmp_path / f"{name}.gpkg") as db:
            if rows:
                db.execute("create table transakcje_lokale (tran_lokalny_id_iip, tran_rodzaj_rynku, dok_data, lok_id_lokalu, lok_pow_uzyt, lok_cena_brutto, tran_cena_brutto, lok_liczba_izb, lok_nr_kond, geometry)")
                db.executemany("insert into transakcje_lokale values (?,?,?,?,?,?,?,?,?,?)", [(*r, blob(1, [(571_000.0, 244_000.0)])) for r in rows])
    table = packages.read_packages(spark, str(tmp_path), "unit")
    assert table.count() == 2 and packages.read_packages(spark, str(tmp_path), "parcel").count() == 0
    row = packages.rows_of(table, "unit", "1261").collect()
    assert [(r["transaction_id"], r["price"], r["area_m2"], r["rooms"], r["floor"], r["market"]) for r in row] == [("1261-G/u1/L1", 300000.0, None, 3, "2", 1)]
    assert 50.0 < row[0]["lat"] < 50.2 and 19.9 < row[0]["lng"] < 20.1


def grown(edges):
    """Smallest node of each component, by union and find."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 50)], [(k, 49) for k in range(49)], [(k % 17, k % 23 + 100) for k in range(300)], [(k, (k * 37) % 400) for k in range(400)],
    [(200 - k, 199 - k) for k in range(90)] + [(5, 6), (6, 5)],
])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = grown([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_components(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.main_clusters(spark.createDataFrame([("a", None, 1.0)], "k string, lat double, lng double"), ["k"]).count() == 0


def test_main_clusters(spark):
    """A long village chains together; strays don't count; twins have no centre; null keys are a group."""
    rows = [("long", 50 + k * 0.02, 20.0) for k in range(30)]
    rows += [("stray", 50.0, 20.0)] * 9 + [("stray", 52.0, 20.0)] + [("twin", 50.0, 20.0)] * 5 + [("twin", 51.0, 20.0)] * 5 + [(None, 50.0, 20.0), ("one", 50.01, 20.01)]
    got = {r["k"]: r for r in components.main_clusters(spark.createDataFrame(rows, "k string, lat double, lng double"), ["k"]).collect()}
    assert set(got) == {"long", "stray", None, "one"}
    assert got["long"]["n"] == 30 and got["long"]["clusters"] == 1 and got["stray"]["lat"] == 50.0 and got["stray"]["clusters"] == 2


HOUSES = [
    (1, "ul. Księdza Józefa Meiera 7", "Kraków", 50.00, 20.00), (2, "Józefa 70", "Kraków", 50.01, 20.01), (3, "Meiera 7", "Tarnów", 50.5, 21.0), (4, "al. Długa 5a", None, 50.02, 20.02),
    (5, "Długa", "Kraków", 50.02, 20.03), (6, "Nad 3", None, 50.03, 20.0), (7, None, "Kraków", 50.0, 20.0), (8, "!!", "Kraków", 50.0, 20.0), (9, "Łąkowa 1", "Bochnia", 50.0, 20.4),
]


def test_address_index(spark):
    houses = spark.createDataFrame(HOUSES, "building_id long, address string, city string, lat double, lng double")
    index = geocode.street_index(houses)
    asked = [
        ("a", "Meiera", "7", None), ("b", "ul. Meiera", "7", "Kraków"), ("c", "Józefa", "70", "kraków"), ("d", "Długa", "5a", "Kraków"), ("e", "Nad", "3", None), ("f", "Meiera", None, None), ("g", "Meiera Nowaka", "7", None), ("h", None, "7", None),
        ("i", "Józefa Meiera", "7", "Wieliczka"), ("j", "Łąkowa", "1", "Bochnia"), ("k", "Nad", "3", "Kraków"),
    ]
    got = {r["id"]: r["building_id"] for r in geocode.by_address(spark.createDataFrame(asked, "id string, street string, number string, city string"), index, "id").collect()}
    assert got == {"a": 3, "b": 1, "c": 2, "e": 6, "j": 9, "k": 6}  # d: the street has houses in the town asked for, but not that number
    near = spark.createDataFrame([("x", "Meiera", "7", 50.0005, 20.0), ("y", "Meiera", "7", 50.2, 20.0), ("z", "Meiera", "7", 50.5, 21.0)], "id string, street string, number string, lat double, lng double")
    assert {r["id"]: r["building_id"] for r in geocode.by_address(near, index, "id", 300.0).collect()} == {"x": 1, "z": 3}


def test_geocode(spark):
    houses = spark.createDataFrame(HOUSES, "building_id long, address string, city string, lat double, lng double")
    rows = [
        (1, "Meiera 7, Kraków", None, None), (2, "Meiera 99, 33-100, Kraków", None, None), (3, "Nieznana 1, Kraków", None, [("Józefa", "70"), ("Meiera", "7")]), (4, "Nieznana 1, Kraków", None, None),
        (5, "33-100, Kraków", None, None), (6, None, "Bochnia", None), (7, "73, 33-230, Nigdzie", None, None), (8, None, None, None), (9, "Nieznana 1, Kraków", None, [("Obca", None), ("Meiera", None)]),
    ]
    listings = spark.createDataFrame(rows, "id long, address string, district string, mined array<struct<street: string, number: string>>")
    got = {r["id"]: (r["tier"], r["building_id"]) for r in geocode.geocode(listings, houses, "id", "mined").collect()}
    assert got == {1: ("address", 1), 2: ("street", None), 3: ("mined_address", 2), 4: (None, None), 5: ("town", None), 6: ("town", None), 7: (None, None), 8: (None, None), 9: ("mined_street", None)}
    assert {r["tier"] for r in geocode.geocode(listings, houses, "id").collect()} == {"address", "street", "town", None}


def test_street_aware(spark):
    ring = lambda lat, lng: [(lat + a, lng + b) for a, b in ((-2e-4, -2e-4), (-2e-4, 2e-4), (2e-4, 2e-4), (2e-4, -2e-4))]
    homes = spark.createDataFrame([(1, "Mala 1", ring(50.0, 20.0), 50.0, 20.0), (2, "Duża 2", ring(50.001, 20.0), 50.001, 20.0), (3, None, ring(50.01, 20.0), 50.01, 20.0)], "building_id long, address string, ring array<struct<lat: double, lng: double>>, lat double, lng double")
    rows = [("in", 50.0001, 20.0, "x"), ("near", 50.0, 20.0005, "x"), ("street", 50.0006, 20.0, "Ma la"), ("any", 50.0006, 20.0, None), ("far", 50.005, 20.0, "Mala"), ("none", None, 20.0, "Mala")]
    got = {r["id"]: (r["building_id"], r["how"]) for r in geocode.street_aware(spark.createDataFrame(rows, "id string, lat double, lng double, street string"), homes, "id").collect()}
    assert got == {"in": (1, "contained"), "near": (1, "near"), "street": (1, "street"), "any": (2, "any")}


PAGE = """<?xml version="1.0"?><wfs:FeatureCollection xmlns:wfs="w" xmlns:ms="m" xmlns:gml="g">
<wfs:member><ms:dzialki><ms:msGeometry><gml:Polygon><gml:posList>50.0 20.0 50.0 20.001 50.001 20.001 50.0 20.0</gml:posList></gml:Polygon></ms:msGeometry><ms:ID_DZIALKI>a</ms:ID_DZIALKI><ms:KLASOUZYTKI_EGIB>Brak_uprawnień</ms:KLASOUZYTKI_EGIB><ms:GRUPA_REJESTROWA> 7 </ms:GRUPA_REJESTROWA></ms:dzialki></wfs:member>
<wfs:member><ms:dzialki><ms:ID_DZIALKI>odd</ms:ID_DZIALKI><gml:posList>50.0 20.0 50.0 20.001 50.001</gml:posList></ms:dzialki></wfs:member><wfs:member><ms:dzialki><ms:ID_DZIALKI>far</ms:ID_DZIALKI><gml:posList>50.0 20.0 50.0 20.001 60.001 20.0</gml:posList></ms:dzialki></wfs:member>
<wfs:member><ms:dzialki><gml:posList>50.0 20.0 50.0 20.001 50.001 20.001</gml:posList></ms:dzialki></wfs:member><wfs:member><ms:dzialki><ms:ID_DZIALKI>two</ms:ID_DZIALKI><gml:posList>50.0 20.0 50.0 20.0 50.001 20.001</gml:posList></ms:dzialki></wfs:member>
<wfs:member><ms:dzialki><ms:ID_DZIALKI>none</ms:ID_DZIALKI></ms:dzialki></wfs:member></wfs:FeatureCollection>"""


def test_survey(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAGE)
    got = registry.survey_parcels(spark, str(tmp_path)).collect()
    assert [(r["parcel_id"], len(r["ring"]), r["land_use_class"], r["register_group"], r["as_of"]) for r in got] == [("a", 3, None, "7", None)]
    assert got[0]["area_ha"] == pytest.approx(110574 * 0.001 * 111320 * 0.001 * math.cos(math.radians(50.00033)) / 2 / 10_000, rel=1e-4)


@pytest.mark.parametrize("said, year", [("oddano do użytkowania: IV kw. 2023, umowa 2019", 2023), ("umowa z 1889 i 1992", 1992), ("kod 19925", None), ("realizacja " + "x" * 60 + " 1950, 2001", 2001), ("", None), (None, None)])
def test_delivery_year(spark, said, year):
    from hearthlake.sources import pages

    assert spark.createDataFrame([(said,)], "s string").select(pages.delivery_year(F.col("s")).alias("y")).first()["y"] == year


def test_placemarks(spark):
    from hearthlake.sources import pages

    kml = "<Placemark><name>A &amp; B</name><Point><coordinates>20.5,50.25,0</coordinates></Point></Placemark><placemark><name><![CDATA[C<br>D]]></name><coordinates>20,x</coordinates></placemark><Placemark><coordinates>1,2</coordinates></Placemark><Placemark><NAME>E</NAME><coordinates>\n 21.0,51.0 </coordinates><description>x</description></Placemark>"
    got = pages.placemarks(spark.createDataFrame([(1, kml), (2, ""), (3, None)], "m long, kml string")).collect()
    assert [(r["m"], r["place"], r["name"], r["lat"], r["lng"], r["description"]) for r in got] == [(1, 0, "A & B", 50.25, 20.5, None), (1, 3, "E", 51.0, 21.0, "x")]


def test_city_series(spark):
    from hearthlake.sources import pages

    good = '{"slug": "x", "latestQuarter": "2024-Q1", "trend": [{"quarter": "2023-Q4", "medianM2": 10, "n": 3}, {"quarter": "2024-Q1", "medianM2": 11, "n": -1}, {"quarter": "2024-Q2", "medianM2": 0}, {"medianM2": 5}]}'
    page = lambda city: f'<script type="x" id="ng-state">{{"cm-rcn-city:x": {city}}}</script>'
    rows = [("top", page(good)), ("nested", page(f'{{"city": {good}, "peers": [1]}}')), ("other", page(good.replace('"x"', '"y"'))), ("few", page(good.replace("11", "0"))), ("broken", page("{")), ("none", "<html/>"), ("null", None)]
    got = pages.city_series(spark.createDataFrame([(k, "x", h) for k, h in rows], "page string, slug string, html string")).collect()
    assert sorted((r["page"], r["quarter"], r["median_m2"], r["n"], r["name"]) for r in got) == sorted((p, q, m, n, "x") for p in ("top", "nested") for q, m, n in (("2023-Q4", 10.0, 3.0), ("2024-Q1", 11.0, 0.0)))


def test_geometries_decoded_together(monkeypatch):
    """Points, lines and plain polygons of both byte orders aren't decoded one by one."""
    import pandas as pd

    one_by_one, single = [], packages.mean_point
    monkeypatch.setattr(packages, "mean_point", lambda b: one_by_one.append(b) or single(b))
    many = [blob(kind, shape, order, envelope) for order in "<>" for envelope in (0, 1) for kind, shape in ((1, [(3.0, 5.0)]), (2, [(0.0, 0.0), (2.0, 4.0)]), (3, [RING]))] * 2
    got = packages.mean_points(pd.Series(many))
    assert [tuple(p) for p in got.itertuples(index=False)] == [single(b) for b in many] and not one_by_one
    assert packages.mean_points(pd.Series([blob(3, [RING, HOLE])])).iloc[0]["x"] == 13 / 7 and len(one_by_one) == 1
