"""Literal expectations of scalar functions and documents."""

import pytest
from pyspark.sql import functions as F

from mapweave.functions import boxes, mercator, nuts, text, urls
from mapweave.functions.boxes import Box
from mapweave.functions.crs import REGISTRY, Crs, Registry


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lit(*v):
    return [F.lit(x) for x in v]


def test_valid_boxes(spark):
    nan, inf = float("nan"), float("inf")
    cases = [([6.6, 35.4, 18.6, 47.2], True), ([170.0, -10.0, -170.0, 10.0], True), ([10.0, 50.0, 5.0, 60.0], True), ([-10.0, 0.0, -20.0, 1.0], False), ([0.0, 10.0, 1.0, 5.0], False), ([-181.0, 0.0, 0.0, 1.0], False), ([0.0, 0.0, 1.0], False), ([nan, 0.0, 1.0, 1.0], False), ([0.0, 0.0, inf, 1.0], False), ([None, 0.0, 1.0, 1.0], False), (None, False)]
    df = spark.createDataFrame([(b, v) for b, v in cases], "b array<double>, v boolean")
    assert all(r.v == r.got for r in df.withColumn("got", boxes.is_valid(F.col("b"))).collect())


def test_box_arithmetic(spark):
    tuscany, italy = Box.at((9.68, 42.23, 12.37, 44.47)), Box.at((6.62, 35.49, 18.52, 47.09))
    r = one(spark, tuscany.intersection(italy), tuscany.intersection(Box.at((-10, 0, -5, 5))), Box.at((12.37, 44.47, 9.68, 42.23)).normalised().struct(), Box.at((-200, -95, 200, 95)).normalised().struct(), italy.area_km2(), Box.at((10, 42, 12, 44)).grown(1).struct(), italy.contains_box(tuscany), Box.at((177, -19, -178, -16)).width(), tuscany.clamped(Box.at((10, 43, 11, 44))).struct())
    assert tuple(r.c0) == (9.68, 42.23, 12.37, 44.47) and r.c1 is None and tuple(r.c2) == (9.68, 42.23, 12.37, 44.47) and tuple(r.c3) == (-180, -90, 180, 90)
    assert r.c4 > 40_000 and tuple(r.c5) == (9, 41, 13, 45) and r.c6 and r.c7 == 5 and tuple(r.c8) == (10, 43, 11, 44)
    across = Box.at((177, -19, -178, -16))
    assert [one(spark, across.contains(F.lit(x), F.lit(-17.0))).c0 for x in (179.5, -179.0, 100.0)] == [True, True, False]
    empty = spark.range(0).select(Box.at((0, 0, 1, 1)).struct().alias("b")).agg(boxes.union_of("b").alias("u"), boxes.around(F.lit(1.0), F.lit(1.0)).alias("a")).first()
    assert tuple(empty.u) == (-180, -90, 180, 90) and empty.a.min_lng == float("inf")


def test_mercator(spark):
    x, y = mercator.project(*lit(11.2558, 43.7696))
    top = mercator.project(*lit(0.0, 89.0))[1]
    r = one(spark, x, y, top, mercator.meters_per_pixel(F.lit(0.0)), mercator.meters_per_pixel(F.lit(18.0), 512) - mercator.meters_per_pixel(F.lit(19.0)), mercator.zoom_of_resolution_at(F.lit(0.2), F.lit(43.77)))
    assert abs(r.c0 - 1252993) < 50 and abs(r.c1 - 5429856) < 50 and abs(r.c2 - 20037508.34) < 1 and abs(r.c3 - 156543.03) < 0.01 and r.c4 == 0 and 18.5 < r.c5 < 19.5
    assert one(spark, *mercator.tile_of(*lit(0.001, -0.001), F.lit(1)), *mercator.tile_of(*lit(-10.0, 10.0), F.lit(1))) == (1, 1, 0, 0)
    for z in (8, 10, 14, 18):  # a tile holds its point
        tx, ty = mercator.tile_of(*lit(11.2558, 43.7696), F.lit(z))
        assert one(spark, mercator.tile_box(tx, ty, F.lit(z)).contains(*lit(11.2558, 43.7696))).c0


def test_numbers_and_boxes_as_text(spark):
    box = Box.at((9.68, 42.23, 12.37, 44.47))
    said = lambda crs, v=None, p=None, b=box: one(spark, urls.format_box(b, F.lit(crs), F.lit(v) if v else None, p)).c0
    assert said("EPSG:4326", "1.1.1") == "9.68,42.23,12.37,44.47" and said("EPSG:4326", "1.3.0") == "42.23,9.68,44.47,12.37" and said("EPSG:3857", p=1) == "9.7,42.2,12.4,44.5"
    assert said("EPSG:3857", b=Box.at((0, -0.0, 100, 20037508.342789244))) == "0,0,100,20037508.342789244"
    parsed = lambda t: one(spark, urls.parse_box(F.lit(t), F.lit("EPSG:4326"), F.lit("1.3.0"))).c0
    assert parsed("bogus") is None and parsed("1,2,3") is None and tuple(parsed(" 42.2,9.6 ,44.4x, 1e1,7")) == (9.6, 42.2, 10, 44.4)


def test_systems(spark):
    same = [("EPSG:3857", "EPSG:900913", True), ("102100", "urn:ogc:def:crs:EPSG::3857", True), ("CRS:84", "EPSG:4326", True), ("EPSG:3857", "EPSG:4326", False)]
    for a, b, want in same:
        assert one(spark, REGISTRY.same(*lit(a, b))).c0 == want
    r = one(spark, REGISTRY.normalise(F.lit("IGNF:LAMB93")), REGISTRY.known(F.lit("IGNF:LAMB93")), REGISTRY.definition(F.lit("epsg:3035")), REGISTRY.equivalents(F.lit("EPSG:4258")), REGISTRY.axis_order(F.lit("EPSG:2180")), REGISTRY.axis_order(F.lit("EPSG:9999")), REGISTRY.is_geographic(F.lit("CRS84")))
    assert r.c0 == "IGNF:LAMB93" and r.c1 is None and r.c2.axis_order == "latlon" and r.c3 == ["EPSG:4258", "EPSG:4937"] and (r.c4, r.c5, r.c6) == ("latlon", "lonlat", True)
    own = Registry()
    own.add(Crs("EPSG:9999", "Own", "projected", "latlon", ("MINE",)))
    assert one(spark, own.normalise(F.lit("mine")), own.axis_order(F.lit("mine"))) == ("EPSG:9999", "latlon")


def test_regions(spark):
    valid = [("IT", True), ("ITI", True), ("ITI1", True), ("ITI14", True), ("EL", True), ("UK", True), ("EU", True), ("GR", False), ("GB", False), ("XX", False), ("ITI145", False), ("I", False), ("iti1", False), ("IT-I", False), ("", False)]
    df = spark.createDataFrame(valid, "c string, v boolean")
    assert all(r.v == r.got for r in df.withColumn("got", nuts.is_valid(F.col("c"))).collect())
    c = F.lit
    r = one(spark, nuts.ancestors(c("ITI14")), nuts.to_iso(c("EL30")), nuts.from_iso(c(" gb ")), nuts.from_iso(c("US")), nuts.within(c("ITI1"), c("I")), nuts.level(c("ITI14")), nuts.country_name(c("GR")), nuts.is_member(c("ITI1")), nuts.is_member(c("UK")))
    assert r.c0 == ["ITI1", "ITI", "IT"] and (r.c1, r.c2, r.c3, r.c4, r.c5, r.c6, r.c7, r.c8) == ("GR", "UK", None, True, 3, None, True, False)
    iso = nuts.iso_countries(spark)
    assert {"IT", "XK", "GB"} <= set(iso) and "UK" not in iso and len(iso) == 250


def test_texts(spark):
    r = one(spark, text.slug(F.lit("Còrsica / Sardegna")), text.layer_id(*lit("IT", "Toscana", "Ortofoto 2022")), text.slug(F.lit("x" * 80)), text.strip_tags(F.lit("<b>a &amp;lt; b</b>&nbsp;")))
    assert r.c0 == "corsica-sardegna" and r.c1 == "it.toscana.ortofoto-2022" and len(r.c2) == 60 and r.c3 == "a &lt; b"


def test_urls(spark):
    q = lambda base, *p, **k: one(spark, urls.with_query(F.lit(base), list(p), **k)).c0
    assert q("https://a.example/wms", ("A", F.lit("x y(1)!~é")), ("B", F.lit(None).cast("string")), ("C", F.lit("EPSG:3857,b"))) == "https://a.example/wms?A=x%20y(1)!~%C3%A9&C=EPSG:3857,b"
    assert q("https://a.example/wms?", ("A", F.lit("1"))) == "https://a.example/wms?A=1" and q("https://a.example/wms?k=1", ("A", F.lit("1")), extra=F.create_map(*lit("A", "2", "Z", "3"))) == "https://a.example/wms?k=1&A=2&Z=3"
    p = lambda url, proxy: one(spark, urls.through_proxy(F.lit(url), proxy)).c0
    assert p("https://a/{z}", "https://p/?u=") == "https://p/?u=https%3A%2F%2Fa%2F{z}" and p("https://a/b c", "https://p/{url}/x") == "https://p/https%3A%2F%2Fa%2Fb%20c/x" and p("https://a", "https://p/") == "https://p/https://a"
    rest = one(spark, urls.fill_rest(F.lit("t/{Layer}/{STYLE}/{TileMatrixSet}/{TileMatrix}/{TileRow}/{TileCol}/{Time}/{other}"), *lit("a$1", "s", "g"), F.create_map(*lit("TIME", "2020")))).c0
    assert rest == "t/a$1/s/g/{z}/{y}/{x}/2020/{other}"
    c = lambda u: one(spark, urls.capabilities_url(F.lit(u))).c0
    assert c("https://a.example/wms?map=1&Request=GetMap&version=1.1.1") == "https://a.example/wms?map=1&SERVICE=WMS&REQUEST=GetCapabilities&VERSION=1.3.0"
    r = one(spark, urls.base_url(F.lit("https://a.example/w?SERVICE=WMS&map=1")), urls.get_param(F.lit("https://a/?Map=x%20y&b=2"), "map"))
    assert r.c0 == "https://a.example/w?map=1" and r.c1 == "x y"
    formats = lambda *f: one(spark, urls.pick_info_format(F.array(*lit(*f)) if f else F.array().cast("array<string>"))).c0
    assert (formats("text/html", "application/json"), formats("text/html", "text/plain"), formats(), formats("odd/one")) == ("application/json", "text/html", "text/html", "odd/one")


def test_click_windows(spark):
    w = one(spark, urls.click_window(*lit(11.0, 43.0), Box.at((10.0, 42.0, 12.0, 44.0)), 1000, 1000), urls.click_window(*lit(50.0, 43.0), Box.at((10.0, 42.0, 12.0, 44.0)), 800, 600), urls.click_window(*lit(11.0, 43.0)))
    assert w.c0.i == 500 and abs(w.c0.j - 500) <= 10 and w.c1.i == 799 and (w.c2.width, w.c2.i, w.c2.j) == (101, 50, 50)


@pytest.mark.parametrize("order", [0, 1])
def test_order_of_imagery_depends_on_input(order):
    from functools import cmp_to_key

    from mapweave.operators.ranking import precedence

    base = {"is_tiled": False, "resolutionMeters": 0.2, "start": None, "end": None}
    rows = [{**base, "id": "c", "area_km2": 100.0}, {**base, "id": "b", "area_km2": 104.0}, {**base, "id": "a", "area_km2": 108.0}]
    got = [r["id"] for r in sorted(rows[::-1] if order else rows, key=cmp_to_key(precedence))]
    assert precedence(rows[0], rows[2]) < 0 < precedence(rows[0], rows[1]) and sorted(got) == ["a", "b", "c"]
